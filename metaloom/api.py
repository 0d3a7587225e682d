"""The verbs of the library: validate, get, infer, fill."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators import baseline as B
from metaloom.operators import extract as X
from metaloom.operators import fields as G
from metaloom.operators import fill as FI
from metaloom.operators import infer as I
from metaloom.operators import resolve as S
from metaloom.operators import validate as V
from metaloom.operators.extractors import EXTRACTORS, by_extension
from metaloom.reports import profile as P
from metaloom.reports import render as R
from metaloom.sources import config as C
from metaloom.sources import files, sinks
from metaloom.sources.registry import DiskCache, Registry


@dataclass
class Run:
    """The settled inputs of a run."""

    spark: SparkSession
    cwd: str
    config: C.Config
    base: str
    targets: files.Targets
    documents: DataFrame
    forced: str | None


def prepare(spark: SparkSession, paths: list[str], cwd: str = ".", config: str | bool | None = None, ext: list[str] | None = None, as_format: str | None = None, exclude: list[str] | None = None, gitignore: bool | None = None, allow_empty: bool | None = None, stdin: str | None = None) -> Run:
    """Configuration, files and documents; typed paths are relative to ``cwd``, the configuration's to its folder.

    A path with a scheme (``hdfs://``, ``s3a://``, ``file://``) is a folder that Spark lists
    and reads, never the driver.
    """
    settings = C.load(cwd, config)
    remote = [p for p in (paths or settings.paths) if "://" in p]
    inputs = [p for p in (paths or settings.paths) if p != "-" and p not in remote]
    base = cwd if paths else settings.folder
    obey, _ = files.respect_gitignore(gitignore, settings.respect_gitignore)
    lax = settings.allow_empty if allow_empty is None else allow_empty
    if "-" in paths and as_format is None:
        raise files.InputError("standard input needs a format")
    wanted = ext or (list(EXTRACTORS[as_format].extensions) if as_format else list(by_extension()))
    targets = files.find(inputs, wanted, base, [*settings.exclude, *(exclude or [])], obey, bool(lax) or stdin is not None) if inputs or (stdin is None and not remote) else files.Targets()
    documents = files.read(spark, targets, base)
    for folder in remote:
        documents = documents.unionByName(files.read_folder(spark, folder, wanted, [*settings.exclude, *(exclude or [])]))
    if stdin is not None:
        documents = files.standard_input(spark, stdin).union(documents)
    return Run(spark, cwd, settings, base, targets, documents, as_format)


def _refuse_unknown(run: Run) -> None:
    """A file of no known format ends the run before anything is read."""
    labels = [f for f in run.targets.all if run.forced is None and os.path.splitext(f)[1].lower() not in by_extension()]
    if labels:
        raise files.InputError(f"no extractor for {labels[0]}")


def registry_of(run: Run, offline: bool | None = None, cache_folder: str | None = None, aliases: dict[str, str] | None = None) -> Registry:
    hours = 24 if run.config.ttl_hours is None else run.config.ttl_hours
    cache = DiskCache(cache_folder, hours * 3600) if cache_folder else None
    pins = {run.config.rebased(r, run.cwd): p for r, p in run.config.pins.items()}
    return Registry(run.cwd, bool(run.config.offline if offline is None else offline), cache=cache, pins=pins, aliases=aliases or {})


@dataclass
class Validation:
    results: DataFrame
    summary: dict[str, Any]

    def report(self, form: str = "pretty", quiet: bool = False, color: bool = False) -> Iterator[str]:
        return R.render(form, self.results, self.summary, quiet, color)

    @property
    def exit_code(self) -> int:
        return 0 if self.summary.get("baseline", {}).get("written") and not self.summary.get("stdin_failed") else R.exit_code(self.summary)


def validate(run: Run, schemas: list[str] = (), registry: Registry | None = None, baseline: str | bool | None = None, write_baseline: bool = False) -> Validation:
    """Check every document; with a baseline only new violations fail."""
    registry = registry or registry_of(run)
    _refuse_unknown(run)
    rules = run.config.rules(run.cwd, list(schemas), tuple(registry.aliases))
    resolved = S.resolve(X.extract(run.documents, run.forced), rules).persist()
    found = V.violations(resolved, registry).persist()
    path = run.config.baseline if baseline is None else baseline
    base_dir = run.cwd if isinstance(baseline, str) else run.config.folder
    if not isinstance(path, str):
        results = V.results(resolved, found)
        return Validation(results, _counts(results, run))
    full = os.path.join(base_dir, path)
    base = B.Base(os.path.dirname(os.path.abspath(full)), os.path.abspath(run.base), os.path.abspath(run.cwd))
    printed = B.with_fingerprints(found, base, list(registry.compiled)).persist()
    known = B.read(full)
    if write_baseline:
        entries = {r["file"]: r["fingerprints"] for r in B.build(printed).toLocalIterator()}
        old = known or {}
        sinks.write_atomic(full, B.serialize(entries))
        pairs = lambda e: {(f, p) for f, prints in e.items() for p in prints}
        info = {"path": path, "written": True, "recorded": len(pairs(entries)), "suppressed": 0, "stale": 0, "added": len(pairs(entries) - pairs(old)), "removed": len(pairs(old) - pairs(entries))}
        results = V.results(resolved, found)
        summary = _counts(results, run) | {"baseline": info}
        summary["stdin_failed"] = results.where("file = '<stdin>' AND NOT ok").count() > 0
        return Validation(results, summary)
    if known is None:
        raise B.BaselineError(f"there is no baseline {path}; write one first")
    files_seen = B.with_fingerprints(resolved.select("file").withColumns({c: F.lit("") for c in ("schema", "instance_path", "keyword", "subject")}), base)
    applied = B.apply(printed, files_seen, B.to_table(run.spark, known))
    suppressed = applied.suppressed.groupBy("file").agg(F.count("*").alias("baselined"))
    results = V.results(resolved, applied.fresh).join(suppressed, "file", "left").withColumn("baselined", F.coalesce("baselined", F.lit(0)))
    counts = applied.counts.first().asDict()
    return Validation(results, _counts(results, run) | {"baseline": {"path": path, **counts}})


def _counts(results: DataFrame, run: Run) -> dict[str, Any]:
    return V.summary(results).first().asDict() | {"gitignore_skipped": run.targets.gitignore_skipped}


def get(run: Run, refs: list[str], form: str = "pretty", quiet: bool = False) -> Iterator[str]:
    """A block that can't be read ends the run."""
    _refuse_unknown(run)
    got = G.get(X.extract(run.documents, run.forced, on_error="raise"), refs)
    rows = P.get_json_rows(got, refs) if form == "json" else P.get_rows(got, refs, quiet)
    return (r["line"] for r in rows.orderBy("file").toLocalIterator())


@dataclass
class Profile:
    keys: DataFrame
    outliers: DataFrame
    scanned: int
    bare: int
    unreadable: list[tuple[str, str]]
    hidden: int

    def draft(self) -> dict[str, Any]:
        return I.draft(self.keys)

    def report(self, color: bool = False) -> Iterator[str]:
        keys = [r.asDict(recursive=True) for r in I.report_order(self.keys).collect()]
        odd = [r.asDict() for r in self.outliers.orderBy("key", "type", "nth").collect()]
        return P.infer_table(keys, odd, self.scanned, self.bare, self.unreadable, self.hidden, color)


def infer(run: Run, min_coverage: float = 0.0) -> Profile:
    _refuse_unknown(run)
    extracted = X.extract(run.documents.withColumnRenamed("ord", "file_ord"), run.forced, keep=("file_ord",)).persist()
    totals = extracted.agg(F.count("*").alias("n"), F.count_if(~F.col("present") & F.col("error").isNull()).alias("bare")).first()
    bad = [(r["file"], r["error"]) for r in extracted.where("error IS NOT NULL").orderBy("file").toLocalIterator()]
    found = I.occurrences(extracted).persist()
    keys = I.profile(found, totals["n"]).persist()
    shown = keys.where(F.col("coverage") >= min_coverage)
    return Profile(shown, I.outliers(found).join(shown.select("key"), "key"), totals["n"], totals["bare"], bad, keys.count() - shown.count())


def fill(run: Run, provider: FI.Provider, schemas: list[str] = (), registry: Registry | None = None, options: FI.Options | None = None, dry_run: bool = False, cache: str | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """(results, summary); changed documents are written unless it is a dry run; ``cache`` is a file of stored proposals."""
    options = options or FI.Options()
    if cache:
        options = replace(options, cached=FI.read_cache(cache) | options.cached)
    registry = registry or registry_of(run)
    extracted = X.extract(run.documents, run.forced, keep=("content",))
    resolved = S.resolve(extracted, run.config.rules(run.cwd, list(schemas), tuple(registry.aliases))).persist()
    refs = V.schema_refs(resolved)
    broken = V.compile_all(refs, registry)
    filled = FI.fill(resolved, registry, provider, [r for r, _ in refs if r not in broken], options).persist()
    counts = FI.summary(filled, options.prices).first().asDict()
    if cache:
        FI.store_cache(cache, filled)
    if not dry_run:
        failed = sinks.write_files(filled.where("changed AND file <> '<stdin>'"), run.base).where("error IS NOT NULL").count()
        counts["errors"] += failed
    return filled, counts
