"""The baseline ratchet: known violations are tolerated, new ones fail."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.sources.registry import classify


class BaselineError(ValueError):
    pass


def fingerprint(schema: Column, path: Column, keyword: Column, subject: Column) -> Column:
    """16 hex digits that identify a violation whatever its line, message or file."""
    joined = F.concat(schema, F.lit("\x00"), path, F.lit("\x00"), keyword, F.lit("\x00"), F.coalesce(subject, F.lit("")))
    return F.left(F.sha2(joined, 256), F.lit(16))


def fingerprint_text(schema: str, path: str, keyword: str, subject: str | None = None) -> str:
    return hashlib.sha256("\0".join((schema, path, keyword, subject or "")).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Base:
    """Where references and paths are told from: the baseline's folder, the run's, and the working one."""

    folder: str
    run: str
    cwd: str

    def schema(self, ref: str) -> str:
        if classify(ref) != "file":
            return ref
        return os.path.relpath(os.path.join(self.cwd, ref), self.folder).replace(os.sep, "/")

    def file_prefix(self) -> str:
        """What turns a label of the run into one of the baseline."""
        step = os.path.relpath(self.run, self.folder).replace(os.sep, "/")
        return "" if step == "." else step + "/"

    def file(self, label: str) -> str:
        return posixpath.normpath(self.file_prefix() + label)


def with_fingerprints(found: DataFrame, base: Base | None = None, refs: list[str] = ()) -> DataFrame:
    """Violations with ``entry`` (the file's name in a baseline) and ``fingerprint``."""
    schema, entry = F.col("schema"), F.col("file")
    if base is not None:
        moved = {r: base.schema(r) for r in refs if base.schema(r) != r}
        if moved:
            schema = F.coalesce(F.create_map(*[F.lit(x) for pair in moved.items() for x in pair])[schema], schema)
        prefix = base.file_prefix()
        if prefix:

            @F.pandas_udf("string")
            def canonical(labels):
                return labels.map(base.file)

            entry = canonical("file")
    return found.withColumns({"entry": entry, "fingerprint": fingerprint(schema, F.col("instance_path"), F.col("keyword"), F.col("subject"))})


def build(printed: DataFrame) -> DataFrame:
    """file, fingerprints (sorted, distinct) of every file with violations; standard input has no entry."""
    kept = printed.where("file <> '<stdin>'")
    return kept.groupBy(F.col("entry").alias("file")).agg(F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"))


@dataclass
class Applied:
    fresh: DataFrame
    suppressed: DataFrame
    stale: DataFrame
    counts: DataFrame


def apply(printed: DataFrame, checked: DataFrame, baseline: DataFrame) -> Applied:
    """Split violations by a baseline (file, fingerprint).

    ``checked`` has the entry of every file of the run; entries of others are neither
    recorded nor stale here.  ``counts``: recorded and stale count distinct prints,
    suppressed counts occurrences.
    """
    known = baseline.select(F.col("file").alias("entry"), "fingerprint").distinct()
    here = known.join(checked.select("entry").distinct(), "entry", "left_semi")
    keys = ["entry", "fingerprint"]
    suppressed = printed.join(here, keys, "left_semi")
    fresh = printed.join(here, keys, "left_anti")
    stale = here.join(printed.select(*keys).distinct(), keys, "left_anti")
    tagged = [d.select(F.lit(n).alias("what")) for n, d in (("recorded", here), ("suppressed", suppressed), ("stale", stale))]
    counts = tagged[0].union(tagged[1]).union(tagged[2]).agg(*[F.count_if(F.col("what") == n).alias(n) for n in ("recorded", "suppressed", "stale")])
    return Applied(fresh, suppressed, stale, counts)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, fingerprint, change ("added" or "removed") between two baselines (file, fingerprint)."""
    a, b = before.select("file", "fingerprint").distinct(), after.select("file", "fingerprint").distinct()
    keys = ["file", "fingerprint"]
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def serialize(entries: dict[str, list[str]], made_by: str = "metaloom") -> str:
    body = {"version": 1, "generatedWith": made_by, "entries": {f: sorted(set(entries[f])) for f in sorted(entries, key=lambda x: x.encode("utf-16-be", "surrogatepass"))}}
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n"


def parse(text: str) -> dict[str, list[str]]:
    try:
        body = json.loads(text)
    except ValueError as e:
        raise BaselineError(f"the baseline is not valid JSON: {e}") from None
    if not isinstance(body, dict) or body.get("version") != 1 or not isinstance(body.get("entries"), dict):
        raise BaselineError("the baseline must be an object with version 1 and entries")
    for file, prints in body["entries"].items():
        if not isinstance(prints, list) or not all(isinstance(p, str) and re.fullmatch("[0-9a-f]{16}", p) for p in prints):
            raise BaselineError(f"the baseline's entry {file} must list fingerprints of 16 hex digits")
    return body["entries"]


def read(path: str) -> dict[str, list[str]] | None:
    """The entries of a baseline file; None if there is no file."""
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read().removeprefix("\ufeff"))
    except FileNotFoundError:
        return None


def to_table(spark: SparkSession, entries: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(f, p) for f, prints in entries.items() for p in prints], "file string, fingerprint string")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A baseline file as rows, parsed by Spark: for baselines too large for the driver."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "version int, entries map<string,array<string>>").alias("b"))
    return text.select(F.explode("b.entries").alias("file", "prints")).select("file", F.explode("prints").alias("fingerprint"))
