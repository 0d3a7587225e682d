"""Validation: documents × contracts to violations, results and a summary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.pointers import look_up
from metaloom.functions.values import load
from metaloom.sources.registry import Registry

from .compile import compile_contract
from .jsonschema import SchemaError, Violation

#: Keywords whose place is the parent's, so that a column would mislead.
NO_COLUMN = ("required", "additionalProperties")

COLUMNS = "file string, ord int, schema string, instance_path string, message string, keyword string, subject string, line int, col int"


def schema_refs(resolved: DataFrame) -> list[tuple[str, bool]]:
    """(reference, whether a run must fail if it can't be loaded) of all contracts in use; as many as there are contracts."""
    used = resolved.where("error IS NULL AND schema_error IS NULL").select(F.explode("schemas").alias("ref"), (F.col("source") != "document").alias("strict"))
    return [(r["ref"], r["strict"]) for r in used.groupBy("ref").agg(F.max("strict").alias("strict")).orderBy("ref").collect()]


def compile_all(refs: list[tuple[str, bool]], registry: Registry) -> dict[str, str]:
    """The errors of contracts that only documents chose; any other failure is raised."""
    broken = {}
    for ref, strict in refs:
        try:
            registry.compile(ref)
        except SchemaError as e:
            if strict:
                raise
            broken[ref] = str(e)
    return broken


def violations(resolved: DataFrame, registry: Registry, refs: list[tuple[str, bool]] | None = None) -> DataFrame:
    """One row for each violation, in order ``ord`` within its file.

    ``refs`` are the contracts in use if the caller knows them; otherwise they are
    looked up first (distinct references, never documents, reach the driver).
    """
    refs = schema_refs(resolved) if refs is None else refs
    broken = compile_all(refs, registry)
    evaluators = {ref: registry.compile(ref) for ref, _ in refs if ref not in broken}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 5, pa.int32(), pa.int32()]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                found: list[tuple[str, Violation]] = []
                lines, cols = dict(row["lines"] or ()), dict(row["cols"] or ())
                if row["error"] is not None:
                    found.append(("(parse)", Violation("", "parse", row["error"])))
                elif row["schema_error"] is not None:
                    found.append(("(parse)", Violation("", "schema", row["schema_error"])))
                else:
                    data = load(row["data_json"])
                    data.pop("$schema", None)
                    for ref in row["schemas"]:
                        if ref in broken:
                            found = [("(parse)", Violation("", "schema", broken[ref]))]
                            break
                        found += [(ref, v) for v in evaluators[ref].evaluate(data)]
                for i, (ref, v) in enumerate(found):
                    line = look_up(lines, v.path) if ref != "(parse)" else None
                    col = look_up(cols, v.path) if ref != "(parse)" and v.keyword not in NO_COLUMN else None
                    out.append((row["file"], i, ref, v.path, v.message, v.keyword, v.subject, line, col))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return resolved.select("file", "data_json", "lines", "cols", "error", "schemas", "schema_error").mapInArrow(check, COLUMNS)


def _tagged(ref: str):
    return lambda e: F.struct(F.lit(ref).alias("schema"), *[e[k].alias(k) for k in ("path", "message", "keyword", "subject")])


def fast_violations(resolved: DataFrame, registry: Registry, refs: list[str]) -> DataFrame:
    """``violations`` without positions and without Python, for contracts that compile to columns.

    Every document is checked against the ``refs`` in its set.
    """
    data = F.try_parse_json("data_json")
    found = []
    for ref in refs:
        errors = compile_contract(registry.load(ref), F.col("data"))
        if errors is None:
            raise SchemaError(f"{ref} has rules that don't compile to columns")
        tagged = F.transform(errors, _tagged(ref))
        found.append(F.when(F.array_contains("schemas", ref), tagged).otherwise(F.array().cast("array<struct<schema:string,path:string,message:string,keyword:string,subject:string>>")))
    rows = resolved.where("error IS NULL AND schema_error IS NULL").select("file", data.alias("data"), "schemas")
    each = rows.select("file", F.posexplode(F.concat(*found)).alias("ord", "e"))
    return each.select("file", "ord", F.col("e.schema").alias("schema"), F.col("e.path").alias("instance_path"), F.col("e.message").alias("message"), F.col("e.keyword").alias("keyword"), F.col("e.subject").alias("subject"))


def results(resolved: DataFrame, found: DataFrame) -> DataFrame:
    """file, format, ok, schemas, errors (array, in order) of every document; a file's violations are bounded by its contracts."""
    errors = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "schema", "instance_path", "message", "keyword", "subject", "line", "col"))).alias("errors"))
    unread = F.col("error").isNotNull() | F.col("schema_error").isNotNull()
    rows = resolved.select("file", "format", F.when(unread, F.array().cast("array<string>")).otherwise(F.col("schemas")).alias("schemas"))
    out = rows.join(errors, "file", "left")
    return out.select("file", "format", F.col("errors").isNull().alias("ok"), "schemas", F.coalesce("errors", F.array().cast(errors.schema["errors"].dataType)).alias("errors"))


def summary(found: DataFrame) -> DataFrame:
    """files, passed, failed, errors of a run's results."""
    return found.agg(F.count("*").alias("files"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"))
