"""Inference: a profile of every metadata key, and a draft contract.

The scan explodes the top-level keys and aggregates twice: by (key, type, value) and
by key, so a key that every document has, or a value that a third of them share, is
counted map-side first and never gathered.  Counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.values import dump, load, type_name

from . import extract as X
from .extractors import Extractor

MOST_DISTINCT, MOST_OUTLIERS = 1000, 20
MOST_ENUM, ENUM_SHARE = 20, 0.05

DATE = r"^\d{4}-\d{2}-\d{2}$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}"
URI = r"^[A-Za-z][A-Za-z0-9+.-]*://"

_OWN = ("file", "file_ord")
_KINDS = {"key_ord": pa.int32(), "key": pa.string(), "type": pa.string(), "value": pa.string()}


def _explode(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterable[str]]) -> DataFrame:
    """file, file_ord and the top-level keys of each row, whose metadata ``read`` gives as JSON text, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            at, found = [], []
            for row, text in enumerate(read(batch)):
                for i, (k, v) in enumerate(load(text).items()):
                    at.append(row)
                    found.append((i, k, type_name(v), dump(v)))
            columns = zip(*found) if found else ([] for _ in _KINDS)
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in _OWN]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, kind) for c, kind in zip(columns, _KINDS.values()))], [*_OWN, *_KINDS])

    return rows.mapInArrow(run, f"file string, file_ord {rows.schema['file_ord'].dataType.simpleString()}, key_ord int, key string, type string, value string")


def occurrences(extracted: DataFrame) -> DataFrame:
    """file, file_ord, key_ord, key, type, value (JSON text, dates as strings) of every top-level key; $schema counts."""
    return _explode(extracted.where("error IS NULL").select(*_OWN, "data_json"), lambda batch: batch.column(2).to_pylist())


def occurrences_of_documents(documents: DataFrame, forced: str | None = None, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """``occurrences(extract(documents))`` in one Python worker a core in place of two, without positions."""

    def read(batch: pa.RecordBatch) -> Iterator[str]:
        for document in zip(*(batch.column(i).to_pylist() for i in range(3))):
            row = X.extract_row(*document, extractors)
            yield row["data_json"] if row["error"] is None else "{}"

    return _explode(X.inputs(documents, forced, extractors, ("file_ord",)), read)


def occurrences_of_map(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``occurrences`` of metadata that lies in columns already, in the JVM: key to a column of JSON text, null where unset."""
    pairs = F.array(*[F.struct(F.lit(i).alias("key_ord"), F.lit(k).alias("key"), c.alias("value")) for i, (k, c) in enumerate(columns.items())])
    each = rows.select("file", "file_ord", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("o"))
    value = F.col("o.value")
    first = F.substr(value, F.lit(1), F.lit(1))
    kind = F.when(first == '"', "string").when(first == "[", "array").when(first == "{", "object").when(value == "null", "null").when(value.isin("true", "false"), "boolean").otherwise("number")
    return each.select("file", "file_ord", "o.key_ord", "o.key", kind.alias("type"), value.alias("value"))


def _text(value: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(value), "$", "string")


def profile(found: DataFrame, scanned: int) -> DataFrame:
    """One row a key: present, coverage, types, dominant type, distinct, capped, sample, format, enum, has_empty.

    ``scanned`` counts all files of the run, those without metadata and unreadable ones too.
    """
    place = F.struct("file_ord", "key_ord")
    by_value = found.groupBy("key", "type", "value").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    by_type = by_value.groupBy("key", "type").agg(F.sum("n").alias("type_n"), F.count("*").alias("type_distinct"), F.min("first").alias("type_first"))
    typed = by_type.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("type_n")).alias("order"), F.col("type"), F.col("type_n").alias("n")))).alias("types"),
        F.sum("type_n").alias("present"),
        F.sum("type_distinct").alias("distinct_all"),
        F.min("type_first").alias("key_first"),
    )
    typed = typed.withColumns({"dominant": F.col("types")[0]["type"], "dominant_n": F.col("types")[0]["n"]})
    # values of the dominant type; at most the first so many of a key are listed
    main = by_value.join(typed.select("key", "dominant"), "key").where("type = dominant")
    text = F.when(F.col("type") == "string", _text(F.col("value")))
    stats = main.groupBy("key").agg(
        F.count("*").alias("main_distinct"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("sample"),
        F.bool_and(text.rlike(DATE)).alias("is_date"),
        F.bool_and(text.rlike(DATE_TIME)).alias("is_date_time"),
        F.bool_and(text.rlike(URI)).alias("is_uri"),
        F.bool_or(F.coalesce(text == "", F.lit(False))).alias("has_empty"),
    )
    small = stats.where(F.col("main_distinct") <= MOST_ENUM).select("key")
    listed = main.join(small, "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "value"))).alias("values"))
    out = typed.join(stats, "key").join(listed, "key", "left")
    capped = F.col("distinct_all") > MOST_DISTINCT
    scalar = F.col("dominant").isin("string", "number", "boolean")
    enum = scalar & ~capped & F.col("main_distinct").between(1, MOST_ENUM) & (F.col("main_distinct") <= ENUM_SHARE * F.col("present"))
    kind = F.when(F.col("is_date"), "date").when(F.col("is_date_time"), "date-time").when(F.col("is_uri"), "uri")
    return out.select(
        "key",
        "present",
        (F.col("present") / F.lit(max(1, scanned)) * 100).alias("coverage"),
        F.transform("types", lambda t: F.struct(t["type"].alias("type"), t["n"].alias("n"))).alias("types"),
        F.col("dominant").alias("type"),
        F.least("distinct_all", F.lit(MOST_DISTINCT)).alias("distinct"),
        capped.alias("capped"),
        "sample",
        F.when((F.col("dominant") == "string") & ~capped, kind).alias("format"),
        F.when(enum, F.transform("values", lambda v: v["value"])).alias("enum"),
        "has_empty",
    )


def outliers(found: DataFrame) -> DataFrame:
    """key, type, file, value of values whose type isn't their key's commonest; the first 20 of each key and type."""
    by_type = found.groupBy("key", "type").agg(F.count("*").alias("n"))
    main = by_type.groupBy("key").agg(F.min_by("type", F.struct((-F.col("n")).alias("n"), F.col("type"))).alias("dominant"))
    odd = found.join(main, "key").where("type <> dominant")
    nth = F.row_number().over(Window.partitionBy("key", "type").orderBy("file_ord", "key_ord"))
    return odd.withColumn("nth", nth).where(F.col("nth") <= MOST_OUTLIERS).select("key", "type", "file", "value", "nth")


def report_order(profiled: DataFrame, min_coverage: float = 0.0) -> DataFrame:
    """The keys of a report: enough coverage, commonest first, then by name as people sort it."""
    return profiled.where(F.col("coverage") >= min_coverage).orderBy(F.desc("coverage"), F.collate("key", "UNICODE"), "key")


def draft(profiled: DataFrame) -> dict[str, Any]:
    """A draft contract of a profile's keys; never required. A row a key reaches the driver."""
    properties = {}
    for row in sorted(profiled.collect(), key=lambda r: r["key"]):
        rule: dict[str, Any] = {"type": row["type"]}
        if row["enum"]:
            rule["enum"] = [load(v) for v in row["enum"]]
        elif row["type"] == "string" and not row["has_empty"]:
            rule["minLength"] = 1
        properties[row["key"]] = rule
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": True, "properties": properties}
