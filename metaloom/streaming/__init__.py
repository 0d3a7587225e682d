"""Validation of documents as they arrive, by Structured Streaming.

Extraction, resolution and evaluation are narrow, so the same operators run on a
stream of files; each micro-batch appends its violations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metaloom.operators import extract as X
from metaloom.operators import resolve as S
from metaloom.operators import validate as V
from metaloom.sources.registry import Registry


def documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """file, content of the files that appear in a folder."""
    rows = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    return rows.select(F.regexp_replace(F.try_url_decode("_metadata.file_path"), r"^file:/*", "/").alias("file"), F.col("value").alias("content"))


def violations(stream: DataFrame, rules: S.Rules, registry: Registry, refs: list[str]) -> DataFrame:
    """``validate.violations`` of a stream; its contracts are given, as no stream can be asked for them first."""
    known = S.resolve(X.extract(stream), rules)
    return V.violations(known, registry, [(r, True) for r in refs])


def validate_to(stream: DataFrame, rules: S.Rules, registry: Registry, refs: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Appends every violation to a Parquet table, each document once."""
    found = violations(stream, rules, registry, refs)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
