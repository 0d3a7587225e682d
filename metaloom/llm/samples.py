"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


#: Bytes of the longest text that is learnt from, and of all texts of a sample together.
TEXT_BYTES = 1 << 16
MOST_BYTES = 24 << 20


def _draw() -> Column:
    """A number from 0 to 1 that doc_id fixes."""
    return F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: int | dict[int, int], where: Column | None = None) -> DataFrame:
    """doc_id, text, label of about ``most`` labelled documents of at most ``TEXT_BYTES``, picked by a hash of doc_id.

    ``where`` is a condition on ``doc_id``; ``most`` may be given for each label.  Only the
    picked ids, at most that many, are broadcast, so the texts of the others don't
    move.  Rows without a label or a text are left out.
    """
    common.bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chance = F.lit(0.0)
    for value, n in counts.items():
        share = most[value] / n if isinstance(most, dict) else most / sum(counts.values())
        chance = F.when(F.col("label") == value, F.lit(share)).otherwise(chance)
    picked = known.where(_draw() < chance).withColumnRenamed("doc_id", "picked_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= TEXT_BYTES)
    return texts.join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id")).select("doc_id", "text", "label")


def fit_on_executor(rows: DataFrame, fit: Callable[[list[tuple[str, int]]], Any]) -> Any:
    """What ``fit`` makes of the (text, label) rows of a bounded sample, in an order that a hash of doc_id fixes.

    One task gathers the sample, up to ``MOST_BYTES``, so that neither its texts nor the
    fitting take the driver's memory; a task that is lost is run again with the same
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int]] = []
        held = 0
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                held += text.as_buffer().size
                if held <= MOST_BYTES:
                    found.append((text.as_py(), label))
        model = pickle.dumps(fit(found))
        del found
        common.release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    ordered = rows.repartition(1).sortWithinPartitions(_draw(), "doc_id", "text").select("text", "label")
    made = ordered.mapInArrow(run, "model binary").first()
    return fit([]) if made is None else pickle.loads(bytes(made["model"]))
