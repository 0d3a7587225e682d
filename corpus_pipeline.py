"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; ``run`` writes each stage's rows as Parquet in the folder that
spark.checkpoint.dir names and reads them again.  All stages but the last return the
columns of ``docs``; a stage that changes a text sets ``n_chars``, where the column is
there, to its new number of characters.

Defined results, for all stages: nulls in any column are kept (a null text is empty
where it is judged, and stays null if nothing is changed in it); repeated rows are
judged alike; empty tables give empty tables; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm import common, packing, secrets, simhash, substring_dedup, toxicity


def _count_chars(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; it learns from the labelled ones among ``docs``."""
    model = toxicity.learn(docs, common.read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id."""
    return simhash.keep_representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 20-word windows that start earlier elsewhere go; every document stays."""
    return _count_chars(substring_dedup.apply_removals(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, give way to a mark; every document stays."""
    return _count_chars(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset of every piece."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learnt classifier and tokenizer ids have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None
