"""Inference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators import infer as I

from . import rendering as R


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Documents with YAML metadata, of which labels cover some; and how many there are."""
    docs, labels = R.table(spark, sf_dir, "documents"), R.table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "lang", "source").join(labels.withColumnRenamed("doc_id", "label_id"), F.col("doc_id") == F.col("label_id"), "left")
    # one in ten toxic flags is written as a string
    toxic = F.when(F.col("doc_id") % 10 == 0, R.quoted(F.col("toxic").cast("string"))).otherwise(F.col("toxic").cast("string"))
    content = R.yaml(lang=F.col("lang"), source=F.col("source"), id=F.col("doc_id").cast("string"), quality=F.col("quality").cast("string"), toxic=F.when(F.col("toxic").isNotNull(), toxic))
    rows = joined.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.col("doc_id").alias("file_ord"), content.alias("content"))
    return rows, docs.count()


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scanned = _labelled(spark, sf_dir)
    found = I.occurrences_of_documents(rows)
    out = I.profile(found, scanned)
    types = F.array_join(F.transform("types", lambda t: F.concat(t["type"], F.lit(":"), t["n"].cast("string"))), ",")
    return out.select("key", "present", F.round("coverage", 6).alias("coverage"), types.alias("types"), "type", "distinct", "capped", F.concat_ws(",", F.coalesce("enum", F.array().cast("array<string>"))).alias("enum"))


def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are metadata already, profiled in the JVM."""
    events = R.table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").cast("string").alias("file"), F.col("event_id").alias("file_ord"), "event_type", "user_id", "props")
    found = I.occurrences_of_map(rows, {"event_type": R.quoted(F.col("event_type")), "user": F.col("user_id").cast("string"), "props": F.col("props")})
    out = I.profile(found, events.count())
    return out.select("key", "present", "type", "distinct", "capped", F.size(F.coalesce("enum", F.array().cast("array<string>"))).alias("n_enum"))


def outlier_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _labelled(spark, sf_dir)
    return I.outliers(I.occurrences_of_documents(rows)).select("key", "type", "file", "value", F.col("nth").cast("int").alias("nth"))


QUERIES = {"infer_profile": profile, "infer_profile_columns": event_profile, "infer_outliers": outlier_values}

_OCCURRENCES = """occ AS (
  SELECT doc_id, 'lang' AS key, 'string' AS type, lang AS value FROM documents
  UNION ALL SELECT doc_id, 'source', 'string', source FROM documents
  UNION ALL SELECT doc_id, 'id', 'number', doc_id::VARCHAR FROM documents
  UNION ALL SELECT doc_id, 'quality', 'number', quality::VARCHAR FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 'toxic', CASE WHEN doc_id % 10 = 0 THEN 'string' ELSE 'number' END, toxic::VARCHAR FROM documents JOIN labels USING (doc_id)
)"""

ORACLES = {
    "infer_profile": f"""WITH {_OCCURRENCES},
      byt AS (SELECT key, type, count(*) AS n, count(DISTINCT value) AS d FROM occ GROUP BY ALL),
      keys AS (SELECT key, sum(n) AS present, string_agg(type || ':' || n, ',' ORDER BY n DESC, type) AS types, first(type ORDER BY n DESC, type) AS type, sum(d) AS da, first(d ORDER BY n DESC, type) AS dm FROM byt GROUP BY key),
      vals AS (SELECT key, type, value, count(*) AS n FROM occ GROUP BY ALL),
      lists AS (SELECT v.key, string_agg(CASE WHEN v.type = 'string' THEN '"' || value || '"' ELSE value END, ',' ORDER BY v.n DESC, CASE WHEN v.type = 'string' THEN '"' || value || '"' ELSE value END) AS vs FROM vals v JOIN keys k ON v.key = k.key AND v.type = k.type GROUP BY v.key)
      SELECT key, present::BIGINT AS present, round(present / (SELECT count(*) FROM documents) * 100, 6) AS coverage, types, type, least(da, 1000)::BIGINT AS distinct, da > 1000 AS capped,
        CASE WHEN da <= 1000 AND dm <= 20 AND dm <= 0.05 * present THEN vs ELSE '' END AS enum FROM keys JOIN lists USING (key)""",
    "infer_profile_columns": """WITH occ AS (
        SELECT 'event_type' AS key, 'string' AS type, event_type AS value FROM events UNION ALL SELECT 'user', 'number', user_id::VARCHAR FROM events UNION ALL SELECT 'props', 'object', props FROM events)
      SELECT key, count(*) AS present, any_value(type) AS type, least(count(DISTINCT value), 1000) AS distinct, count(DISTINCT value) > 1000 AS capped,
        CASE WHEN any_value(type) <> 'object' AND count(DISTINCT value) <= 20 AND count(DISTINCT value) <= 0.05 * count(*) THEN count(DISTINCT value) ELSE 0 END::INT AS n_enum FROM occ WHERE value IS NOT NULL GROUP BY key""",
    "infer_outliers": f"""WITH {_OCCURRENCES} SELECT key, type, doc_id::VARCHAR || '.md' AS file, '"' || value || '"' AS value, nth::INT AS nth FROM (
        SELECT *, row_number() OVER (ORDER BY doc_id) AS nth FROM occ WHERE key = 'toxic' AND type = 'string') WHERE nth <= 20""",
}
