"""Queries of single functions and relations: references, pointers, listings, prints, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions import pointers as P
from metaloom.functions import text as T
from metaloom.operators import baseline as B
from metaloom.operators import extract as X
from metaloom.operators import fill as FI
from metaloom.operators import infer as I
from metaloom.operators import listing as L
from metaloom.operators import resolve as S
from metaloom.operators.compile import FORMATS
from metaloom.sources.builtins import DEFAULT_SET
from metaloom.sources.registry import Registry

from . import rendering as R
from .governance import _pages


def pointer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("~"), F.col("p_brand"))
    pointer = F.concat(F.lit("/"), P.escape_column(key), F.lit("/0"))
    return R.table(spark, sf_dir, "part").select("p_partkey", pointer.alias("pointer"), P.top_key(pointer).alias("top"))


def vendor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "pages").select("page_id", T.vendor_file_name(F.col("url")).alias("name"))


def comma_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(",", F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")), F.lit(""), F.col("c_mktsegment"), F.lit("  "))
    return R.table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", T.split_list(text)).alias("parts"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 4
    ref = F.when(kind == 0, F.lit("google:okf:0.1")).when(kind == 1, F.lit("./schemas/a:b:c.json")).when(kind == 2, F.lit("C:\\schemas\\x.json")).otherwise(F.col("url"))
    return R.table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), ref.alias("ref"))


def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).select("file", S.classify_column(F.col("ref")).alias("kind"))


def refused_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.col("url").alias("ref"))
    return S.refused_by_hosts(pages.union(_refs(spark, sf_dir).where("ref NOT LIKE 'http%'")), ["Example.com", "localhost:8080"])


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("page_id") % 11 == 0, F.lit("node_modules/x/")).when(F.col("page_id") % 7 == 0, F.lit("docs/.hidden/")).otherwise(F.concat(F.lit("docs/"), (F.col("page_id") % 5).cast("string"), F.lit("/")))
    name = F.concat(folder, F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, F.lit(".MD")).otherwise(".html"))
    return R.table(spark, sf_dir, "pages").select(name.alias("file"))


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.filtered(_listing(spark, sf_dir), ["md", ".html"], ["docs/4/**"])


def kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = L.filtered(_listing(spark, sf_dir), ["md", ".html"])
    ignored = walked.where(F.col("file").startswith("docs/2/"))
    kept, taken = L.minus_ignored(walked, ignored)
    return kept.withColumn("kept", F.lit(True)).union(taken.withColumn("kept", F.lit(False)))


def united_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = L.filtered(_listing(spark, sf_dir), ["html"])
    named = _listing(spark, sf_dir).where(F.col("file").startswith("docs/1/"))
    return L.united(named, walked)


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.when(F.col("e.event_id") % 2 == 0, F.col("e.event_type"))
    printed = B.fingerprint(F.lit("google:okf:0.1"), F.concat(F.lit("/"), F.col("e.event_type")), F.lit("type"), subject)
    return R.table(spark, sf_dir, "events").alias("e").select("event_id", printed.alias("fingerprint"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the format tests the texts of dates and times pass; every third date has slashes."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = R.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.replace(day, F.lit("-"), F.lit("/"))).otherwise(day).alias("d"))
    stamp = F.concat("d", F.lit("T10:00:00Z"))
    found = [F.col("d").rlike(I.DATE).alias("is_date"), stamp.rlike(I.DATE_TIME).alias("is_stamp"), F.col("d").rlike(I.DATE_TIME).alias("date_is_stamp"), stamp.rlike(FORMATS["date-time"]).alias("good_stamp"), F.concat("d", F.lit("T25:00:00Z")).rlike(FORMATS["date-time"]).alias("bad_stamp")]
    return o.select("o_orderkey", *found)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return lines.select("l_returnflag", T.thousands(F.col("n")).alias("count"), T.percent(F.col("n") / F.lit(1000.0)).alias("percent"))


def fill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = S.resolve(X.extract(_pages(spark, sf_dir), keep=("content",)), S.Rules())
    provider = FI.MockProvider({"type": ("page", 0.4), "tags": (["a"], 0.8)})
    return FI.summary(FI.fill(resolved, Registry(), provider, list(DEFAULT_SET))).select("files", "changed", "written", "skipped", "required_skipped", "errors")


QUERIES = {
    "pointer_segments": pointer_segments,
    "vendor_names": vendor_names,
    "comma_lists": comma_lists,
    "reference_kinds": reference_kinds,
    "refused_hosts": refused_hosts,
    "listed_files": listed_files,
    "kept_files": kept_files,
    "united_files": united_files,
    "violation_prints": prints,
    "format_tests": formats,
    "report_cells": cells,
    "fill_summary": fill_counts,
}

_LISTING = """listing AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'node_modules/x/' WHEN page_id % 7 = 0 THEN 'docs/.hidden/' ELSE 'docs/' || (page_id % 5) || '/' END
  || page_id || CASE WHEN page_id % 3 = 0 THEN '.MD' ELSE '.html' END AS file FROM pages),
  seen AS (SELECT * FROM listing WHERE file NOT LIKE 'node_modules/%' AND file NOT LIKE '%/.%')"""

ORACLES = {
    "pointer_segments": """WITH k AS (SELECT p_partkey, replace(p_name, ' ', '/') || '~' || p_brand AS key FROM part)
        SELECT p_partkey, '/' || replace(replace(key, '~', '~0'), '/', '~1') || '/0' AS pointer, key AS top FROM k""",
    "vendor_names": """WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS n FROM pages)
        SELECT page_id, CASE WHEN lower(n) LIKE '%.json' THEN n ELSE n || '.json' END AS name FROM n""",
    "comma_lists": "SELECT c_custkey, trim(c_name) || '|' || c_mktsegment AS parts FROM customer",
    "reference_kinds": "SELECT page_id AS file, CASE page_id % 4 WHEN 0 THEN 'builtin' WHEN 3 THEN 'url' ELSE 'file' END AS kind FROM pages",
    "refused_hosts": "SELECT page_id AS file, url AS ref FROM pages WHERE lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)) <> 'example.com'",
    "listed_files": f"WITH {_LISTING} SELECT file FROM seen WHERE file NOT LIKE 'docs/4/%'",
    "kept_files": f"WITH {_LISTING} SELECT file, file NOT LIKE 'docs/2/%' AS kept FROM seen",
    "united_files": f"WITH {_LISTING} SELECT file FROM seen WHERE file LIKE '%.html' UNION SELECT file FROM listing WHERE file LIKE 'docs/1/%'",
    "violation_prints": """SELECT event_id, left(sha256('google:okf:0.1' || chr(0) || '/' || event_type || chr(0) || 'type' || chr(0) || CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END), 16) AS fingerprint FROM events""",
    "format_tests": "SELECT o_orderkey, o_orderkey % 3 <> 0 AS is_date, o_orderkey % 3 <> 0 AS is_stamp, false AS date_is_stamp, o_orderkey % 3 <> 0 AS good_stamp, false AS bad_stamp FROM orders",
    "report_cells": "SELECT l_returnflag, format('{:,}', count(*)) AS count, printf('%.1f%%', count(*) / 1000.0) AS percent FROM lineitem GROUP BY l_returnflag",
    "fill_summary": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (url NOT LIKE 'https://%') AS bare FROM pages)
        SELECT n AS files, n AS changed, n AS written, (bare + 3 * n)::BIGINT AS skipped, bare AS required_skipped, 0::BIGINT AS errors FROM c""",
}
