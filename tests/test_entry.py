"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from metaloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) == set(plans.ORACLE_SQL)
    has_llm = os.path.isdir(os.path.join(os.path.dirname(entry.__file__), "metaloom", "llm"))
    assert any(n.startswith("op1_") for n in entry.queries()) == has_llm


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sql, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), sql.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    got, want = (x[names].sort_values(names).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_titles_with_loose_references_equal_sql(spark, tmp_path):
    texts = ["a &amp", "b &amp;&amp", "c &lt;d&gt", "e &copy; f&nbsp g", "h &#39;&#39 &#x41;", "i &amp;lt; &amp;amp", "&ampj &LT;", "k & l", "&quot;m&quot"]
    frame = pd.DataFrame({"page_id": range(len(texts)), "html": [f"<html><head><title>{t}</title></head><body>&amp &copy</body></html>" for t in texts]})
    frame.to_parquet(tmp_path / "pages.parquet")
    got = entry.queries()["extract_html_title"](spark, str(tmp_path)).toPandas()
    pages = frame  # noqa: F841 (DuckDB reads it)
    want = duckdb.sql(plans.ORACLE_SQL["extract_html_title"]).df()
    pd.testing.assert_frame_equal(got.sort_values("file").reset_index(drop=True), want.sort_values("file").reset_index(drop=True), check_dtype=False)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [(r["schema"], r["keyword"], r["subject"]) for r in rows] == [("google:okf:0.1", "required", "type")] and rows[0]["n"] == 17
