"""The registered queries: their columns, and those that SQL can express against DuckDB."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from metaloom.llm import queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_secret_scan": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op2_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op3_simhash": "doc_id:bigint fingerprint:string n_near:bigint component_id:bigint",
    "op4_license_scan": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
    "op5_best_fit_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op6_quality_rules": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op7_byte_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op8_spotsigs": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    "op9_substring_dedup": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    "op10_chat_format": "conv_id:bigint part:int n_turns:bigint n_collapsed:bigint rendered:string",
}


def test_all_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) and {*COLUMNS, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    found = [f"{c}:{t}" for c, t in queries.QUERIES[name](spark, SF).dtypes]
    want = COLUMNS[name].split()
    assert found[: len(want)] == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    got, want = (x[names].sort_values(names).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
