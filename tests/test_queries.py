"""Queries against their DuckDB SQL on the smallest data; COHORTLOOM_ALL=1 checks every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "agg_metric_avg", "detail_summary", "meta_fixed_effect", "rate_forest", "preference_filter", "hard_soft_filter", "conflict_filter",
    "join_two_children", "join_priority_keys", "tiered_lookup", "upsert_merge", "versioned_merge", "pct_change_windows",
    "state_snapshot", "content_dedup", "section_windows", "number_paragraphs", "overview_chunk", "section_align", "knn_cosine",
    "bm25_pool", "dedup_caps", "lane_merge", "interleave", "structured_match", "profile_overlap", "eligibility_fallback",
    "contradiction_pairs", "consensus", "validate_numbers", "relaxed_validation", "slot_routing", "frame_build", "sql_functions",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("COHORTLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
