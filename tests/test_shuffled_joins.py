"""Sides that grow with the tables are joined by shuffle, however small Spark guesses them: they must not pass the driver."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def same_as_sql(df, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    return rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["join_band", "strip_unverified", "validate_numbers", "validation_rate", "relaxed_validation"])
def test_number_checks_broadcast_nothing(spark, name):
    df = entry.queries()[name](spark, SF)
    assert same_as_sql(df, name)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
