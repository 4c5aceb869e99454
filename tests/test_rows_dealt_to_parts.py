"""Rows of one value, of no key, or of a large table are dealt to parts, so that no task holds a share that grows with the table."""

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import joins, summarize
from cohortloom.plans import q_quality, q_retrieval
from cohortloom.plans.registry import Bed
from cohortloom.sources import scan

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _largest(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_rows_of_one_value_go_to_several_tasks(plain):
    rows = plain.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 > 0, "imrt").alias("v"))
    out = summarize.by_distinct_value(rows, "k", "v", F.upper, "u")
    assert sorted(map(tuple, out.collect())) == [(i, "imrt" if i % 10 else None, "IMRT" if i % 10 else None) for i in range(1000)]
    assert _largest(out) < 600


def test_rows_without_a_key_go_to_several_tasks(plain):
    ask = plain.range(1000).select("id", F.when(F.col("id") < 50, F.col("id")).alias("a"), F.when(F.col("id") > 900, F.col("id")).alias("b"))
    facts = plain.range(2000).select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("n"), (F.col("id") * 2).alias("twice"))
    out = joins.enrich_by_priority(ask, facts, ["a", "b"], "n", ["twice"])
    assert out.columns == ["id", "a", "b", "matched_by", "twice"]
    want = [(i, "a" if i < 50 else "b" if i > 900 else None, 2 * i if i < 50 or i > 900 else None) for i in range(1000)]
    assert sorted((r["id"], r["matched_by"], r["twice"]) for r in out.collect()) == want
    assert _largest(out) < 600


def test_parts_follow_the_rows_of_the_table(spark, monkeypatch):
    b = Bed(spark, SF)
    monkeypatch.setattr(scan, "ROWS_A_PART", 100)
    assert q_retrieval._pool(b).rdd.getNumPartitions() == -(-b.lineitem.count() // 100)


def test_findings_are_not_counted_in_the_scan(spark):
    plan = q_quality._consensus(Bed(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression [query_id") < plan.index("Generate ")
    assert plan.rindex("Aggregate [") < plan.index("RepartitionByExpression [query_id")
