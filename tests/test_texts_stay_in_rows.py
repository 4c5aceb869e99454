"""what is worked out from texts leaves their rows as numbers; texts and their tokens are not shuffled for joins."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def dealt_columns(plan):
    """The columns that the exchanges of a plan deal out by a key."""
    own = [plan.output().apply(i).name() for i in range(plan.output().size())] if "hashpartitioning" in plan.outputPartitioning().toString() and "Exchange" in plan.nodeName() else []
    return own + [c for i in range(plan.children().size()) for c in dealt_columns(plan.children().apply(i))]


@pytest.mark.parametrize("name", ["hybrid_alpha", "bm25_pool", "bm25_floor", "keyword_density", "hybrid_overlap"])
def test_no_text_is_shuffled(spark, name):
    # The tables of this size are small to Spark; under this threshold only what is really small is broadcast.
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "60k"}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert not {"text", "toks", "query_text"} & set(dealt_columns(plan))
