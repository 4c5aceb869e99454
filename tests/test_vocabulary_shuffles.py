"""Windows that are no term are dropped where the text lies; no list of tokens is shuffled."""

from cohortloom.operators import vocabulary


def test_only_hits_are_shuffled(spark):
    texts = spark.createDataFrame([(1, "no lung met . lung met here")], "id long, text string")
    terms = spark.createDataFrame([("lung met", "Met", "s"), ("lung", "Lung", "s")], "term string, canonical string, slot string")
    df = vocabulary.tag_vocabulary(texts, "id", "text", terms)
    assert [tuple(r) for r in df.collect()] == [(1, "Met", "s", 2, False)]
    hits = vocabulary.term_hits(texts, "id", "text", vocabulary.term_table(terms))
    assert {k: t for k, t in hits.dtypes} == {"id": "bigint", "start": "int", "size": "int", "negated": "boolean", "gram": "string"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "before" not in "".join(line for line in plan.splitlines() if "Exchange" in line or "Sort [" in line)
    assert "getbit" in df._jdf.queryExecution().optimizedPlan().toString()
