"""Patterns of statements are read once per text, not once per statement found."""

from pyspark.sql import functions as F

from cohortloom.operators import extractors


def test_frame_profile_scans_its_chunks_twice_at_most(spark):
    rows = [(1, 10, 1, "2-year OS: 50%. cisplatin, ER+ "), (1, 11, 2, "2-year OS 60%, OS: 40%. OS 41%"), (2, 12, 1, "nothing")]
    chunks = spark.createDataFrame(rows, "doc int, chunk int, at int, text string")
    df = extractors.frame_profile(chunks, "doc", "chunk", "at", "text")
    got = df.first()
    assert (df.count(), dict(got["outcomes"]), got["agents"], got["markers"], got["evidence_ids"]) == (1, {"2yr_OS": "60%", "OS": "41%"}, ["cisplatin"], ["ER+"], [10, 11])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2


def test_outcome_map_reads_its_patterns_once(spark):
    df = spark.createDataFrame([("OS 40%, OS: 41%",)], "text string").select(extractors.outcome_map(F.col("text")).alias("m"))
    assert df.first()["m"] == {"OS": "41%"}
    assert df._jdf.queryExecution().analyzed().toString().count("pCR|pathologic") <= 2
