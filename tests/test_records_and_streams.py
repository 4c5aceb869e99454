import datetime as dt
import os
import random
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.operators import quality, records
from cohortloom.sources import files, html
from cohortloom.streaming import jobs
from cohortloom.streaming.log import StateLog


def day(n, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def test_latest_and_change_rules(spark):
    rows = [
        (1, "w", 1, day(0), 80.0), (1, "w", 2, day(20), 72.0), (1, "w", 3, None, 1.0),
        (2, "w", 4, day(5), 50.0), (3, "w", 5, day(0), 0.0), (3, "w", 6, day(10), 9.0),
    ]
    df = spark.createDataFrame(rows, "p int, k string, id int, at timestamp, v double")
    pair = {r["p"]: (r["latest"], r["previous"]) for r in records.latest_previous(df, ["p", "k"], "at", "id", "v").collect()}
    assert pair == {1: (72.0, 80.0), 2: (50.0, None), 3: (9.0, 0.0)}
    change = {r["p"]: r["change_30d"] for r in records.change_windows(df, ["p", "k"], "at", "id", "v", "2024-01-25 00:00:00").collect()}
    assert change == {1: -10.0, 2: None, 3: None}
    assert spark.range(1).select(records.risk_label(F.lit(-10.0)).alias("x")).first()["x"] == "high"


def test_versions_insert_skip_supersede_restore(spark):
    current = spark.createDataFrame(
        [("a", "h1", True, None), ("b", "h1", True, None), ("c", "h1", False, "v2"), ("c", "h2", True, None), ("d", "h9", True, None)],
        "document_id string, content_hash string, is_current boolean, superseded_by string",
    )
    incoming = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h1"), ("e", "h1")], "document_id string, content_hash string")
    out = {(r["document_id"], r["content_hash"]): (r["is_current"], r["action"]) for r in records.versioned_merge(current, incoming).collect()}
    assert out == {
        ("a", "h1"): (True, "skipped"), ("b", "h1"): (False, "superseded"), ("b", "h2"): (True, "inserted"), ("c", "h1"): (True, "restored"),
        ("c", "h2"): (False, "superseded"), ("d", "h9"): (True, "unchanged"), ("e", "h1"): (True, "inserted"),
    }


def test_alert_stream_counts_closed_windows_and_drops_late_rows(spark, tmp_path):
    root = tmp_path / "in"
    schema = "id bigint, ts timestamp, kind string"
    parts = [[(1, day(0, 1), "x"), (2, day(0, 2), "x")], [(3, day(3), "x")], [(6, day(4), "x")], [(4, day(0, 3), "x"), (5, day(6), "x")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/tmp{i}")
        part = next((root / f"tmp{i}").glob("*.parquet"))
        part.rename(root / f"events{i}.parquet")
    for i in range(4):  # the stream reads files in order of their time stamp
        os.utime(root / f"events{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(str(root))
    alerts = spark.createDataFrame([(1, "x"), (2, "x")], "alert_id int, kind string")
    query = jobs.run_to_parquet(jobs.alert_windows(stream, alerts, "ts", "kind"), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = {r["window_start"].day: (r["items"], r["alerts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {1: (2, 2), 4: (1, 2), 5: (1, 2)}
    assert jobs.dropped_late_rows(query) >= 1


def test_state_log_survives_replay(spark, tmp_path):
    keys = [T.StructField("k", T.StringType())]
    log = StateLog(spark, str(tmp_path / uuid.uuid4().hex), ["k", "rank"], jobs.latest_two_schema(keys, T.DoubleType()))
    log.write(spark.createDataFrame([], log.schema), -1)
    first = spark.createDataFrame([("a", 1, day(0), 1, 5.0)], log.schema)
    log.write(first, 0)
    log.write(first, 0)  # the same batch again after a lost driver
    log.write(spark.createDataFrame([("a", 1, day(1), 2, 6.0), ("a", 2, day(0), 1, 5.0)], log.schema), 1)
    assert {(r["rank"], r["value"]) for r in log.read().collect()} == {(1, 6.0), (2, 5.0)}
    assert {(r["rank"], r["value"]) for r in log.read(before=1).collect()} == {(1, 5.0)}


def test_strip_touches_only_the_first_place(spark):
    row = spark.range(1).select(quality.strip_unverified(F.lit("50 Gy then 50 Gy, 9%"), F.array(F.lit("50 Gy"), F.lit("9%"), F.lit("7%"))).alias("x")).first()
    assert row["x"] == "[unverified] then 50 Gy, [unverified]"


def test_band_join_equals_brute_force(spark):
    rng = random.Random(5)
    left = [(i, rng.randrange(3), round(rng.uniform(0, 30), 2)) for i in range(80)]
    right = [(rng.randrange(3), round(rng.uniform(0, 30), 2)) for _ in range(60)]
    out = quality.band_join(spark.createDataFrame(left, "id int, g int, v double"), spark.createDataFrame(right, "g int, v double"), ["g"], "v", 1.0)
    got = {r["id"]: None if r["gap"] is None else round(r["gap"], 6) for r in out.collect()}
    for i, g, v in left:
        gaps = [abs(x - v) for h, x in right if h == g and abs(x - v) <= 1.0]
        assert got[i] == (round(min(gaps), 6) if gaps else None)


def test_html_sections():
    page = """<html><head><title>T</title></head><body><nav><p>menu</p></nav><article><h2>One</h2><p>alpha<p>beta
    <ul><li>x<li>y</ul><table><tr><td>a</td><td>b</td></tr></table><div class="ad-box"><p>ad</p></div><h3>Two</h3><p>""" + "w " * 150 + "</p></article></body></html>"
    title, sections = html.page_sections(page)
    assert title == "T" and [s[:2] for s in sections] == [(2, "One"), (3, "Two")]
    assert sections[0][2] == "alpha\nbeta\n- x\n- y\na | b"


def test_processed_folders_skip_what_cannot_be_read(spark, tmp_path):
    for cat, doc, body in (("lung", "d1", '{"paragraphs": [{"id": 1, "text": "x"}]}'), ("lung", "d2", "{broken"), ("brain", "d3", None)):
        folder = tmp_path / "docs" / cat / doc
        folder.mkdir(parents=True)
        if body:
            (folder / f"{doc}_document_index.json").write_text(body)
    out = files.read_processed_docs(spark, str(tmp_path / "docs"), "paragraphs array<struct<id:int,text:string>>").collect()
    assert [(r["category"], r["doc_dir"]) for r in out] == [("lung", "d1")]


def test_jsonl_drops_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r["a"] for r in rows.collect()) == [1, 2]
