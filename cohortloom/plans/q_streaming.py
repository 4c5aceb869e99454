"""Streaming queries run to completion over the given tables, and their batch twins (L1-L3); SQL functions and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import hooks, ids, sql
from cohortloom.operators import retrieval as r
from cohortloom.plans import sqlkit as k
from cohortloom.plans.registry import query
from cohortloom.sources.files import scratch_path
from cohortloom.streaming import jobs
from cohortloom.streaming.log import StateLog

_KIND_SQL = "case c_mktsegment when 'BUILDING' then 'view' when 'AUTOMOBILE' then 'click' when 'MACHINERY' then 'purchase' when 'HOUSEHOLD' then 'signup' else 'error' end"
ALERT_SQL = f"""al as (select {_KIND_SQL} as event_type, count(*) as alerts from customer group by 1),
    ct as (select date_trunc('day', ts) as window_start, event_type, count(*) as items, max(ts) as newest from events group by 1, 2)"""


def _alerts(b):
    seg = F.col("c_mktsegment")
    kind = F.when(seg == "BUILDING", "view").when(seg == "AUTOMOBILE", "click").when(seg == "MACHINERY", "purchase").when(seg == "HOUSEHOLD", "signup").otherwise("error")
    return b.customer.select(F.col("c_custkey").alias("alert_id"), kind.alias("event_type"))


@query(
    "stream_alerts",
    f"WITH {ALERT_SQL} select cast(window_start as timestamp) as window_start, event_type, items, newest, alerts from ct join al using (event_type) where window_start + interval 1 day <= (select max(ts) from events) - interval 1 hour",
)
def _stream_alerts(b):
    """Closed windows only: a window is written once the watermark has passed its end.

    Files of the table may overlap in time, so they are one batch: none is late for another.
    """
    stream = jobs.read_file_stream(b.spark, b.sf_dir, "events", None)
    out = scratch_path(b.spark, "alerts")
    jobs.run_to_parquet(jobs.alert_windows(stream, _alerts(b), "ts", "event_type"), f"{out}/rows", f"{out}/checkpoint")
    return b.spark.read.parquet(f"{out}/rows").select("window_start", "event_type", "items", "newest", "alerts")


@query("batch_alerts", f"WITH {ALERT_SQL} select cast(window_start as timestamp) as window_start, event_type, items, newest, alerts from ct join al using (event_type)")
def _batch_alerts(b):
    return jobs.alert_windows(b.events, _alerts(b), "ts", "event_type").select("window_start", "event_type", "items", "newest", "alerts")


INGEST_SQL = """inc as (select cast(doc_id as varchar) as document_id, sha256(text) as content_hash from documents),
    cur as (select cast(doc_id as varchar) as document_id, sha256(case when lang = 'de' then text || ' v1' else text end) as content_hash from documents where doc_id in (select doc_id from labels))"""


@query(
    "stream_ingest",
    f"""WITH {INGEST_SQL} select c.document_id, c.content_hash, c.content_hash = i.content_hash as is_current, c.content_hash <> i.content_hash as superseded from cur c join inc i using (document_id)
    union all select document_id, content_hash, true, false from inc where not exists (select 1 from cur where cur.document_id = inc.document_id and cur.content_hash = inc.content_hash)""",
)
def _stream_ingest(b):
    root = scratch_path(b.spark, "ingest")
    log = StateLog(b.spark, f"{root}/log", ["document_id", "content_hash"], jobs.VERSION_SCHEMA)
    known = b.documents.join(b.labels.select("doc_id").distinct(), "doc_id", "left_semi")
    stored = F.when(F.col("lang") == "de", F.concat("text", F.lit(" v1"))).otherwise(F.col("text"))
    seed = known.select(
        F.col("doc_id").cast("string").alias("document_id"), ids.content_hash(stored).alias("content_hash"), F.lit(True).alias("is_current"), F.lit(None).cast("string").alias("superseded_by")
    )
    log.write(seed, -1)
    stream = jobs.read_file_stream(b.spark, b.sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), ids.content_hash(F.col("text")).alias("content_hash"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id"), F.lit(3600))).alias("fetched_at"),
    )
    jobs.ingest_documents(stream, log, f"{root}/checkpoint", "fetched_at")
    return log.read().select("document_id", "content_hash", "is_current", F.col("superseded_by").isNotNull().alias("superseded"))


@query(
    "stream_state",
    "select user_id, event_type, ts as at, event_id as id, value, cast(row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as int) as rank from events qualify rank <= 2",
)
def _stream_state(b):
    root = scratch_path(b.spark, "state")
    keys = [T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())]
    log = StateLog(b.spark, f"{root}/log", ["user_id", "event_type", "rank"], jobs.latest_two_schema(keys, T.DoubleType()))
    log.write(b.spark.createDataFrame([], log.schema), -1)
    stream = jobs.read_file_stream(b.spark, b.sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("at"), F.col("event_id").alias("id"), "value")
    jobs.maintain_latest(stream, log, ["user_id", "event_type"], f"{root}/checkpoint")
    return log.read().select("user_id", "event_type", "at", "id", "value", "rank")


@query(
    "sql_functions",
    f"select study_id, {k.percent('overall_survival')} as pct, {k.months('median_followup')} as months, {k.phase('study_phase')} as phase from studies",
    "studies",
)
def _sql(b):
    sql.register(b.spark)
    return b.spark.sql(
        "select study_id, extract_percent(overall_survival) as pct, extract_months(median_followup) as months, normalize_phase(study_phase) as phase from {s}", s=b.studies
    )


@query(
    "sql_normalisers",
    f"""WITH t as (select detail_id, study_id, {k.technique('technique')} as technique, {k.gy('total_dose')} as gy, {k.fractions('total_dose')} as fx from details)
    select detail_id, technique, gy, fx, {k.disease('s.cancer_type')} as cancer_type from t join studies s using (study_id)""",
    "studies details",
)
def _sql_normalisers(b):
    sql.register(b.spark)
    return b.spark.sql(
        "select detail_id, normalize_technique(technique) as technique, extract_gy(total_dose) as gy, extract_fractions(total_dose) as fx, normalize_cancer_type(s.cancer_type) as cancer_type from {d} d join {s} s using (study_id)",
        d=b.details, s=b.studies,
    )


@query("hashed_search")
def _hashed(b):
    """Benchmark items as queries against all documents, both embedded by the default hook."""
    queries = b.benchmark.select(F.col("item_id").alias("query_id"), hooks.hashed_vector(F.col("text")).alias("query_vector"))
    corpus = b.documents.select("doc_id", hooks.hashed_vector(F.col("text")).alias("vector"))
    return r.knn_cosine(corpus, queries, 10, "doc_id", "vector")
