"""Join, set, de-duplication and record queries (A5-A12, C, E1-E3, E12, E13, H, I9-I16, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import ids, rules
from cohortloom.operators import dedupe, joins, records
from cohortloom.plans import sqlkit as k
from cohortloom.plans.registry import query
from cohortloom.session import rule_table

NOW = "2024-01-31 00:00:00"


# ---- joins -------------------------------------------------------------------------------------


@query(
    "join_inner",
    """select n_name, c_mktsegment, count(*) as orders_n, cast(sum(cast(o_totalprice as decimal(28,6))) as double) as total
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""",
)
def _join_inner(b):
    return (
        b.orders.join(b.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(b.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "c_mktsegment")
        .agg(F.count(F.lit(1)).alias("orders_n"), F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("double").alias("total"))
    )


@query(
    "join_left_chain",
    """select distinct s.study_id, s.number_of_patients, c.label, d.code from studies s
      left join (values ('breast carcinoma', 'Breast'), ('nsclc', 'Lung'), ('thymoma', 'Thymus')) c(name, label) on lower(s.cancer_type) = c.name
      left join (values ('Breast', 'C50'), ('Lung', 'C34')) d(label, code) on c.label = d.label""",
    "studies",
)
def _left_chain(b):
    types = rule_table(b.spark, [("breast carcinoma", "Breast"), ("nsclc", "Lung"), ("thymoma", "Thymus")], "name string, label string")
    codes = rule_table(b.spark, [("Breast", "C50"), ("Lung", "C34")], "label string, code string")
    return (
        b.studies.select("study_id", "number_of_patients", F.lower("cancer_type").alias("name"))
        .join(types, "name", "left")
        .join(codes, "label", "left")
        .select("study_id", "number_of_patients", "label", "code")
        .distinct()
    )


@query(
    "join_two_children",
    """select s.study_id, coalesce(i.v, '') as stages, coalesce(x.v, '') as techniques from studies s
    left join (select study_id, array_to_string(list_sort(list(distinct stage_category)), ';') as v from stages group by 1) i using (study_id)
    left join (select study_id, array_to_string(list_sort(list(distinct technique)), ';') as v from details where technique is not null group by 1) x using (study_id)""",
    "studies stages details",
)
def _two_children(b):
    out = joins.collapse_children(
        b.studies.select("study_id"), "study_id",
        [(b.stages, "stage_category", "stages"), (b.details, "technique", "techniques")],
    )
    return out.select("study_id", F.array_join("stages", ";").alias("stages"), F.array_join("techniques", ";").alias("techniques"))


@query("join_semi", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 45)")
def _semi(b):
    wanted = b.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select(F.col("l_orderkey").alias("o_orderkey"))
    return b.orders.join(wanted, "o_orderkey", "left_semi").select("o_orderkey")


@query("join_anti", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '2000-01-01')")
def _anti(b):
    recent = b.orders.filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp"))
    return b.customer.join(recent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    "coverage_diff",
    """select case when l is not null and r is not null then 'both' when l is not null then 'left_only' else 'right_only' end as side, count(*) as n
    from (select distinct doc_id as l from documents) full outer join (select distinct doc_id as r from labels) on l = r group by 1""",
)
def _coverage(b):
    return joins.coverage(b.documents, b.labels, "doc_id")


@query(
    "join_priority_keys",
    """WITH f as (select 'study_' || study_id as doc_id, case when pub_year > 1996 then doi end as doi, pmid, citation_count, study_id from studies where status <> 'F' or pub_year > 1998),
    a as (select study_id, case when status = 'O' then doc_id end as doc_id, doi, pmid from studies),
    d1 as (select doc_id, arg_min(citation_count, study_id) as c from f where doc_id is not null group by 1),
    d2 as (select doi, arg_min(citation_count, study_id) as c from f where doi is not null group by 1),
    d3 as (select pmid, arg_min(citation_count, study_id) as c from f where pmid is not null group by 1)
    select a.*, case when d1.doc_id is not null then 'doc_id' when d2.doi is not null then 'doi' when d3.pmid is not null then 'pmid' end as matched_by,
      case when d1.doc_id is not null then d1.c when d2.doi is not null then d2.c when d3.pmid is not null then d3.c end as citation_count
    from a left join d1 on a.doc_id = d1.doc_id left join d2 on a.doi = d2.doi left join d3 on a.pmid = d3.pmid""",
    "studies",
)
def _priority_keys(b):
    s = b.studies
    facts = s.filter((F.col("status") != "F") | (F.col("pub_year") > 1998)).select(
        "study_id", "doc_id", F.when(F.col("pub_year") > 1996, F.col("doi")).alias("doi"), "pmid", "citation_count"
    )
    ask = s.select("study_id", F.when(F.col("status") == "O", F.col("doc_id")).alias("doc_id"), "doi", "pmid")
    return joins.enrich_by_priority(ask, facts, ["doc_id", "doi", "pmid"], "study_id", ["citation_count"])


@query(
    "staged_match",
    """WITH t as (select study_id, doi, lower(document_name) as title from studies where status = 'F'),
    a as (select 'a' || study_id as abstract_id, case when pub_year > 1997 then doi end as doi, lower(document_name) as title from studies),
    d1 as (select doi, min(study_id) as sid from t where doi is not null group by 1), d2 as (select title, min(study_id) as sid from t group by 1)
    select a.*, case when d1.doi is not null then 'doi' when d2.title is not null then 'title' end as matched_by,
      case when d1.doi is not null then d1.sid when d2.title is not null then d2.sid end as study_id
    from a left join d1 on a.doi = d1.doi left join d2 on a.title = d2.title""",
    "studies",
)
def _staged(b):
    s = b.studies
    target = s.filter(F.col("status") == "F").select("study_id", "doi", F.lower("document_name").alias("title"))
    ask = s.select(
        F.concat(F.lit("a"), F.col("study_id").cast("string")).alias("abstract_id"),
        F.when(F.col("pub_year") > 1997, F.col("doi")).alias("doi"), F.lower("document_name").alias("title"),
    )
    return joins.enrich_by_priority(ask, target, ["doi", "title"], "study_id", ["study_id"])


@query(
    "backfill_ids",
    """WITH t as (select part_id, doc_id from (select l_partkey as part_id, case when p_size > 10 then null else cast(p_partkey as varchar) end as doc_id, row_number() over (partition by l_partkey order by l_orderkey) as r from lineitem join part on l_partkey = p_partkey) where r = 1),
    m as (select l_partkey as part_id, arg_min(cast(l_orderkey as varchar), l_orderkey) as v from lineitem where l_returnflag = 'A' group by 1)
    select t.part_id, coalesce(t.doc_id, m.v) as doc_id from t left join m using (part_id)""",
)
def _backfill(b):
    used = b.lineitem.select(F.col("l_partkey").alias("part_id")).distinct()
    parts = b.part.select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_size") > 10, None).otherwise(F.col("p_partkey").cast("string")).alias("doc_id"))
    mapping = b.lineitem.filter(F.col("l_returnflag") == "A").select(
        F.col("l_partkey").alias("part_id"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_orderkey").alias("pos")
    )
    return joins.backfill(used.join(parts, "part_id"), mapping, "part_id", "doc_id", "pos")


@query(
    "upsert_merge",
    """WITH u as (select o_custkey as k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as balance, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as segment from orders where o_orderstatus = 'F' group by 1),
    t as (select c_custkey as k, c_acctbal as balance, c_mktsegment as segment from customer where c_nationkey < 20)
    select coalesce(u.k, t.k) as k, case when u.k is not null then u.balance else t.balance end as balance, case when u.k is not null then u.segment else t.segment end as segment,
      case when t.k is null then 'inserted' when u.k is null then 'kept' else 'updated' end as action from t full outer join u on t.k = u.k""",
)
def _upsert(b):
    target = b.customer.filter(F.col("c_nationkey") < 20).select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    updates = b.orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("balance"), F.col("o_orderpriority").alias("segment"), "o_orderdate", "o_orderkey"
    )
    return joins.upsert(target, updates, "k", F.struct("o_orderdate", "o_orderkey"), ["balance", "segment"])


@query(
    "upsert_array_union",
    """WITH t as (select c_nationkey as code, list(distinct c_mktsegment) as v from customer where c_acctbal > 9000 group by 1),
    u as (select s_nationkey as code, list(distinct case when s_acctbal > 5000 then 'BUILDING' else 'SUPPLY' end) as v from supplier group by 1)
    select coalesce(t.code, u.code) as code, array_to_string(list_sort(list_distinct(coalesce(t.v, []) || coalesce(u.v, []))), ',') as terms from t full outer join u on t.code = u.code""",
)
def _array_union(b):
    target = joins.distinct_values(b.customer.filter(F.col("c_acctbal") > 9000).withColumnRenamed("c_nationkey", "code"), "code", "c_mktsegment", "terms")
    kind = F.when(F.col("s_acctbal") > 5000, "BUILDING").otherwise("SUPPLY")
    updates = joins.distinct_values(b.supplier.select(F.col("s_nationkey").alias("code"), kind.alias("kind")), "code", "kind", "terms")
    return joins.merge_arrays(target, updates, "code", "terms").select("code", F.array_join("terms", ",").alias("terms"))


@query(
    "upsert_stats",
    """select source, count_if(doc_id in (select vec_id from embeddings)) as stored, count_if(doc_id not in (select vec_id from embeddings)) as failed from documents group by 1""",
)
def _upsert_stats(b):
    rows = b.documents.select("doc_id", "source").join(b.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return joins.upsert_stats(rows, "embedding", "source")


@query(
    "embedding_stats",
    """select count(*) as total, count(embedding) as embedded, count(embedding) / count(*) as coverage, array_to_string(list_sort(list(distinct cast(len(embedding) as varchar)) filter (embedding is not null)), ',') as dims,
      count(distinct label) as models from documents left join embeddings on doc_id = vec_id""",
)
def _embedding_stats(b):
    rows = b.documents.select("doc_id").join(b.embeddings, F.col("doc_id") == F.col("vec_id"), "left")
    return joins.embedding_stats(rows, "embedding", "label")


# Terms and their canonical names.
ALIASES = [("breast", "Breast"), ("nsclc", "Lung"), ("non-small cell lung", "Lung"), ("prostate", "Prostate"), ("invasive breast", "Breast"),
           ("rectal", "Rectum"), ("colorectal", "Colon"), ("hodgkin lymphoma", "Lymphoma")]
_ALIAS_SQL = ", ".join(f"({k.q(a)}, {k.q(c)})" for a, c in ALIASES)


@query(
    "canonical_join",
    f"""WITH v as (select * from (values {_ALIAS_SQL}) v(alias, canonical)), s as (select study_id, cancer_type, lower(trim(cancer_type)) as k from studies)
    select study_id, cancer_type, coalesce(v1.canonical, v2.canonical, cancer_type) as canonical from s left join v v1 on v1.alias = k
    left join v v2 on v2.alias = regexp_replace(k, ' (cancer|carcinoma|tumors?)$', '')""",
    "studies",
)
def _canonical(b):
    table = b.spark.createDataFrame(ALIASES, "alias string, canonical string")
    return joins.canonical_join(b.studies.select("study_id", "cancer_type"), table, "cancer_type")


# An anatomic stage table in lookup order.
STAGE_TABLE = [("t1", "n0", "m0", "I", 0), ("t2", "n0", "m0", "IIA", 1), ("t1", "n1", "m0", "IIB", 2), ("any", "n1", "m0", "III", 3),
               ("any", "any", "m1", "IV", 4), ("t3a", "n0", "m0", "IIIB", 5)]


@query(
    "tiered_lookup",
    f"""WITH lt(t, n, m, stage, ord) as (values {', '.join(f"('{a}', '{b_}', '{c}', '{d}', {e})" for a, b_, c, d, e in STAGE_TABLE)}),
    i as (select note_id, lower(regexp_extract(text, '(T\\d)N', 1)) as t, lower(regexp_extract(text, '(N\\d)M', 1)) as n, lower(regexp_extract(text, '(M\\d)\\.', 1)) as m from notes),
    x as (select i.*, l.stage, l.ord, case when l.t = i.t and l.n = i.n and l.m = i.m then 1.0 when l.t in ('any', i.t) and l.n in ('any', i.n) and l.m in ('any', i.m) then 0.8 else 0.6 end as confidence
      from i join lt l on (l.t = 'any' or regexp_replace(l.t, '[a-d]$', '') = regexp_replace(i.t, '[a-d]$', ''))
       and (l.n = 'any' or regexp_replace(l.n, '[a-c]$|mi$', '') = regexp_replace(i.n, '[a-c]$|mi$', '')) and (l.m = 'any' or regexp_replace(l.m, '[a-c]$', '') = regexp_replace(i.m, '[a-c]$', ''))),
    bst as (select note_id, max(confidence) as confidence, arg_min(stage, (-confidence, ord)) as stage from x group by 1)
    select i.note_id, i.t, i.n, i.m, stage, cast(coalesce(confidence, 0.0) as double) as confidence from i left join bst using (note_id)""",
    "notes",
)
def _tiered(b):
    table = b.spark.createDataFrame(STAGE_TABLE, "t string, n string, m string, stage string, ord int")
    tnm = b.notes.select(
        "note_id",
        F.regexp_extract("text", r"(T\d)N", 1).alias("t"),
        F.regexp_extract("text", r"(N\d)M", 1).alias("n"),
        F.regexp_extract("text", r"(M\d)\.", 1).alias("m"),
    )
    return joins.tiered_lookup(tnm, table, "note_id")


@query(
    "alert_match",
    """WITH a as (select c_custkey as alert_id, c_mktsegment as type, case when c_nationkey < 8 then 'daily' when c_nationkey < 16 then 'weekly' else 'monthly' end as frequency from customer),
    s as (select study_id, segment as type, created_at, date_diff('day', cast(created_at as date), date '2000-06-30') as age from studies),
    c as (select type, d as days, count(*) as matches, arg_max(study_id, (created_at, study_id)) as newest from s, (values (1), (7), (30)) w(d) where age >= 0 and age <= d group by 1, 2)
    select alert_id, a.type, frequency, coalesce(matches, 0) as matches, newest from a left join c on a.type = c.type
      and c.days = case frequency when 'daily' then 1 when 'monthly' then 30 else 7 end""",
    "studies",
)
def _alerts(b):
    frequency = F.when(F.col("c_nationkey") < 8, "daily").when(F.col("c_nationkey") < 16, "weekly").otherwise("monthly")
    alerts = b.customer.select(F.col("c_custkey").alias("alert_id"), F.col("c_mktsegment").alias("type"), frequency.alias("frequency"))
    studies = b.studies.select("study_id", F.col("segment").alias("type"), "created_at")
    return joins.alert_counts(alerts, studies, "2000-06-30")


# ---- sources as scans --------------------------------------------------------------------------


@query("scan_project", "select doc_id, lang, source, n_chars from documents where lang in ('en', 'de')")
def _scan(b):
    return b.documents.filter(F.col("lang").isin("en", "de")).select("doc_id", "lang", "source", "n_chars")


_URL_PATH = "regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g')"
_URL_SQL = f"""u as (select page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) as scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host, {_URL_PATH} as path,
      array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' and not list_contains([{', '.join(k.q(t) for t in ids.TRACKING_PARAMS)}], lower(split_part(p, '=', 1)))), '&') as tail from pages),
    nu as (select page_id, url, scheme || '://' || host || case when path = '' then '/' when path <> '/' then regexp_replace(path, '/$', '') else path end || case when tail <> '' then '?' || tail else '' end as clean from u)"""


@query("url_normalise", f"WITH {_URL_SQL} select page_id, clean from nu")
def _url_normalise(b):
    return b.pages.select("page_id", ids.normalize_url(F.col("url")).alias("clean"))


_BUCKET_SQL = "coalesce(" + ", ".join(f"case when regexp_matches(lower(clean), {k.q(p)}) then {k.q(n)} end" for n, p in ids.BUCKET_PATTERNS) + ", 'general')"
_IMPORTANCE_SQL = """(case when contains(clean, '/en') then 5.0 else 0.0 end) + (case when bucket <> 'general' then 3.0 else 0.0 end)
  + (case when bucket in ('treatment', 'side_effects', 'nutrition_lifestyle', 'supportive_care') then 1.0 else 0.0 end)
  + (case when len(list_filter(string_split(regexp_extract(clean, '^[a-z]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')) between 2 and 6 then 1.0 else 0.0 end)
  + (case when lower(clean) like '%.pdf' then 0.25 else 0.0 end)"""


@query(
    "url_bucket",
    f"WITH {_URL_SQL}, bk as (select page_id, clean, {_BUCKET_SQL} as bucket from nu) select page_id, bucket, cast({_IMPORTANCE_SQL} as double) as importance from bk",
)
def _url_bucket(b):
    clean = b.pages.select("page_id", ids.normalize_url(F.col("url")).alias("clean"))
    withb = clean.withColumn("bucket", ids.url_bucket(F.col("clean")))
    return withb.select("page_id", "bucket", ids.url_importance(F.col("clean"), F.col("bucket"), F.col("clean").contains("/en")).alias("importance"))


@query(
    "url_manifest",
    f"""WITH {_URL_SQL}, g as (select clean, count(*) as copies, min(page_id) as first_page from nu where regexp_extract(clean, '://([^/?#]*)', 1) like '%.example.org' and not regexp_matches(clean, '\\.(jpg|png|css|js|zip)$') group by 1),
    bk as (select *, {_BUCKET_SQL} as bucket from g) select clean, copies, first_page, bucket, cast({_IMPORTANCE_SQL} as double) as importance from bk""",
)
def _manifest(b):
    clean = b.pages.select("page_id", ids.normalize_url(F.col("url")).alias("clean"))
    host = F.regexp_extract("clean", r"://([^/?#]*)", 1)
    scoped = clean.filter(host.endswith(".example.org") & ~F.col("clean").rlike(r"\.(jpg|png|css|js|zip)$"))
    grouped = scoped.groupBy("clean").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first_page"))
    withb = grouped.withColumn("bucket", ids.url_bucket(F.col("clean")))
    return withb.withColumn("importance", ids.url_importance(F.col("clean"), F.col("bucket"), F.col("clean").contains("/en")))


@query(
    "manifest_order",
    f"""WITH {_URL_SQL}, g as (select clean, count(*) as copies from nu where clean is not null group by 1), bk as (select *, {_BUCKET_SQL} as bucket from g),
    m as (select regexp_extract(clean, '://([^/?#]*)', 1) as source, clean, copies, cast({_IMPORTANCE_SQL} as double) as importance from bk)
    select source, row_number() over (partition by source order by importance desc, clean) as place, clean, importance from m order by source, place""",
)
def _manifest_order(b):
    grouped = b.pages.select(ids.normalize_url(F.col("url")).alias("clean")).where("clean is not null").distinct()
    withb = grouped.withColumn("bucket", ids.url_bucket(F.col("clean")))
    scored = withb.select(F.regexp_extract("clean", r"://([^/?#]*)", 1).alias("source"), "clean", ids.url_importance(F.col("clean"), F.col("bucket"), F.col("clean").contains("/en")).alias("importance"))
    return joins.manifest_order(scored, "source", "importance", "clean")


@query(
    "coverage_gaps",
    """WITH have as (select distinct source, lang from documents), need(lang) as (values ('en'), ('de'), ('es'), ('fr'), ('it')), s as (select distinct source from documents)
    select s.source, need.lang as missing from s, need where not exists (select 1 from have where have.source = s.source and have.lang = need.lang)""",
)
def _gaps(b):
    have = b.documents.select("source", "lang").distinct()
    need = have.select("source").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, ["en", "de", "es", "fr", "it"]))))
    return need.join(have, ["source", "lang"], "left_anti").withColumnRenamed("lang", "missing")


# ---- windows and records -----------------------------------------------------------------------


@query(
    "latest_per_key",
    """select profile_id, kind, value, collected_at from (select *, row_number() over (partition by profile_id, kind order by collected_at desc nulls last, event_id desc) as r from readings) where r = 1""",
    "readings",
)
def _latest(b):
    return records.latest_per_key(b.readings, ["profile_id", "kind"], "collected_at", "event_id", ["value", "collected_at"])


_LATEST_PREV = """lp as (select profile_id, kind, max(case when r = 1 then value end) as latest, max(case when r = 1 then collected_at end) as latest_at,
  max(case when r = 2 then value end) as previous, max(case when r = 2 then collected_at end) as previous_at from
  (select *, row_number() over (partition by profile_id, kind order by collected_at desc nulls last, event_id desc) as r from readings) where r <= 2 group by 1, 2)"""


@query("latest_previous", f"WITH {_LATEST_PREV} select * from lp", "readings")
def _latest_previous(b):
    return records.latest_previous(b.readings, ["profile_id", "kind"], "collected_at", "event_id", "value")


@query(
    "interpretation_policy",
    f"""WITH {_LATEST_PREV} select profile_id, kind, case when previous is not null then 'value_and_trend' else 'value_only' end as policy,
    case when latest > previous then 'up' when latest < previous then 'down' when previous is not null then 'flat' end as direction from lp""",
    "readings",
)
def _policy(b):
    pairs = records.latest_previous(b.readings, ["profile_id", "kind"], "collected_at", "event_id", "value")
    return records.interpretation_policy(pairs).select("profile_id", "kind", "policy", "direction")


@query(
    "distinct_on",
    """select study_id, stage_category, number_of_patients from (select *, row_number() over (partition by study_id, stage_category order by stage_order, number_of_patients) as r from stages) where r = 1""",
    "stages",
)
def _distinct_on(b):
    rows = b.stages.select("study_id", "stage_category", "number_of_patients", "stage_order")
    return dedupe.keep_first(rows, ["study_id", "stage_category"], [F.col("stage_order"), F.col("number_of_patients")]).drop("stage_order")


@query(
    "trend_last_n",
    """WITH t as (select *, row_number() over (partition by profile_id, kind order by collected_at desc nulls last, event_id desc) as rn from readings)
    select profile_id, kind, event_id, value, collected_at, row_number() over (partition by profile_id, kind order by rn desc) as step from t where rn <= 5""",
    "readings",
)
def _trend(b):
    rows = b.readings.select("profile_id", "kind", "event_id", "value", "collected_at")
    return records.trend_last_n(rows, ["profile_id", "kind"], "collected_at", "event_id", 5)


def _base_sql(days: int) -> str:
    return f"""coalesce(arg_max(value, (collected_at, event_id)) filter (collected_at <= timestamp '{NOW}' - interval {days} day), arg_min(value, (collected_at, event_id)))"""


@query(
    "asof_baseline",
    f"select profile_id, kind, {_base_sql(7)} as baseline from readings where collected_at is not null group by 1, 2",
    "readings",
)
def _asof(b):
    return records.asof_baseline(b.readings, ["profile_id", "kind"], "collected_at", "event_id", "value", NOW, 7)


_CHANGE_SQL = f"""ch as (select profile_id, kind, count(*) as n, arg_max(value, (collected_at, event_id)) as latest, {_base_sql(7)} as b7, {_base_sql(30)} as b30, {_base_sql(90)} as b90
      from readings where collected_at is not null group by 1, 2)"""


def _pct(d: int) -> str:
    return f"case when n >= 2 and b{d} <> 0 then {k.rnd(f'(latest - b{d}) / b{d} * 100', 1)} end"


@query(
    "pct_change_windows",
    f"WITH {_CHANGE_SQL} select profile_id, kind, n, latest, {_pct(7)} as change_7d, {_pct(30)} as change_30d, {_pct(90)} as change_90d from ch",
    "readings",
)
def _changes(b):
    return records.change_windows(b.readings, ["profile_id", "kind"], "collected_at", "event_id", "value", NOW)


@query(
    "event_summary",
    """select lower(trim(kind)) as name, count(*) as n, min(cast(collected_at as date)) as first_day, max(cast(collected_at as date)) as last_day, max(value) as worst,
      arg_max(props, (collected_at is not null, collected_at, event_id)) as newest_note from readings group by 1""",
    "readings",
)
def _events(b):
    return records.event_summary(b.readings, "kind", "collected_at", "value", "props", "event_id")


@query(
    "state_snapshot",
    f"""WITH {_LATEST_PREV}, {_CHANGE_SQL}, j as (select lp.profile_id, lp.kind, latest_previous, n, c30 from
      (select profile_id, kind, coalesce(cast(latest as varchar), '-') || '/' || coalesce(cast(previous as varchar), '-') as latest_previous from lp) lp
      left join (select profile_id, kind, n, {_pct(30)} as c30 from ch) c on c.profile_id = lp.profile_id and c.kind = lp.kind),
    s as (select profile_id, string_agg(kind || ':' || latest_previous || ':' || cast(coalesce(n, 0) as varchar), ';' order by kind) as series, min(c30) as worst_change from j group by 1)
    select p.profile_id, p.site, s.series, s.worst_change, case when worst_change is null then null when worst_change <= -10 then 'high' when worst_change <= -5 then 'moderate' else 'low' end as risk
    from profiles p left join s using (profile_id)""",
    "readings profiles",
)
def _snapshot(b):
    snap = records.state_snapshot(b.readings, b.profiles.select("profile_id", "site"), NOW)
    text = F.array_join(
        F.transform("series", lambda e: F.concat_ws(":", e["kind"], F.concat_ws(
            "/", F.coalesce(e["latest"].cast("string"), F.lit("-")), F.coalesce(e["previous"].cast("string"), F.lit("-"))),
            e["n"].cast("string"))), ";",
    )
    return snap.select("profile_id", "site", text.alias("series"), "worst_change", records.risk_label(F.col("worst_change")).alias("risk"))


@query(
    "derived_features",
    """WITH e as (select o_custkey as profile_id, o_orderpriority as name, case o_orderstatus when 'F' then 'primary' when 'O' then 'recurrence' else 'second_primary' end as kind from orders)
    select profile_id, array_to_string(list_sort(list(distinct name)), ',') as names, bool_or(kind in ('recurrence', 'progression')) as has_recurrence_or_progression,
      count_if(kind in ('primary', 'second_primary')) > 1 as has_multiple_primaries from e group by 1""",
)
def _features(b):
    kind = F.when(F.col("o_orderstatus") == "F", "primary").when(F.col("o_orderstatus") == "O", "recurrence").otherwise("second_primary")
    rows = b.orders.select(F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("name"), kind.alias("kind"))
    return records.derived_features(rows, "profile_id", "name", "kind").withColumn("names", F.array_join("names", ","))


@query(
    "stale_keys",
    """WITH snap as (select user_id as profile_id, count(*) as revision from events where ts < timestamp '2024-01-29' group by 1), rev as (select user_id as profile_id, count(*) as revision from events group by 1)
    select rev.profile_id, rev.revision, snap.revision as snapshot_revision from rev left join snap using (profile_id) where snap.revision is null or snap.revision <> rev.revision""",
)
def _stale(b):
    count = F.count(F.lit(1)).alias("revision")
    snap = b.events.filter(F.col("ts") < F.lit("2024-01-29").cast("timestamp")).groupBy(F.col("user_id").alias("profile_id")).agg(count)
    return records.stale_keys(snap, b.events.groupBy(F.col("user_id").alias("profile_id")).agg(count), "profile_id")


@query(
    "timeline_latest",
    "select user_id, event_id, event_type, ts, rank from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) where rank <= 20",
)
def _timeline(b):
    return records.timeline(b.events.select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", 20)


@query(
    "parent_latest_child",
    """select c_custkey, c_name, o_orderkey, o_orderstatus from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) on c_custkey = o_custkey and r = 1""",
)
def _parent_child(b):
    parents = b.customer.select("c_custkey", "c_name")
    children = b.orders.withColumnRenamed("o_custkey", "c_custkey")
    return records.parent_latest_child(parents, children, "c_custkey", "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderstatus"])


_VERSION_SQL = """inc as (select cast(doc_id as varchar) as document_id, sha256(text) as content_hash from documents),
    cur as (select cast(doc_id as varchar) as document_id, sha256(case when lang = 'de' then text || ' v1' else text end) as content_hash, true as is_current, cast(null as varchar) as superseded_by from documents where doc_id in (select doc_id from labels)
      union all select cast(doc_id as varchar), sha256(text), false, 'later' from documents where lang = 'de' and doc_id in (select doc_id from labels where quality = 1))"""


def _uuid_sql(digest: str) -> str:
    raw = f"sha1(unhex('{ids.URL_NAMESPACE}') || encode({digest}))"
    return f"""(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) from (select {raw} as h))"""


@query(
    "versioned_merge",
    f"""WITH {_VERSION_SQL}, j as (select cur.*, inc.content_hash as new_hash from cur left join inc using (document_id))
    select document_id, content_hash, case when new_hash is not null then content_hash = new_hash else is_current end as is_current,
      case when new_hash <> content_hash and is_current then {_uuid_sql("sha256('version|' || document_id || '|' || new_hash)")} else superseded_by end as superseded_by,
      case when new_hash = content_hash and is_current then 'skipped' when new_hash = content_hash then 'restored' when new_hash is not null and is_current then 'superseded' else 'unchanged' end as action from j
    union all select document_id, content_hash, true, null, 'inserted' from inc where not exists (select 1 from cur where cur.document_id = inc.document_id and cur.content_hash = inc.content_hash)""",
)
def _versions(b):
    docs = b.documents.select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "lang", "text")
    incoming = docs.select("document_id", ids.content_hash(F.col("text")).alias("content_hash"))
    known = docs.join(b.labels.select("doc_id").distinct(), "doc_id", "left_semi")
    good = docs.join(b.labels.filter(F.col("quality") == 1).select("doc_id").distinct(), "doc_id", "left_semi").filter(F.col("lang") == "de")
    stored = F.when(F.col("lang") == "de", F.concat("text", F.lit(" v1"))).otherwise(F.col("text"))
    current = known.select(
        "document_id", ids.content_hash(stored).alias("content_hash"), F.lit(True).alias("is_current"), F.lit(None).cast("string").alias("superseded_by")
    ).unionByName(good.select("document_id", ids.content_hash(F.col("text")).alias("content_hash"), F.lit(False).alias("is_current"), F.lit("later").alias("superseded_by")))
    return records.versioned_merge(current, incoming)


# ---- sets and de-duplication -------------------------------------------------------------------


@query(
    "set_ops",
    """select 'both' as side, doc_id from (select doc_id from documents intersect select doc_id from labels)
    union all select 'left_only', doc_id from (select doc_id from documents except select doc_id from labels)
    union all select 'right_only', doc_id from (select doc_id from labels except select doc_id from documents)""",
)
def _set_ops(b):
    left, right = b.documents.select("doc_id"), b.labels.select("doc_id")
    return (
        left.intersect(right).select(F.lit("both").alias("side"), "doc_id")
        .unionByName(left.subtract(right).select(F.lit("left_only").alias("side"), "doc_id"))
        .unionByName(right.subtract(left).select(F.lit("right_only").alias("side"), "doc_id"))
    )


@query(
    "union_provenance",
    """WITH r as (select doc_id, 'documents' as o from documents union all select doc_id, 'labels' from labels union all select vec_id, 'embeddings' from embeddings)
    select doc_id, bool_or(o = 'documents') as from_documents, bool_or(o = 'labels') as from_labels, bool_or(o = 'embeddings') as from_embeddings from r group by 1""",
)
def _provenance(b):
    vectors = b.embeddings.select(F.col("vec_id").alias("doc_id"))
    return dedupe.union_provenance([("documents", b.documents), ("labels", b.labels), ("embeddings", vectors)], "doc_id")


_KEY_SQL = "sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))"


@query(
    "content_dedup",
    f"""select content_key, doc_id, source from (select {_KEY_SQL} as content_key, doc_id, source, row_number() over (partition by {_KEY_SQL} order by n_chars, doc_id) as r from documents) where r = 1""",
)
def _content(b):
    rows = b.documents.select("doc_id", "source", "n_chars", "text")
    return dedupe.content_dedupe(rows, "text", [F.col("n_chars"), F.col("doc_id")]).drop("n_chars")


@query(
    "source_priority_dedup",
    """WITH h as (select doc_id, source, n_chars, sha256(text) as content_key, case source when 'src1' then 0 when 'src2' then 1 else 99 end as p from documents),
    g as (select *, first_value(doc_id) over (partition by content_key order by p, n_chars desc, doc_id) as kept_id, count(*) over (partition by content_key) as copies from h)
    select doc_id, source, kept_id, copies, case when doc_id = kept_id then 'selected' else 'exact_duplicate' end as reason from g""",
)
def _priority_dedupe(b):
    priority = F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", 1).otherwise(99)
    rows = b.documents.select("doc_id", "source", "n_chars", "text")
    return dedupe.source_priority_dedupe(rows, "text", priority, F.col("n_chars"), "doc_id").select("doc_id", "source", "kept_id", "copies", "reason")


@query(
    "case_dedup",
    """WITH t as (select l_suppkey as key, case when l_returnflag = 'A' then p_type when l_returnflag = 'N' then lower(p_type) else lower(p_brand) end as term, (l_orderkey, l_linenumber, l_partkey) as ord from lineitem join part on l_partkey = p_partkey)
    select key, lower(term) as folded, arg_min(term, (cast(term = lower(term) as int), ord)) as term from t group by 1, 2""",
)
def _case(b):
    flag = F.col("l_returnflag")
    term = F.when(flag == "A", F.col("p_type")).when(flag == "N", F.lower("p_type")).otherwise(F.lower("p_brand"))
    rows = b.lineitem.join(b.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("key"), term.alias("term"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord")
    )
    return dedupe.case_dedupe(rows, "key", "term", "ord")


@query("study_dedup")
def _study_dedup(b):
    s = b.studies
    rows = s.select(
        "study_id",
        F.concat_ws("|", F.lower(F.trim("study_name")), F.col("pub_year").cast("string"), "country").alias("fingerprint"),
        F.when(F.col("status") == "P", F.concat(F.lit("NCT"), F.col("citation_count").cast("string"), F.lit("-"), F.col("region_key").cast("string"))).alias("trial_no"),
    )
    return dedupe.first_wins(rows, "study_id", ["fingerprint", "trial_no"])


@query(
    "multi_corpus_merge",
    """WITH p as (select case when l_linestatus = 'F' then l_orderkey * 10 + l_linenumber end as point_id, case when l_returnflag <> 'R' then l_orderkey end as doc_id, l_returnflag as section, l_linenumber as chunk_index, 'item ' || l_partkey as text, (l_suppkey, l_orderkey, l_quantity, l_partkey, l_linenumber) as pos, case when l_tax < 0.04 then 0 else 1 end as corpus, l_extendedprice as price from lineitem),
    i as (select *, coalesce('point:' || point_id, 'doc:' || doc_id || '|' || section || '|' || chunk_index, 'text:' || text) as identity from p)
    select identity, corpus, price from (select *, row_number() over (partition by identity order by corpus, pos) as r from i) where r = 1""",
)
def _merge_corpora(b):
    rows = b.lineitem.select(
        F.when(F.col("l_linestatus") == "F", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")).alias("doc_id"),
        F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("chunk_index"),
        F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("text"),
        F.struct("l_suppkey", "l_orderkey", "l_quantity", "l_partkey", "l_linenumber").alias("pos"),
        F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"),
    )
    parts = [rows.filter(F.col("tax") < 0.04).drop("tax"), rows.filter(F.col("tax") >= 0.04).drop("tax")]
    return dedupe.multi_corpus_merge(parts).select("identity", "corpus", "price")


@query(
    "existing_doc_check",
    """WITH u as (select study_id as upload_id, 'DOI 10.1000_j.' || study_id || '.pdf' as file_name, lower(document_name) as name from studies where status = 'O'),
    d as (select u.*, regexp_replace(regexp_extract(regexp_replace(file_name, '\\.[A-Za-z]+$', ''), '(10\\.\\d{4,}_[a-zA-Z][^\\s_-]*(?:\\.[^\\s_-]+)*)', 1), '^(10\\.\\d{4,})_', '\\1/') as doi from u),
    e as (select doi, study_id from studies where pub_year > 1996 and doi is not null)
    select upload_id, d.doi, e.study_id as existing_id from d left join e on d.doi = e.doi""",
    "studies",
)
def _existing(b):
    s = b.studies
    uploads = s.filter(F.col("status") == "O").select(
        F.col("study_id").alias("upload_id"), F.concat(F.lit("DOI 10.1000_j."), F.col("study_id").cast("string"), F.lit(".pdf")).alias("file_name")
    )
    known = s.filter((F.col("pub_year") > 1996) & F.col("doi").isNotNull()).select("doi", F.col("study_id").alias("existing_id"))
    return uploads.select("upload_id", ids.doi_from_filename(F.col("file_name")).alias("doi")).join(known, "doi", "left").select("upload_id", "doi", "existing_id")


@query(
    "doi_normalise",
    """WITH t as (select study_id, case status when 'F' then '10.1000_j.' || study_id when 'O' then '10.1000j.' || study_id else coalesce(doi, 'none') end as raw from studies)
    select study_id, case when regexp_matches(raw, '^10\\.\\d{4,}/') then raw when regexp_matches(raw, '^10\\.\\d{4,}_.') then regexp_replace(raw, '^(10\\.\\d{4,})_', '\\1/')
      when regexp_matches(raw, '^10\\.\\d{4,}[a-zA-Z].') then regexp_replace(raw, '^(10\\.\\d{4,})([a-zA-Z])', '\\1/\\2') else raw end as doi from t""",
    "studies",
)
def _doi(b):
    number = F.col("study_id").cast("string")
    raw = F.when(F.col("status") == "F", F.concat(F.lit("10.1000_j."), number)).when(F.col("status") == "O", F.concat(F.lit("10.1000j."), number)).otherwise(F.coalesce("doi", F.lit("none")))
    return b.studies.select("study_id", ids.normalize_doi(raw).alias("doi"))


@query(
    "doc_id",
    """WITH t as (select study_id, ' ' || document_name || ' (' || study_type || ') __' || coalesce(cancer_type, '') as raw from studies)
    select study_id, substr(regexp_replace(regexp_replace(regexp_replace(trim(raw), '[^\\w\\-.]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) || '_' || substr(md5(raw), 1, 8) as doc_id from t""",
    "studies",
)
def _doc_id(b):
    raw = F.concat(F.lit(" "), "document_name", F.lit(" ("), "study_type", F.lit(") __"), F.coalesce("cancer_type", F.lit("")))
    return b.studies.select("study_id", ids.normalize_doc_id(raw).alias("doc_id"))


@query(
    "section_key",
    """WITH t as (select study_id, lower(trim(coalesce(nullif(study_phase || ' ' || study_type || '!', ''), 'NO_SECTION'))) as s from studies)
    select study_id, coalesce(nullif(substr(regexp_replace(regexp_replace(s, '\\s+', '_', 'g'), '[^a-z0-9_]+', '', 'g'), 1, 60), ''), 'no_section') || '-' || substr(md5(s), 1, 8) as section_key from t""",
    "studies",
)
def _section_key(b):
    return b.studies.select("study_id", ids.section_key(F.concat("study_phase", F.lit(" "), "study_type", F.lit("!"))).alias("section_key"))


@query(
    "content_hash",
    f"""select doc_id, sha256(text) as content_hash, {_uuid_sql("sha256('document|' || source || '|' || cast(doc_id as varchar))")} as document_id from documents""",
)
def _content_hash(b):
    return b.documents.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"), ids.stable_id("document", F.col("source"), F.col("doc_id")).alias("document_id"))


@query(
    "reconcile_fields",
    """WITH a as (select study_id, 'stage' as field, case when status <> 'P' then stage_text end as value from studies union all select study_id, 'histology', cancer_type from studies),
    m as (select study_id, 'stage' as field, case when region_key = 1 then upper(stage_text) else 'Stage II' end as value from studies union all select study_id, 'histology', case when region_key > 2 then 'thymoma' end from studies),
    j as (select coalesce(a.study_id, m.study_id) as study_id, coalesce(a.field, m.field) as field, a.value as rv, m.value as mv from (select * from a where value is not null) a full outer join (select * from m where value is not null) m on a.study_id = m.study_id and a.field = m.field)
    select study_id, field, case when lower(rv) = lower(mv) then rv when field = 'histology' then coalesce(mv, rv) else coalesce(rv, mv) end as value,
      case when lower(rv) = lower(mv) then 'agreed' when mv is null then 'rule' when rv is null then 'model' when field = 'histology' then 'model' else 'rule' end as value_source,
      coalesce(lower(rv) <> lower(mv), false) as disagree from j""",
    "studies",
)
def _reconcile(b):
    s = b.studies
    entry = lambda name, col: F.struct(F.lit(name).alias("field"), col.alias("value"))

    def long(*pairs):
        rows = s.select("study_id", F.explode(F.array(*[entry(n, c) for n, c in pairs])).alias("e"))
        return rows.select("study_id", "e.field", "e.value").filter(F.col("value").isNotNull())

    rule = long(("stage", F.when(F.col("status") != "P", F.col("stage_text"))), ("histology", F.col("cancer_type")))
    model = long(
        ("stage", F.when(F.col("region_key") == 1, F.upper("stage_text")).otherwise("Stage II")),
        ("histology", F.when(F.col("region_key") > 2, F.lit("thymoma"))),
    )
    return dedupe.reconcile_fields(rule, model, "study_id", ["histology"])


@query(
    "array_move",
    """WITH t as (select study_id, string_split(modality || ',HER2,EGFR', ',') as a, string_split(case when region_key < 2 then 'egfr,Surgery' else 'her2,radiotherapy' end, ',') as g from studies)
    select study_id, array_to_string(list_filter(a, lambda x: not list_contains(list_transform(g, lambda y: lower(y)), lower(x)) or lower(x) in ('her2', 'pd-l1')), ',') as kept from t""",
    "studies",
)
def _array_move(b):
    source = F.split(F.concat("modality", F.lit(",HER2,EGFR")), ",")
    target = F.split(F.when(F.col("region_key") < 2, "egfr,Surgery").otherwise("her2,radiotherapy"), ",")
    return b.studies.select("study_id", F.array_join(dedupe.array_move(source, target, ["HER2", "PD-L1"]), ",").alias("kept"))
