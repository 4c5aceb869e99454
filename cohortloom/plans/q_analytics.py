"""Study analytics queries (B1, B2, D1-D9, D29, G, I1-I8, I40-I45)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import parse, rules
from cohortloom.operators import analytics, summarize
from cohortloom.plans import sqlkit as k
from cohortloom.plans.registry import query


def _summary(b):
    return summarize.build_study_summary(b.studies)


def _radiation(b):
    return summarize.build_radiation_summary(b.details, b.studies)


query("study_summary", f"WITH {k.SUMMARY} select * from summary", "studies")(_summary)
query("detail_summary", f"WITH {k.RADIATION} select * from radiation", "studies details")(_radiation)

for _name, _metric, _group, _agg, _filters, _expr, _where in [
    ("agg_metric_avg", "os_rate_percent", "normalized_phase", "avg", None, k.xavg("os_rate_percent"), ""),
    ("agg_metric_median", "median_followup_months", "cancer_type", "median", {"is_randomized": True},
     "quantile_cont(median_followup_months, 0.5)", "and is_randomized"),
    ("agg_metric_min", "number_of_patients", "country", "min", None, "min(number_of_patients)", ""),
    ("agg_metric_max", "pfs_median_months", "study_type_normalized", "max", None, "max(pfs_median_months)", ""),
    ("agg_metric_sum", "number_of_patients", "is_multi_center", "sum", None, k.xsum("number_of_patients"), ""),
]:
    query(
        _name,
        f"""WITH {k.SUMMARY} select cast({_group} as varchar) as grp, {k.rnd(_expr, 2)} as val, count(*) as n from summary
        where {_metric} is not null and {_group} is not null {_where} group by 1 having count(*) >= 2
        order by val desc, grp limit 20""",
        "studies",
    )(lambda b, m=_metric, g=_group, a=_agg, f=_filters: analytics.aggregate_metric(_summary(b), m, g, a, f, limit=20))


@query(
    "kpi_overview",
    f"""WITH {k.SUMMARY}, {k.RADIATION},
    h as (select cast(count(*) as double) as total_studies, cast(count(distinct cancer_type) as double) as cancer_types,
      {k.rnd(k.xavg('os_rate_percent'), 1)} as avg_os, {k.rnd(k.xavg('pfs_rate_percent'), 1)} as avg_pfs,
      {k.rnd(k.xavg('median_followup_months'), 1)} as avg_followup, {k.rnd(k.xavg('number_of_patients'), 0)} as avg_n from summary),
    r as (select cast(count(*) as double) as total_rad_records, cast(count(distinct normalized_technique) as double) as unique_techniques,
      {k.rnd(k.xavg('best_dose_gy'), 1)} as avg_dose from radiation where best_dose_gy is not null)
    select 'studies' as section, label, value from (unpivot h on columns(*) into name label value value)
    union all select 'radiation', label, value from (unpivot r on columns(*) into name label value value)
    union all select 'phase', normalized_phase, cast(count(*) as double) from summary where normalized_phase is not null group by 2""",
    "studies details",
)
def _kpi(b):
    return analytics.kpi_overview(_summary(b), _radiation(b))


@query(
    "histogram",
    f"""WITH {k.RADIATION}, t as (select floor(best_dose_gy / 5.0) * 5.0 as bin_start, count(*) as n from radiation
      where best_dose_gy > 0 group by 1)
    select bin_start, n, cast(cast(bin_start as bigint) as varchar) || '-' || cast(cast(bin_start + 5 as bigint) as varchar) || ' Gy' as label from t""",
    "studies details",
)
def _histogram(b):
    return analytics.histogram(_radiation(b), "best_dose_gy", 5.0)


@query(
    "top_frequency",
    f"""WITH {k.RADIATION} select normalized_technique as value, count(*) as n from radiation
    where normalized_technique is not null group by 1 order by n desc, value limit 15""",
    "studies details",
)
def _top_frequency(b):
    return analytics.top_frequency(_radiation(b), "normalized_technique", 15)


@query(
    "outcomes_by_group",
    f"""WITH {k.SUMMARY} select stage_category as grp, {k.rnd(k.xavg('os_rate_percent'), 1)} as avg_val,
      count(distinct m.study_id) as n from stages sd join summary m on m.study_id = sd.study_id
    where os_rate_percent is not null and stage_category is not null group by 1 having count(distinct m.study_id) >= 2""",
    "studies stages",
)
def _outcomes(b):
    return analytics.outcomes_by_group(b.stages, _summary(b), "os_rate_percent")


@query(
    "facets_min_support",
    f"WITH {k.SUMMARY} select cancer_type as value, count(*) as n from summary where cancer_type is not null group by 1 having count(*) >= 3",
    "studies",
)
def _facets(b):
    return analytics.facet_values(_summary(b), "cancer_type", 3)


@query(
    "facet_counts",
    """select country as value, count(*) as n from studies where country is not null and country <> '' and country ilike '%nation_1%'
    group by 1 order by n desc, value limit 50""",
    "studies",
)
def _facet_counts(b):
    return analytics.facet_counts(b.studies, "country", "nation_1", 50)


# Hazard ratios of a line against its part's list price, with a spread that grows with the discount.
def _ratios(b):
    ratio = F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice"))
    spread = 1.05 + F.col("l_discount")
    return (
        b.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
        .join(b.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        .join(b.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("s_nationkey", ratio.alias("hr"), (ratio / spread).alias("ci_low"), (ratio * spread).alias("ci_high"))
    )


@query(
    "meta_fixed_effect",
    f"""WITH r as (select s_nationkey, l_extendedprice / (l_quantity * p_retailprice) as hr, 1.05 + l_discount as spread
      from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
    x as (select s_nationkey, ln(hr) as ln_hr, (ln(hr * spread) - ln(hr / spread)) / 3.92 as se from r where hr > 0),
    w as (select s_nationkey, ln_hr, 1.0 / (se * se) as w from x where se > 0),
    p as (select s_nationkey, sum(w) as sw, sum(w * ln_hr) / sum(w) as l, count(*) as n from w group by 1)
    select s_nationkey, {k.rnd('exp(l)', 3)} as hr, {k.rnd('exp(l - 1.96 / sqrt(sw))', 3)} as ci_low,
      {k.rnd('exp(l + 1.96 / sqrt(sw))', 3)} as ci_high, {k.rnd('sw', 2)} as weight, n as n_studies from p""",
)
def _meta(b):
    return analytics.meta_fixed_effect(_ratios(b), "s_nationkey")


@query(
    "rate_forest",
    f"""WITH {k.SUMMARY}, t as (select study_id, coalesce(study_name, document_name, 'Unknown') as label,
      os_rate_percent as rate, os_median_months as median_months, coalesce(number_of_patients, 0) as n, normalized_phase as phase,
      coalesce(os_raw, '') as raw from summary where os_rate_percent is not null or os_median_months is not null
      order by rate desc nulls last, study_id limit 30)
    select *, {k.rnd('avg(rate) over ()', 1)} as pooled_rate from t""",
    "studies",
)
def _forest(b):
    return analytics.rate_forest(_summary(b), "os", 30)


@query(
    "comparison_pivot",
    f"""WITH t as (select study_id, line_status, {k.percent('txt')} as p, {k.num('txt', r'(\d+\.?\d*)')} as v from
      (select l_orderkey as study_id, l_linestatus as line_status, case when l_returnflag = 'A' then cast(cast(l_quantity as bigint) as varchar) || '%'
        when l_returnflag = 'N' then '0.' || cast(10 + cast(l_quantity as bigint) as varchar) else null end as txt from lineitem)),
    u as (select study_id, line_status, coalesce(p, case when v <= 1 then v * 100 else v end) as pct from t)
    select study_id, max(case when line_status = 'F' then pct end) as "F", max(case when line_status = 'O' then pct end) as "O"
    from u group by 1""",
)
def _comparison(b):
    q = F.col("l_quantity").cast("bigint")
    text = F.when(F.col("l_returnflag") == "A", F.concat(q.cast("string"), F.lit("%"))).when(
        F.col("l_returnflag") == "N", F.concat(F.lit("0."), (q + 10).cast("string"))
    )
    rows = b.lineitem.select(
        F.col("l_orderkey").alias("study_id"), F.col("l_linestatus").alias("line_status"), text.alias("txt")
    )
    return analytics.comparison_pivot(rows, "study_id", "line_status", "txt", ["F", "O"])


@query(
    "topk_nulls_last",
    "select study_id, pmid, publish_date, number_of_patients from studies order by number_of_patients desc nulls last, study_id limit 50",
    "studies",
)
def _topk(b):
    rows = b.studies.select("study_id", "pmid", "publish_date", "number_of_patients")
    return analytics.top_k_nulls_last(rows, [F.col("number_of_patients").desc_nulls_last(), F.asc("study_id")], 50)


@query(
    "priority_order",
    """select o_orderkey, o_orderpriority, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end as rank
    from orders order by rank, o_orderdate desc, o_orderkey limit 100""",
)
def _priority(b):
    rank = analytics.priority_order("o_orderpriority", ["1-URGENT", "2-HIGH"])
    return analytics.top_k_nulls_last(
        b.orders.withColumn("rank", rank), [F.asc("rank"), F.desc("o_orderdate"), F.asc("o_orderkey")], 100
    ).select("o_orderkey", "o_orderpriority", "rank")


@query(
    "paging",
    "select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25 offset 50",
)
def _paging(b):
    rows = b.customer.select("c_custkey", "c_name", "c_acctbal")
    return analytics.page(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], 50, 25)


@query(
    "leaderboard",
    """select user_id, count(*) as hits, max(ts) as last_seen from events group by 1 order by hits desc, last_seen desc limit 20""",
)
def _leaderboard(b):
    per_key = b.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_seen"))
    return analytics.top_k_nulls_last(per_key, [F.desc("hits"), F.desc("last_seen")], 20)


@query(
    "find_latest_ci",
    """select lower(o_orderstatus) as name, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) as latest_key, max(o_orderdate) as latest_at
    from orders group by 1""",
)
def _find_latest(b):
    newest = F.struct(F.col("o_orderdate"), -F.col("o_orderkey"))
    return b.orders.groupBy(F.lower("o_orderstatus").alias("name")).agg(
        F.max_by("o_orderkey", newest).alias("latest_key"), F.max("o_orderdate").alias("latest_at")
    )


for _name, _fn, _sql, _role, _key, _text in [
    ("parse_percent", parse.extract_percent, k.percent, "studies", "study_id", "overall_survival"),
    ("parse_months", parse.extract_months, k.months, "studies", "study_id", "overall_survival"),
    ("parse_gy", parse.extract_gy, k.gy, "details", "detail_id", "total_dose"),
    ("parse_fractions", parse.extract_fractions, k.fractions, "details", "detail_id", "total_dose"),
    ("normalize_phase", rules.normalize_phase, k.phase, "studies", "study_id", "study_phase"),
    ("normalize_by_rules", rules.normalize_category, k.disease, "studies", "study_id", "cancer_type"),
]:
    query(_name, f"select {_key}, {_text} as raw, {_sql(_text)} as value from {_role}", _role)(
        lambda b, f=_fn, r=_role, key=_key, t=_text: b.role(r).select(
            key, F.col(t).alias("raw"), f(F.col(t)).alias("value")
        )
    )


def _status_sql(col: str) -> str:
    names = list(dict.fromkeys(n for _, n, _ in rules.MARKER_PATTERNS))
    parts = ", ".join(
        f"{k.q(n + '=')} || "
        + k.case_rules(f"lower({col})", [(p, s) for p, m, s in rules.MARKER_PATTERNS if m == n])
        for n in names
    )
    return f"array_to_string(list_sort(list_filter([{parts}], lambda x: x is not null)), ';')"


@query(
    "status_map",
    f"""select study_id, {_status_sql('molecular_subtype')} as markers,
      {k.case_rules('lower(molecular_subtype)', rules.ASSAY_PATTERNS)} as assay,
      {k.rx('lower(molecular_subtype)', r'oncotype\s*dx[^.]{0,80}(?:score|rs)\s*(?:of\s*)?(\d+\s*[-–]\s*\d+|\d+|[<>≤≥]\s*\d+)')} as score_range
    from studies where molecular_subtype is not null""",
    "studies",
)
def _status_map(b):
    text = F.col("molecular_subtype")
    entries = F.transform(F.map_entries(rules.marker_status(text)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    score = parse.first_group(
        F.lower(text), r"oncotype\s*dx[^.]{0,80}(?:score|rs)\s*(?:of\s*)?(\d+\s*[-–]\s*\d+|\d+|[<>≤≥]\s*\d+)"
    )
    return b.studies.filter(text.isNotNull()).select(
        "study_id",
        F.array_join(F.array_sort(entries), ";").alias("markers"),
        rules.genomic_assay(text).alias("assay"),
        score.alias("score_range"),
    )


@query(
    "json_path",
    """select detail_id, json_extract_string(additional_details, '$.total_dose') as total_dose,
      json_extract_string(additional_details, '$.nested.site') as site, regexp_matches(coalesce(additional_details, ''), 'boost') as has_boost from details""",
    "details",
)
def _json_path(b):
    d = F.col("additional_details")
    return b.details.select(
        "detail_id",
        parse.json_text(d, "$.total_dose").alias("total_dose"),
        parse.json_text(d, "$.nested.site").alias("site"),
        F.coalesce(d, F.lit("")).rlike("boost").alias("has_boost"),
    )


# Titles and units as a reader expects them, written out.
_LABELS = [("os_rate_percent", "Os Rate", "%"), ("os_median_months", "Os Median", " months"), ("pfs_rate_percent", "Pfs Rate", "%"), ("pfs_median_months", "Pfs Median", " months"),
           ("dfs_rate_percent", "Dfs Rate", "%"), ("dfs_median_months", "Dfs Median", " months"), ("lc_rate_percent", "Lc Rate", "%"),
           ("median_followup_months", "Median Followup Months", " months"), ("number_of_patients", "Number Of Patients", " patients"), ("median_age_numeric", "Median Age Numeric", " years")]


@query(
    "metric_labels",
    f"WITH {k.SUMMARY}, " + ", ".join(f"m{i} as (select {k.q(m)} as metric, {k.q(label)} as label, {k.q(unit)} as unit, count({m}) as n, max(cast({m} as double)) as top from summary)" for i, (m, label, unit) in enumerate(_LABELS))
    + " " + " union all ".join(f"select * from m{i}" for i in range(len(_LABELS))),
    "studies",
)
def _labels(b):
    metrics = sorted(analytics.METRICS)
    wide = _summary(b).select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return analytics.with_labels(wide.groupBy("metric").agg(F.count("value").alias("n"), F.max("value").alias("top")), "metric")
