"""Statement extractors and full frames (I25, D14). The texts state numbers of the tables; the SQL reads the numbers, not the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import extractors as x
from cohortloom.plans.registry import query

# What an order's chunk says; a and y are numbers of the order, k picks the statements.
_NUMBERS = "select o_custkey, o_orderkey, cast(o_orderkey % 89 + 6 as string) as a, cast(o_custkey % 9 + 1 as string) as y, o_orderkey % 4 as k4, o_orderkey % 3 as k3, o_orderkey % 5 as k5, o_orderkey % 7 as k7 from {orders}"
_TEXT = """concat_ws('. ', 'A report',
  case k4 when 0 then y || '-year OS: ' || a || '%' when 1 then 'Overall  survival ' || a || '.5 %' when 2 then 'Median OS was long, median OS ' || y || ' months' end,
  case k3 when 0 then y || ' yr PFS ' || a || '%' when 1 then 'median progression-free: ' || y || ' mo' end,
  case k5 when 0 then y || '-year local control ' || a || '%' when 1 then 'locoregional control: ' || a || '%' when 2 then 'treated with ' || a || ' Gy in ' || y || ' fractions and cisplatin' when 3 then a || ' Gy BID after mastectomy' end,
  case k7 when 0 then y || 'yr DFS ' || a || '%' when 1 then 'HR = 0.' || a || '; 95% CI 0.5-0.9' when 2 then 'a ' || a || '% relapse' when 3 then 'pCR: ' || a || '%' when 4 then 'ER+ PR - and HER2-' when 5 then 'Stage IIIA, KRAS mutation' when 6 then 'pT2aN1M0 with FOLFOX' end) || '.'"""

_ENTRIES_SQL = """n as (select o_custkey, o_orderkey, cast(o_orderkey % 89 + 6 as varchar) as a, cast(o_custkey % 9 + 1 as varchar) as y, o_orderkey % 4 as k4, o_orderkey % 3 as k3, o_orderkey % 5 as k5, o_orderkey % 7 as k7 from orders),
  e as (select *, unnest([
    case when k4 = 0 then y || 'yr_OS=' || a || '%' end, case when k4 = 0 then 'OS=' || a || '%' when k4 = 1 then 'OS=' || a || '.5%' end, case when k4 = 2 then 'median_OS=' || y || ' mo' end,
    case when k3 = 0 then y || 'yr_PFS=' || a || '%' when k3 = 1 then 'median_PFS=' || y || ' mo' end,
    case when k5 = 0 then y || 'yr_LC=' || a || '%' end, case when k5 in (0, 1) then 'LC=' || a || '%' end,
    case k7 when 0 then y || 'yr_DFS=' || a || '%' when 1 then 'HR=0.' || a when 2 then 'recurrence_rate=' || a || '%' when 3 then 'pCR=' || a || '%' end]) as entry from n)"""


def _chunks(b):
    return b.spark.sql(_NUMBERS, orders=b.orders).withColumn("text", F.expr(_TEXT))


def _said(outcomes):
    return F.array_join(F.array_sort(F.transform(F.map_entries(outcomes), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


@query(
    "outcome_map",
    f"""WITH {_ENTRIES_SQL}, g as (select o_orderkey, string_agg(entry, ';' order by entry) as outcomes from e where entry is not null group by 1)
    select n.o_orderkey, coalesce(outcomes, '') as outcomes, case k5 when 2 then a || ' Gy in ' || y || ' fx' when 3 then a || ' Gy' end as dose, case k7 when 4 then 'ER+;HER2-;PR -' when 5 then 'KRAS mutation' else '' end as markers,
      case when k5 = 3 then 'mastectomy' else '' end as modalities, array_to_string(list_sort(list_filter([case when k5 = 2 then 'cisplatin' end, case when k7 = 6 then 'FOLFOX' end], lambda v: v is not null)), ';') as agents
    from n left join g using (o_orderkey)""",
)
def _outcomes(b):
    t = F.col("text")
    return _chunks(b).select(
        "o_orderkey", _said(x.outcome_map(t)).alias("outcomes"), x.dose(t).alias("dose"), F.array_join(x.biomarkers(t), ";").alias("markers"),
        F.array_join(F.filter(x.named(t, x.MODALITIES), lambda m: m != "RT"), ";").alias("modalities"), F.array_join(x.named(t, x.AGENTS), ";").alias("agents"),
    )


@query(
    "frame_profile",
    f"""WITH {_ENTRIES_SQL}, l as (select o_custkey, string_split(entry, '=')[1] as key, arg_max(entry, o_orderkey) as entry from e where entry is not null group by 1, 2),
    o as (select o_custkey, string_agg(entry, ';' order by entry) as outcomes from l group by 1),
    s as (select *, k7 in (5, 6) as p, k5 in (2, 3) or k7 = 6 as t, k4 < 3 or k3 < 2 or k5 < 2 or k7 < 4 as oc from n),
    h as (select o_custkey, arg_min('Stage IIIA', o_orderkey) filter (k7 = 5) as stage, arg_min('pM0pN1pT2a', o_orderkey) filter (k7 = 6) as tnm,
      arg_min(case k5 when 2 then a || ' Gy in ' || y || ' fx' else a || ' Gy' end, o_orderkey) filter (k5 in (2, 3)) as dose,
      count_if(p) as pn, count_if(t) as tn, count_if(oc) as cn, string_agg(distinct case when k5 = 2 then 'cisplatin' end, ';') as c1, string_agg(distinct case when k7 = 6 then 'FOLFOX' end, ';') as c2,
      concat_ws(';', max(case when k7 = 4 then 'ER+;HER2-' end), max(case when k7 = 5 then 'KRAS mutation' end), max(case when k7 = 4 then 'PR -' end)) as markers, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as evidence
      from s where p or t or oc group by 1)
    select o_custkey, stage, tnm, dose, coalesce(outcomes, '') as outcomes, markers, concat_ws(';', c2, c1) as agents, evidence,
      case when pn > 0 and tn > 0 and cn > 0 and pn + tn + cn >= 10 then 'high' when (pn > 0 and tn > 0 and cn > 0) or pn + tn + cn >= 5 then 'medium' else 'low' end as confidence from h left join o using (o_custkey)""",
)
def _profile(b):
    f = x.frame_profile(_chunks(b), "o_custkey", "o_orderkey", "o_orderkey", "text")
    join = lambda c: F.array_join(c, ";").alias(c)
    return f.select("o_custkey", "stage", "tnm", "dose", _said(F.col("outcomes")).alias("outcomes"), join("markers"), join("agents"), F.array_join(F.transform("evidence_ids", lambda i: i.cast("string")), ",").alias("evidence"), "confidence")
