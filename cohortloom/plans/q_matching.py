"""Matching and applicability queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.functions import parse, rules
from cohortloom.operators import matching as m
from cohortloom.plans import sqlkit as k
from cohortloom.plans.q_retrieval import rnd6, sq6
from cohortloom.plans.registry import query

# Words that place a study at a site.
SITE_RULES = [("breast", "breast"), ("nsclc|lung", "lung"), ("prostate", "prostate"), ("rectal", "rectal"), ("glioblastoma", "glioblastoma")]


def _studies(b):
    s = b.studies
    return s.select(
        "study_id", "doc_id", "study_name", "study_type", "cancer_type", "stage_text", "molecular_subtype", "number_of_patients", "citation_count", "publish_date",
        F.col("modality").alias("study_modality"), "pub_year", "region_key", "status", F.col("price").alias("score"),
        parse.first_number(F.col("median_age"), r"(\d+\.?\d*)").alias("median_age"),
        rules.first_rule(F.lower("cancer_type"), SITE_RULES).alias("site"),
        rules.marker_status(F.col("molecular_subtype")).alias("status_map"), m.stage_features(F.col("stage_text")).alias("study_stage"),
    )


STUDY_SQL = f"""st as (select study_id, doc_id, study_name, study_type, cancer_type, stage_text, molecular_subtype, number_of_patients, citation_count, publish_date, modality as study_modality, pub_year, region_key, status, price as score,
    {k.num('median_age', r'(\d+\.?\d*)')} as median_age, {k.case_rules('lower(cancer_type)', SITE_RULES)} as site from studies),
    pr as (select st.*, c.case_id, c.histology, c.stage, c.marker, c.marker_status, c.modality, c.age, c.nation_name from st join cases c on st.site = c.site)"""


def _pairs(b):
    return m.case_pairs(b.cases.withColumn("case_stage", m.stage_features(F.col("stage"))), _studies(b))


# How many studies a structured match returns for a case; a fixed value of that operator alone.
TOP = 20


def _ordered(df, score):
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(score), F.asc("study_id"))))


# ---- case scores -------------------------------------------------------------------------------

_SIM_AXES_SQL = [
    ("age is not null and median_age is not null", "case when abs(age - median_age) <= 10 then 1 - abs(age - median_age) / 10 else 0.0 end", 0.1),
    ("cancer_type is not null", "1.0", 0.2),
    ("histology is not null and cancer_type is not null", "case when contains(lower(cancer_type), lower(histology)) or contains(lower(histology), lower(cancer_type)) then 1.0 else 0.0 end", 0.15),
    ("stage is not null", "case when contains(lower(stage_text), lower(stage)) then 1.0 else 0.0 end", 0.15),
    ("modality is not null", "case when contains(lower(study_modality), modality) then 1.0 else 0.0 end", 0.2),
    ("marker is not null", "case when contains(lower(coalesce(molecular_subtype, '')), marker) then 1.0 else 0.0 end", 0.15),
]
_SIM_SQL = "(" + " + ".join(f"case when {on} then ({share}) * {w} else 0.0 end" for on, share, w in _SIM_AXES_SQL) + ") / (" + " + ".join(f"case when {on} then {w} else 0.0 end" for on, _, w in _SIM_AXES_SQL) + ")"


def _case_similarity(b):
    c = F.col
    yes = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    axes = [
        (c("age").isNotNull() & c("median_age").isNotNull(), m.age_share(c("age"), c("median_age")), 0.1),
        (c("cancer_type").isNotNull(), F.lit(1.0), 0.2),
        (c("histology").isNotNull() & c("cancer_type").isNotNull(), yes(m.either_contains(c("cancer_type"), c("histology"))), 0.15),
        (c("stage").isNotNull(), yes(F.lower("stage_text").contains(F.lower("stage"))), 0.15),
        (c("modality").isNotNull(), yes(F.lower("study_modality").contains(c("modality"))), 0.2),
        (c("marker").isNotNull(), yes(F.lower(F.coalesce("molecular_subtype", F.lit(""))).contains(c("marker"))), 0.15),
    ]
    return _pairs(b).withColumn("similarity", m.case_similarity(axes))


@query(
    "case_similarity",
    f"WITH {STUDY_SQL}, s as (select case_id, study_id, {_SIM_SQL} as v from pr) select case_id, study_id, {sq6('v')} as similarity, row_number() over (partition by case_id order by round(v, 9) desc, study_id) as rank from s",
    "studies cases",
)
def _similarity(b):
    rows = _case_similarity(b).withColumn("r9", F.round("similarity", 9))
    return _ordered(rows, "r9").select("case_id", "study_id", rnd6(F.col("similarity")).alias("similarity"), "rank")


_REL = [
    ("true", "case when contains(lower(cancer_type), site) then 0.8 else 0.4 end", 25),
    ("histology is not null", "case when contains(lower(coalesce(cancer_type, '')), histology) then 1.0 else 0.0 end", 15),
    ("stage is not null", "case when contains(lower(stage_text), 'stage ' || lower(stage)) then 1.0 when contains(lower(stage_text), lower(stage)) then 0.6 else 0.0 end", 10),
    ("modality is not null", "case when contains(study_modality, modality) then 1.0 when contains(study_modality, 'chemo') then 0.5 else 0.0 end", 10),
    ("marker is not null", "case when contains(lower(coalesce(molecular_subtype, '')), marker) then 1.0 else 0.0 end", 10),
    ("median_age is not null", "case when abs(age - median_age) <= 5 then 1.0 when abs(age - median_age) <= 10 then 0.6 when abs(age - median_age) <= 15 then 0.2 else 0.0 end", 5),
]
_REL_SQL = "(" + " + ".join(f"case when {on} then ({share}) * {w} else 0.0 end" for on, share, w in _REL) + ") / (" + " + ".join(f"case when {on} then {w} else 0.0 end" for on, _, w in _REL) + ") * 100"


def _relevance(b):
    c = F.col
    low = F.lower("cancer_type")
    gap = F.abs(c("age") - c("median_age"))
    stage = F.lower("stage_text")
    axes = [
        (F.lit(True), m.tiered((low.contains(c("site")), 20), full=25) + F.when(~low.contains(c("site")), 0.4).otherwise(0.0), 25),
        (c("histology").isNotNull(), m.tiered((F.coalesce(low, F.lit("")).contains(c("histology")), 15), full=15), 15),
        (c("stage").isNotNull(), m.tiered((stage.contains(F.concat(F.lit("stage "), F.lower("stage"))), 10), (stage.contains(F.lower("stage")), 6), full=10), 10),
        (c("modality").isNotNull(), m.tiered((c("study_modality").contains(c("modality")), 10), (c("study_modality").contains("chemo"), 5), full=10), 10),
        (c("marker").isNotNull(), m.tiered((F.lower(F.coalesce("molecular_subtype", F.lit(""))).contains(c("marker")), 10), full=10), 10),
        (c("median_age").isNotNull(), m.tiered((gap <= 5, 5), (gap <= 10, 3), (gap <= 15, 1), full=5), 5),
    ]
    return _pairs(b).withColumn("relevance", m.case_similarity(axes) * 100)


_RELV_SQL = f"{STUDY_SQL}, rv as (select case_id, study_id, score, round({_REL_SQL}, 9) as relevance from pr)"


@query(
    "patient_relevance",
    f"WITH {_RELV_SQL} select case_id, study_id, {sq6('relevance')} as relevance, row_number() over (partition by case_id order by relevance desc, study_id) as rank from rv",
    "studies cases",
)
def _patient_relevance(b):
    rows = _relevance(b).withColumn("relevance", F.round("relevance", 9))
    return _ordered(rows, "relevance").select("case_id", "study_id", rnd6(F.col("relevance")).alias("relevance"), "rank")


@query(
    "combined_score",
    f"WITH {_RELV_SQL}, v as (select case_id, study_id, round(0.6 * score / 500000 + 0.4 * relevance / 100, 9) as combined from rv) select case_id, study_id, {sq6('combined')} as combined, row_number() over (partition by case_id order by combined desc, study_id) as rank from v",
    "studies cases",
)
def _combined(b):
    rows = _relevance(b).withColumn("combined", F.round(0.6 * F.col("score") / 500000 + 0.4 * F.round("relevance", 9) / 100, 9))
    return _ordered(rows, "combined").select("case_id", "study_id", rnd6(F.col("combined")).alias("combined"), "rank")


@query(
    "sort_by_preference",
    f"""WITH s as (select study_id, coalesce({k.percent('overall_survival')}, 0.0) + 0.8 * coalesce({k.percent('progression_free_survival')}, 0.0) as o from studies) select study_id, round(o, 6) as outcome from s""",
    "studies",
)
def _sort_pref(b):
    rows = b.studies.select(
        "study_id", "number_of_patients", "publish_date", "citation_count", F.lit(0.0).alias("relevance"),
        parse.extract_percent(F.col("overall_survival")).alias("os_rate_percent"), parse.extract_percent(F.col("progression_free_survival")).alias("pfs_rate_percent"),
    )
    out = m.sort_by_preference(rows, "outcomes")
    return out.select("study_id", F.round(F.col("sort_key").cast("double"), 6).alias("outcome"))


# ---- structured match --------------------------------------------------------------------------

_PRESENT = ["cancer_site", "histology", "stage", "treatment", "biomarker_jsonb", "age_range"]
_USER = {"stage": 2.0, "biomarker_jsonb": 0.5, "age_range": 9.0}
_FACTOR = {n: max(0.0, min(3.0, _USER.get(n, 1.0))) for n in _PRESENT}
_RANK = {n: i for i, n in enumerate(m.BASE_WEIGHTS)}
WEIGHTS_SQL = f"""pc as (select case_id, criterion from cases, (values {', '.join(f"('{n}')" for n in _PRESENT)}) v(criterion)
      where case criterion when 'histology' then histology is not null when 'biomarker_jsonb' then marker is not null else true end),
    pw as (select case_id, criterion, case criterion {' '.join(f"when '{n}' then {m.BASE_WEIGHTS[n] * _FACTOR[n]}" for n in _PRESENT)} end as raw, case criterion {' '.join(f"when '{n}' then {_RANK[n]}" for n in _PRESENT)} end as rk from pc),
    pz as (select *, cast(round_even(cast(raw as double) * (100 / sum(cast(raw as double)) over (partition by case_id)), 0) as int) as w0 from pw),
    wt as (select case_id, criterion, cast(w0 + case when row_number() over (partition by case_id order by w0 desc, rk) = 1 then 100 - sum(w0) over (partition by case_id) else 0 end as int) as weight from pz)"""


def _present(b):
    c = F.col
    entries = F.array_compact(F.array(
        F.lit("cancer_site"), F.when(c("histology").isNotNull(), "histology"), F.lit("stage"), F.lit("treatment"),
        F.when(c("marker").isNotNull(), "biomarker_jsonb"), F.lit("age_range"),
    ))
    return b.cases.select("case_id", F.explode(entries).alias("criterion"))


@query("dynamic_weights", f"WITH {WEIGHTS_SQL} select case_id, criterion, weight from wt", "cases")
def _weights(b):
    return m.dynamic_weights(_present(b), _USER)


def _marker_sql(name: str) -> str:
    return k.case_rules("lower(molecular_subtype)", [(p, s) for p, n, s in rules.MARKER_PATTERNS if n == name])


_BIO_SQL = """case when marker is null then null when marker = 'her2' and her2 is not null then case marker_status when 'positive' then her2 in ('positive', 'high', 'amplified', 'mutant') else her2 in ('negative', 'low', 'wild-type', 'stable') end
      when marker = 'er' and er is not null then case marker_status when 'positive' then er in ('positive', 'high', 'amplified', 'mutant') else er in ('negative', 'low', 'wild-type', 'stable') end end"""


def _stage_sql(p: str, s: str) -> str:
    clean = lambda c: f"upper(trim(regexp_replace(trim({c}), '(?i)^stage\\s*', '')))"
    p, s = clean(p), clean(s)
    idx = lambda c: f"list_position(['I', 'II', 'III', 'IV'], {c})"
    one, span = "^(III|II|IV|I)([A-C]?)$", "^(III|II|IV|I)\\s*[-–]\\s*(III|II|IV|I)$"
    g = lambda c, pt, i: f"regexp_extract({c}, '{pt}', {i})"
    return f"""case when coalesce({p}, '') = '' or coalesce({s}, '') = '' then 'MISMATCH' when {p} = {s} then 'MATCH'
      when {g(s, span, 1)} <> '' then case when {idx(g(p, one, 1))} between {idx(g(s, span, 1))} and {idx(g(s, span, 2))} then 'COMPATIBLE' else 'MISMATCH' end
      when {g(p, one, 1)} <> '' and {g(p, one, 1)} = {g(s, one, 1)} and ({g(p, one, 2)} = '') <> ({g(s, one, 2)} = '') then 'COMPATIBLE' else 'MISMATCH' end"""


MATCH_SQL = f"""{STUDY_SQL}, {WEIGHTS_SQL}, wp as (select case_id, {', '.join(f"max(case when criterion = '{n}' then weight end) as w_{n}" for n in _PRESENT)} from wt group by 1),
    mk as (select pr.*, {_marker_sql('HER2')} as her2, {_marker_sql('ER')} as er, {_stage_sql('stage', 'stage_text')} as sv from pr),
    mb as (select *, {_BIO_SQL} as bio from mk),
    ax as (select mb.*, wp.* exclude (case_id), 1.0 * w_cancer_site as axis_cancer_site, (case when contains(lower(cancer_type), histology) then 1.0 else 0.0 end) * coalesce(w_histology, 0) as axis_histology,
      (case sv when 'MATCH' then 1.0 when 'COMPATIBLE' then 0.7 else 0.0 end) * w_stage as axis_stage, (case when contains(study_modality, modality) then 1.0 else 0.0 end) * w_treatment as axis_treatment,
      (case when bio then 1.0 else 0.0 end) * coalesce(w_biomarker_jsonb, 0) as axis_biomarker_jsonb, coalesce(case when abs(age - median_age) <= 10 then 1 - abs(age - median_age) / 10 else 0.0 end, 0.0) * w_age_range as axis_age_range
      from mb join wp using (case_id) where not coalesce(not bio, false)),
    sc as (select *, round(axis_cancer_site + axis_histology + axis_stage + axis_treatment + axis_biomarker_jsonb + axis_age_range, 9) as total from ax),
    sm as (select *, row_number() over (partition by case_id order by total desc, number_of_patients desc nulls last, study_id) as rank from sc qualify rank <= {TOP})"""


def _weight_map(b):
    rows = m.dynamic_weights(_present(b), _USER)
    return rows.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("criterion", "weight"))).alias("weights"))


def _structured(b):
    c = F.col
    pairs = _pairs(b).join(_weight_map(b), "case_id")
    bio = m.map_alias_match(c("status_map"), c("marker"), c("marker_status"))
    verdict = m.stage_verdict(c("case_stage"), c("study_stage"))
    rows = pairs.withColumn("bio", bio).withColumn("sv", verdict).filter(m.contra_exclusion(~c("bio")))
    yes = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0)
    shares = {
        "cancer_site": F.lit(1.0),
        "histology": yes(F.lower("cancer_type").contains(c("histology"))),
        "stage": F.when(c("sv") == "MATCH", 1.0).when(c("sv") == "COMPATIBLE", 0.7).otherwise(0.0),
        "treatment": yes(c("study_modality").contains(c("modality"))),
        "biomarker_jsonb": yes(c("bio")),
        "age_range": m.age_share(c("age"), c("median_age")),
    }
    return m.structured_match(rows.drop("score"), shares, "weights", TOP)


@query("structured_match", f"WITH {MATCH_SQL} select case_id, study_id, {sq6('total')} as score, rank, {sq6('axis_stage')} as axis_stage, {sq6('axis_treatment')} as axis_treatment from sm", "studies cases")
def _structured_match(b):
    out = _structured(b)
    return out.select("case_id", "study_id", rnd6(F.col("score")).alias("score"), "rank", rnd6(F.col("axis_stage")).alias("axis_stage"), rnd6(F.col("axis_treatment")).alias("axis_treatment"))


_BREAK_SQL = " union all ".join(f"select case_id, study_id, '{n}' as axis, axis_{n} as earned, cast(coalesce(w_{n}, 0) as double) as possible from sm" for n in _PRESENT)


@query(
    "match_breakdown",
    f"WITH {MATCH_SQL}, l as ({_BREAK_SQL}) select case_id, study_id, axis, {sq6('earned')} as earned, possible, case when earned >= possible then 'exact' when earned > 0 then 'partial' else 'not reported' end as label from l where possible > 0",
    "studies cases",
)
def _breakdown(b):
    # The weights of a case are joined to its best studies again: the sort of all candidates need not hold a map a row.
    best = _structured(b).drop("weights").join(_weight_map(b), "case_id")
    return m.match_breakdown(best, _PRESENT, "weights").withColumn("earned", rnd6(F.col("earned")))


@query(
    "map_alias_match",
    f"WITH {STUDY_SQL}, mk as (select pr.*, {_marker_sql('HER2')} as her2, {_marker_sql('ER')} as er from pr) select case_id, study_id, {_BIO_SQL} as matched from mk where marker is not null",
    "studies cases",
)
def _alias(b):
    rows = _pairs(b).filter(F.col("marker").isNotNull())
    return rows.select("case_id", "study_id", m.map_alias_match(F.col("status_map"), F.col("marker"), F.col("marker_status")).alias("matched"))


@query(
    "contra_exclusion",
    f"WITH {STUDY_SQL}, mk as (select pr.*, {_marker_sql('HER2')} as her2, {_marker_sql('ER')} as er from pr), x as (select case_id, study_id, {_BIO_SQL} as bio from mk) select case_id, study_id from x where not coalesce(not bio, false)",
    "studies cases",
)
def _contra(b):
    bio = m.map_alias_match(F.col("status_map"), F.col("marker"), F.col("marker_status"))
    return _pairs(b).withColumn("bio", bio).filter(m.contra_exclusion(~F.col("bio"))).select("case_id", "study_id")


@query(
    "fractional_score",
    f"""WITH t as (select study_id, ['surgery', 'chemo', case when region_key > 2 then 'radio' else 'immuno' end] as w, modality || ' ' || coalesce(cancer_type, '') as x from studies) select study_id, {sq6("len(list_filter(w, lambda t: contains(lower(x), t))) / len(w) * 10")} as score from t""",
    "studies",
)
def _fractional(b):
    wanted = F.array(F.lit("surgery"), F.lit("chemo"), F.when(F.col("region_key") > 2, "radio").otherwise("immuno"))
    text = F.concat("modality", F.lit(" "), F.coalesce("cancer_type", F.lit("")))
    return b.studies.select("study_id", rnd6(m.fractional_score(wanted, text, 10.0)).alias("score"))


# Profile against study axes: customer arrays against the arrays of the order placed.
_OVERLAP_SQL = """t as (select o_orderkey, list_filter([p.site], lambda x: x is not null) as pt, list_filter([case when o_orderstatus = 'F' then p.site when o_orderstatus = 'O' then 'Lung' end], lambda x: x is not null) as stt,
      list_filter(string_split(p.markers, ','), lambda x: x <> '') as pb, case when extract(month from o_orderdate) < 9 then ['HER2 positive', 'EGFR'] else [] end as sb, [p.stage] as pst, case o_orderpriority when '1-URGENT' then ['IIA', 'iii'] when '2-HIGH' then ['I'] else [] end as sst from orders join profiles p on o_custkey = p.profile_id),
    h as (select *, len(list_filter(pt, lambda x: list_contains(list_transform(stt, lambda y: lower(y)), lower(x)))) as ht, len(list_filter(pb, lambda x: len(list_filter(sb, lambda y: contains(lower(y), lower(x)) or contains(lower(x), lower(y)))) > 0)) as hb, len(list_filter(pst, lambda x: list_contains(list_transform(sst, lambda y: lower(y)), lower(x)))) as hs from t),
    w as (select *, (case when len(pt) > 0 and len(stt) > 0 then 25.0 * ht / len(pt) else 0.0 end) + (case when len(pst) > 0 and len(sst) > 0 then 10.0 * hs / len(pst) else 0.0 end) + (case when len(pb) > 0 and len(sb) > 0 then 15.0 * hb / len(pb) else 0.0 end) as ws,
      (case when len(pt) > 0 and len(stt) > 0 then 25.0 else 0.0 end) + (case when len(pst) > 0 and len(sst) > 0 then 10.0 else 0.0 end) + (case when len(pb) > 0 and len(sb) > 0 then 15.0 else 0.0 end) as strict,
      (case when len(pt) > 0 then 25.0 else 0.0 end) + (case when len(pst) > 0 then 10.0 else 0.0 end) + (case when len(pb) > 0 then 15.0 else 0.0 end) as legacy from h),
    d as (select *, case when strict > 0 and (len(pt) = 0 or len(stt) > 0) then strict else legacy end as den, len(pt) > 0 and len(stt) > 0 and ht = 0 as wrong from w),
    s as (select *, case when den = 0 then 0.0 else round_even(100.0 * cast(ws as double) / den, 0) end as raw from d),
    f as (select *, case when wrong then least(raw, 35.0) else raw end as capped_score from s)"""


def _overlap_rows(b):
    c = F.col
    joined = b.orders.join(b.profiles, c("o_custkey") == c("profile_id"))
    empty = F.array().cast("array<string>")
    return joined.select(
        "o_orderkey",
        F.array_compact(F.array("site")).alias("p_cancer_type"),
        F.array_compact(F.array(F.when(c("o_orderstatus") == "F", c("site")).when(c("o_orderstatus") == "O", F.lit("Lung")))).alias("s_cancer_type"),
        F.filter(F.split("markers", ","), lambda x: x != "").alias("p_biomarkers"),
        F.when(F.month("o_orderdate") < 9, F.array(F.lit("HER2 positive"), F.lit("EGFR"))).otherwise(empty).alias("s_biomarkers"),
        F.array("stage").alias("p_stages"),
        F.when(c("o_orderpriority") == "1-URGENT", F.array(F.lit("IIA"), F.lit("iii"))).when(c("o_orderpriority") == "2-HIGH", F.array(F.lit("I"))).otherwise(empty).alias("s_stages"),
    )


@query("profile_overlap", f"WITH {_OVERLAP_SQL} select o_orderkey, cast(capped_score as double) as score, wrong and raw > 35 as capped from f", "profiles")
def _overlap(b):
    return m.profile_overlap(_overlap_rows(b), ["cancer_type", "stages", "biomarkers"]).select("o_orderkey", "score", "capped")


@query("profile_overlap_floor", f"WITH {_OVERLAP_SQL} select o_orderkey, cast(least(capped_score, case when legacy > 0 then round_even(100.0 * cast(ws as double) / legacy, 0) else capped_score end) as double) as score from f", "profiles")
def _overlap_floor(b):
    return m.profile_overlap(_overlap_rows(b), ["cancer_type", "stages", "biomarkers"], cap_lower_denominator=True).select("o_orderkey", "score")


# ---- verdicts ----------------------------------------------------------------------------------

_AXES = list(m.VERDICT_WEIGHTS)
_SOFT_SQL = " + ".join(f"(case {a} when 'MATCH' then 1.0 when 'COMPATIBLE' then 0.7 when 'PARTIAL' then 0.4 when 'MISMATCH' then -0.2 else 0.0 end) * {w}" for a, w in m.VERDICT_WEIGHTS.items())


@query("soft_score", f"select pair_id, {sq6(f'({_SOFT_SQL}) / 75.0 * 100')} as soft, {sq6(f'0.7 * score + 0.3 * (({_SOFT_SQL}) / 75.0)')} as blended from verdicts", "verdicts")
def _soft(b):
    return m.soft_score(b.verdicts, _AXES).select("pair_id", rnd6(F.col("soft")).alias("soft"), rnd6(F.col("blended")).alias("blended"))


_HARD_N = "cast(histology = 'MISMATCH' as int) + cast(stage = 'MISMATCH' as int) + cast(prior_treatment = 'MISMATCH' as int)"
_SOFT_N = "cast(biomarkers = 'MISMATCH' as int) + cast(setting = 'MISMATCH' as int)"
_TIER_SQL = f"""v as (select doc_id as query_id, pair_id || '-' || query_id as pair_id, score, {_HARD_N} as hn, {_SOFT_N} as sn, case when setting = 'MATCH' then 0.2 else 0.0 end as boost from verdicts),
    el as (select query_id, pair_id, score, hn + sn as mismatches, case when hn > 0 then 'hard_filter' when sn > 0 then 'penalty' else 'boost' end as tier,
      case when hn > 0 then score when sn > 0 then greatest(0.0, score - least(sn * 0.15, 0.45)) else least(1.0, score + boost) end as final_score from v)"""


def _eligible(b):
    rows = b.verdicts.withColumn("pair_id", F.concat("pair_id", F.lit("-"), F.col("query_id").cast("string"))).withColumn("query_id", F.col("doc_id"))
    return m.tiered_eligibility(rows, _AXES, F.when(F.col("setting") == "MATCH", 0.2).otherwise(0.0))


@query("tiered_eligibility", f"WITH {_TIER_SQL} select pair_id, tier, mismatches, {sq6('final_score')} as final_score from el", "verdicts")
def _tiered(b):
    return _eligible(b).select("pair_id", "tier", "mismatches", rnd6(F.col("final_score")).alias("final_score"))


@query(
    "eligibility_fallback",
    f"""WITH {_TIER_SQL}, kc as (select query_id, count(*) as n from el where tier <> 'hard_filter' group by 1), rm as (select *, row_number() over (partition by query_id order by mismatches, score desc, pair_id) as r from el where tier = 'hard_filter')
    select query_id, pair_id, {sq6('final_score')} as final_score, false as restored from el where tier <> 'hard_filter'
    union all select query_id, pair_id, {sq6('score * 0.3')}, true from rm left join kc using (query_id) where r <= 3 - coalesce(n, 0)""",
    "verdicts",
)
def _fallback(b):
    out = m.eligibility_fallback(_eligible(b).select("query_id", "pair_id", "score", "mismatches", "tier", "final_score"))
    return out.select("query_id", "pair_id", rnd6(F.col("final_score")).alias("final_score"), "restored")


@query(
    "stage_subsumption",
    f"WITH t as (select l_orderkey, l_linenumber, l_partkey, case l_returnflag when 'A' then 'IIIA' when 'N' then 'II' else 'Stage iv' end as p, case when l_quantity < 10 then 'Stage III' when l_quantity < 20 then 'I-II' when l_quantity < 30 then 'stage II - IV' when l_quantity < 40 then 'IIB' else 'IV' end as s from lineitem) select l_orderkey, l_linenumber, l_partkey, {_stage_sql('p', 's')} as verdict from t",
)
def _stage(b):
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    p = F.when(flag == "A", "IIIA").when(flag == "N", "II").otherwise("Stage iv")
    s = F.when(q < 10, "Stage III").when(q < 20, "I-II").when(q < 30, "stage II - IV").when(q < 40, "IIB").otherwise("IV")
    return b.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", m.stage_subsumption(p, s).alias("verdict"))


# ---- applicability -----------------------------------------------------------------------------

_MATCH_SQL = "case when {t} is null then 0.5 when {g} = 'all' then 0.75 when {t} = {g} or contains(lower(x), {t}) then 1.0 when {g} is not null then 0.0 else 0.5 end"
_APP_SQL = f"""a as (select study_id, lower(coalesce(cancer_type, '') || ' ' || modality) as x, case region_key when 0 then 'treatment' when 1 then 'diagnosis' when 2 then 'symptom' else 'other' end as intent, price / 600000 as semantic,
      case when region_key < 3 then 'breast' end as pc, case when status = 'P' then 'all' when status = 'F' then 'lung' end as gc, case when priority < '3' then 'surgery' end as pm, case when priority in ('1-URGENT', '4-NOT SPECIFIED') then 'radiotherapy' end as gm from studies),
    ac as (select study_id, intent, semantic, {_MATCH_SQL.format(t='pc', g='gc')} as cancer, {_MATCH_SQL.format(t='pm', g='gm').replace("when gm = 'all' then 0.75 ", '')} as modality, pm is not null and gm is not null and pm <> gm and not contains(x, pm) as conflict from a)"""


def _weight_case(name: str) -> str:
    return "case intent " + " ".join(f"when '{i}' then {w[name]}" for i, w in m.INTENT_WEIGHTS.items()) + f" else {m.INTENT_WEIGHTS['general'][name]} end"


@query(
    "applicability",
    f"""WITH {_APP_SQL} select study_id, cast(cancer as double) as cancer, cast(modality as double) as modality, conflict, {sq6(f"(({_weight_case('semantic')}) * semantic + ({_weight_case('cancer')}) * cancer + ({_weight_case('modality')}) * modality + ({_weight_case('authority')}) * 0.75) * case when conflict then 0.65 else 1.0 end")} as applicability_score from ac""",
    "studies",
)
def _applicability(b):
    c = F.col
    one = lambda cond, v: F.array_compact(F.array(F.when(cond, v)))
    s = b.studies
    rows = s.select(
        "study_id", F.concat(F.coalesce("cancer_type", F.lit("")), F.lit(" "), "modality").alias("x"), (c("price") / 600000).alias("semantic"),
        F.when(c("region_key") == 0, "treatment").when(c("region_key") == 1, "diagnosis").when(c("region_key") == 2, "symptom").otherwise("other").alias("intent"),
        one(c("region_key") < 3, "breast").alias("pc"), F.array_compact(F.array(F.when(c("status") == "P", "all").when(c("status") == "F", "lung"))).alias("gc"),
        one(c("priority") < "3", "surgery").alias("pm"), one(c("priority").isin("1-URGENT", "4-NOT SPECIFIED"), "radiotherapy").alias("gm"),
    )
    scored = rows.withColumn("cancer", m.set_match(c("pc"), c("gc"), c("x"), "all")).withColumn("modality", m.set_match(c("pm"), c("gm"), c("x"))).withColumn("authority", F.lit(0.75))
    conflict = (F.size("pm") > 0) & (F.size("gm") > 0) & ~F.arrays_overlap("pm", "gm") & ~F.exists("pm", lambda t: F.lower(c("x")).contains(t))
    marked = scored.withColumn("conflict", conflict)
    out = m.applicability(marked, ["semantic", "cancer", "modality", "authority"], "intent", c("conflict"))
    return out.select("study_id", "cancer", "modality", "conflict", rnd6(c("applicability_score")).alias("applicability_score"))


@query(
    "freshness_decay",
    f"""select study_id, {sq6("case when y is null then 0.5 when greatest(0, 2015 - y) <= 3 then 1.0 when greatest(0, 2015 - y) >= 15 then 0.2 else 1.0 - (greatest(0, 2015 - y) - 3) / 12 * 0.8 end")} as freshness from (select study_id, case when status <> 'P' then pub_year + 8 end as y from studies)""",
    "studies",
)
def _freshness(b):
    year = F.when(F.col("status") != "P", F.col("pub_year") + 8)
    return b.studies.select("study_id", rnd6(m.freshness(year, 2015)).alias("freshness"))


_INC_SQL = """t as (select o_orderkey, p.age, case when o_orderstatus <> 'P' then 18 + extract(month from o_orderdate) end as lo, case when o_orderstatus = 'F' then 40 + extract(day from o_orderdate) end as hi, case when p.sex = 'male' then 2 else 1 end as ecog, case when o_orderpriority < '4' then 1 end as emax from orders join profiles p on p.profile_id = o_custkey),
    c as (select *, case when lo is null and hi is null then 'unknown' when coalesce(age < lo, false) or coalesce(age > hi, false) then 'hard' end as a, case when emax is null then 'unknown' when ecog > emax then 'hard' end as e from t)"""


def _trial_rows(b):
    c = F.col
    return b.orders.join(b.profiles, c("o_custkey") == c("profile_id")).select(
        "o_orderkey", "age", F.when(c("o_orderstatus") != "P", 18 + F.month("o_orderdate")).alias("lo"), F.when(c("o_orderstatus") == "F", 40 + F.dayofmonth("o_orderdate")).alias("hi"),
        F.when(c("sex") == "male", 2).otherwise(1).alias("ecog"), F.when(c("o_orderpriority") < "4", 1).alias("emax"),
    )


@query("join_interval", f"WITH {_INC_SQL} select o_orderkey, a as age_check, e as ecog_check from c", "profiles")
def _interval(b):
    none = F.lit(None).cast("int")
    return _trial_rows(b).select(
        "o_orderkey", m.bound_check(F.col("age"), F.col("lo"), F.col("hi")).alias("age_check"), m.bound_check(F.col("ecog"), none, F.col("emax")).alias("ecog_check")
    )


@query(
    "incompatibility",
    f"""WITH {_INC_SQL} select o_orderkey, concat_ws('; ', case when a is not null then 'trial_age_incompatible:' || a || ':' || age end, case when e is not null then 'ECOG_incompatible:' || e || ':' || ecog end) as findings,
      cast(case when coalesce(a = 'hard', false) or coalesce(e = 'hard', false) then 0.65 else 1.0 end as double) as factor from c""",
    "profiles",
)
def _incompatibility(b):
    c = F.col
    none = F.lit(None).cast("int")
    text = lambda x: x.cast("string")
    found = m.incompatibilities([
        ("trial_age_incompatible", m.bound_check(c("age"), c("lo"), c("hi")), text(c("age")), F.concat_ws("-", text(c("lo")), text(c("hi")))),
        ("ECOG_incompatible", m.bound_check(c("ecog"), none, c("emax")), text(c("ecog")), F.concat(F.lit("<= "), text(c("emax")))),
    ])
    rows = _trial_rows(b).select("o_orderkey", found.alias("f"))
    hard = F.exists("f", lambda x: x["severity"] == "hard")
    return rows.select(
        "o_orderkey", F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["type"], x["severity"], x["patient"])), "; ").alias("findings"),
        F.when(hard, 1 - m.HARD_PENALTY).otherwise(1.0).alias("factor"),
    )


@query(
    "authority_blend",
    f"""select d.doc_id, {sq6("0.85 * n_chars / 20000 + 0.15 * case coalesce(tier, 0) when 1 then 1.0 when 2 then 0.85 when 3 then 0.7 when 4 then 0.55 when 5 then 0.45 when 6 then 0.35 else 0.5 end")} as blended from documents d left join sources s on s.source_key = d.source""",
    "sources",
)
def _authority(b):
    rows = b.documents.select("doc_id", F.col("source").alias("source_key"), "n_chars").join(b.sources, "source_key", "left")
    return rows.select("doc_id", rnd6(m.authority_blend(F.col("n_chars") / 20000, F.col("tier"))).alias("blended"))


_CAL = "greatest(0.0, least(0.95, case when s >= 10 then 0.90 + least((s - 10) * 0.01, 0.05) when s >= 7 then 0.75 + (s - 7) * 0.05 when s >= 4 then 0.55 + (s - 4) * 0.067 when s >= 1 then 0.35 + (s - 1) * 0.067 when s >= -2 then 0.15 + (s + 2) * 0.067 else greatest(0.0, 0.15 + (s + 2) * 0.05) end))"


@query(
    "score_calibration",
    f"""WITH t as (select doc_id as query_id, chunk_id, score_lex * 12 - 3 as s from hits), w as (select query_id, max(s) as hi, min(s) as lo, count(*) as n from t group by 1)
    select chunk_id, {sq6(f'case when n > 1 and hi - lo > 0 and hi - lo < 3 then greatest(0.10, {_CAL} - (1 - (s - lo) / (hi - lo)) * 0.15) else {_CAL} end')} as calibrated from t join w using (query_id)""",
    "hits",
)
def _calibration(b):
    rows = b.hits.select(F.col("doc_id").alias("query_id"), "chunk_id", (F.col("score_lex") * 12 - 3).alias("s"))
    return m.calibrated_scores(rows, "s").select("chunk_id", rnd6(F.col("calibrated")).alias("calibrated"))


@query(
    "trial_score",
    f"""WITH t as (select o_orderkey, lower(n.text) as x, p.site, p.sex, p.age, p.stage, [try_cast(v as int) for v in regexp_extract_all('enrols ' || extract(day from o_orderdate) + 20 || ' years to ' || extract(day from o_orderdate) + 50 || ' yrs', '(\\d{{1,3}})\\s*(?:years?|yrs?)', 1)] as nums, p.markers
      from orders join profiles p on p.profile_id = o_custkey join notes n on n.note_id = o_orderkey),
    c as (select *, coalesce(contains(x, site), false) as c1, contains(x, 'stage ' || lower(stage)) as c2, age between list_min(nums) and list_max(nums) as c3, contains(x, sex) as c4, contains(x, 'ecog') and contains(x, '1') as c5, contains(markers, 'her2') and contains(x, 'her2') as c6 from t)
    select o_orderkey, {sq6('least(1.0, (case when c1 then 0.30 else 0.0 end) + (case when c2 then 0.08 else 0.0 end) + (case when c3 then 0.08 else 0.0 end) + (case when c4 then 0.05 else 0.0 end) + (case when c5 then 0.05 else 0.0 end) + (case when c6 then 0.04 else 0.0 end))')} as score,
      concat_ws(', ', case when c1 then 'type' end, case when c2 then 'stage' end, case when c3 then 'age' end, case when c4 then 'sex' end, case when c5 then 'ecog' end, case when c6 then 'marker' end) as reasons from c""",
    "profiles notes",
)
def _trial(b):
    c = F.col
    day = F.dayofmonth("o_orderdate")
    eligibility = F.concat(F.lit("enrols "), (day + 20).cast("string"), F.lit(" years to "), (day + 50).cast("string"), F.lit(" yrs"))
    rows = b.orders.join(b.profiles, c("o_custkey") == c("profile_id")).join(b.notes.select(c("note_id").alias("o_orderkey"), F.lower("text").alias("x")), "o_orderkey")
    x = c("x")
    score, reasons = m.trial_score([
        (x.contains(c("site")), F.lit("type"), 0.30), (x.contains(F.concat(F.lit("stage "), F.lower("stage"))), F.lit("stage"), 0.08),
        (m.age_in_text(c("age"), eligibility), F.lit("age"), 0.08), (x.contains(c("sex")), F.lit("sex"), 0.05),
        (x.contains("ecog") & x.contains("1"), F.lit("ecog"), 0.05), (c("markers").contains("her2") & x.contains("her2"), F.lit("marker"), 0.04),
    ])
    return rows.select("o_orderkey", rnd6(score).alias("score"), F.array_join(reasons, ", ").alias("reasons"))


# ---- filling and candidates --------------------------------------------------------------------


@query(
    "similar_fill",
    """WITH s as (select query_id, part_id as doc_id from hits where flag = 'A' and discount > 0.09), v as (select query_id, part_id as doc_id, score_dense as score from hits),
    u as (select query_id, doc_id, 0.9 as score, 0 as src from s union all select query_id, doc_id, score, 1 from v), x as (select * from u where doc_id <> query_id),
    b as (select query_id, doc_id, arg_min(score, (src, -score)) as score, min(src) as src from x group by 1, 2)
    select query_id, doc_id, src, cast(score as double) as score, row_number() over (partition by query_id order by src, score desc, doc_id) as rank from b qualify rank <= 15""",
    "hits",
)
def _similar(b):
    hits = b.hits.withColumn("doc_id", F.col("part_id"))
    structured = hits.filter((F.col("flag") == "A") & (F.col("discount") > 0.09))
    return m.similar_fill(structured, hits.withColumn("score", F.col("score_dense")), 15, F.col("doc_id") == F.col("query_id"))


@query(
    "record_candidates",
    """WITH sg as (select c_custkey as signal_id, c_nationkey as owner, case c_mktsegment when 'BUILDING' then 'breast cancer' when 'AUTOMOBILE' then 'lung' when 'MACHINERY' then '' else 'rectal' end as site, case when c_acctbal < 4000 then 'II' else 'IVB' end as stage from customer),
    rc as (select s_suppkey as record_id, s_nationkey as owner, case when s_acctbal < 3000 then 'breast' when s_acctbal < 6000 then 'small cell lung' else '' end as site, case when s_acctbal < 5000 then 'IIA' else 'IV' end as stage from supplier),
    j as (select signal_id, record_id, cast(sg.site <> '' and rc.site <> '' and (contains(sg.site, rc.site) or contains(rc.site, sg.site)) as int) + cast(contains(lower(sg.stage), lower(rc.stage)) or contains(lower(rc.stage), lower(sg.stage)) as int) as score,
      (sg.site <> '' and rc.site <> '' and not (contains(sg.site, rc.site) or contains(rc.site, sg.site))) or not (contains(lower(sg.stage), lower(rc.stage)) or contains(lower(rc.stage), lower(sg.stage))) as conflict from sg join rc using (owner))
    select signal_id, arg_max(record_id, (score, -record_id)) as record_id, max(score) as score, arg_max(conflict, (score, -record_id)) as conflict, count(*) as candidates from j where score > 0 group by 1""",
)
def _candidates(b):
    seg, bal, sup = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("s_acctbal")
    signals = b.customer.select(
        F.col("c_custkey").alias("signal_id"), F.col("c_nationkey").alias("owner"),
        F.when(seg == "BUILDING", "breast cancer").when(seg == "AUTOMOBILE", "lung").when(seg == "MACHINERY", "").otherwise("rectal").alias("site"),
        F.when(bal < 4000, "II").otherwise("IVB").alias("stage"),
    )
    records = b.supplier.select(
        F.col("s_suppkey").alias("record_id"), F.col("s_nationkey").alias("owner"),
        F.when(sup < 3000, "breast").when(sup < 6000, "small cell lung").otherwise("").alias("site"), F.when(sup < 5000, "IIA").otherwise("IV").alias("stage"),
    )
    return m.record_candidates(signals, records, "owner", ["site", "stage"])


# ---- query text --------------------------------------------------------------------------------


@query(
    "range_expand",
    """WITH t as (select o_orderkey, cast(extract(month from o_orderdate) as int) % 4 as lo, extract(day from o_orderdate) as d, 20 + cast(extract(day from o_orderdate) as int) * 2 as age from orders)
    select o_orderkey, array_to_string(list_transform(flatten(list_transform(range(lo, lo + 2), lambda v: ['ECOG ' || v, 'PS ' || v, 'performance status ' || v])), lambda x: x), ';') as ecog,
      array_to_string(flatten(list_transform(list_filter([1, 5, 10, 20, 50], lambda c: c <= d * 2), lambda c: ['CPS ≥ ' || c, 'CPS >= ' || c])) || ['CPS ' || d * 2, 'CPS score ' || d * 2] || case when d * 2 >= 50 then ['PD-L1 high', 'high CPS'] else [] end || ['PD-L1 positive', 'CPS positive'], ';') as cps,
      array_to_string(case when age = age // 10 * 10 then [cast(age as varchar)] else [cast(age as varchar), cast(age // 10 * 10 as varchar)] end || case when age >= 65 then ['elderly', 'older adult'] when age < 40 then ['young adult'] else [] end, ';') as age from t""",
)
def _ranges(b):
    lo = (F.month("o_orderdate") % 4).cast("int")
    ecog = F.concat(lo.cast("string"), F.lit("-"), (lo + 1).cast("string"))
    cps = F.concat(F.lit("CPS "), (F.dayofmonth("o_orderdate") * 2).cast("string"))
    age = (F.dayofmonth("o_orderdate") * 2 + 20).cast("string")
    return b.orders.select(
        "o_orderkey", *[F.array_join(m.range_expand(kind, value), ";").alias(kind) for kind, value in (("ecog", ecog), ("cps", cps), ("age", age))]
    )


_ADDED_SQL = " || ".join(f"case when contains(low, {k.q(t)}) then [{', '.join(k.q(x) for x in terms)}] else [] end" for t, terms in m.QUERY_SYNONYMS.items())


@query(
    "query_expand",
    f"""WITH t as (select note_id, text, lower(text) as low, case when contains(text, 'ECOG 1') then ['ECOG 1', 'PS 1', 'performance status 1'] else ['ECOG 0', 'PS 0', 'performance status 0'] end as extra from notes),
    e as (select *, list_sort(list_distinct(list_filter({_ADDED_SQL} || extra, lambda x: not contains(low, lower(x))))) as added from t) select note_id, case when len(added) > 0 then text || ' ' || array_to_string(added, ' ') else text end as expanded from e""",
    "notes",
)
def _expand_query(b):
    value = F.when(F.col("text").contains("ECOG 1"), "1").otherwise("0")
    return b.notes.select("note_id", m.query_expand(F.col("text"), m.range_expand("ecog", value)).alias("expanded"))


@query(
    "threshold_status",
    """WITH t as (select l_orderkey, l_linenumber, l_partkey, case l_returnflag when 'A' then 'CPS ≥ ' || cast(l_quantity as int) when 'N' then case l_linestatus when 'F' then 'Ki-67 ' || cast(l_quantity as int) || '%' else 'PD-L1 TPS ' || cast(l_quantity as int) * 2 - 2 || '%' end else 'Oncotype  DX recurrence score of ' || cast(l_quantity as int) end as marker, l_returnflag as f, l_linestatus as ls, cast(l_quantity as int) as q from lineitem)
    select l_orderkey, l_linenumber, l_partkey, case when f = 'A' then case when q >= 20 then 'PD-L1:high' else 'PD-L1:positive' end when f = 'N' and ls = 'F' then case when q >= 20 then 'Ki-67:high' else 'Ki-67:low' end
      when f = 'N' then case when q = 1 then 'PD-L1:negative' when q * 2 - 2 >= 50 then 'PD-L1:high' else 'PD-L1:positive' end when q < 11 then 'ONCOTYPE:low' when q < 26 then 'ONCOTYPE:intermediate' else 'ONCOTYPE:high' end as status from t""",
)
def _threshold(b):
    q = F.col("l_quantity").cast("int")
    s = lambda c: c.cast("string")
    marker = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("CPS ≥ "), s(q))).when(
        F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Ki-67 "), s(q), F.lit("%"))).otherwise(F.concat(F.lit("PD-L1 TPS "), s(q * 2 - 2), F.lit("%")))
    ).otherwise(F.concat(F.lit("Oncotype  DX recurrence score of "), s(q)))
    return b.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", m.threshold_status(marker).alias("status"))


_SIGN_SQL = " + ".join(f"(case when regexp_matches(text, {k.q(p)}) then {n} else 0 end)" for p, n in m.PATIENT_SIGNS)


@query("signal_score", f"select note_id, {_SIGN_SQL} as points, ({_SIGN_SQL}) >= 2 as is_patient from notes", "notes")
def _signal(b):
    points = m.signal_score(F.col("text"))
    return b.notes.select("note_id", points.alias("points"), (points >= 2).alias("is_patient"))


@query("threshold_stage", "select event_id, 'T' || greatest(case when value / 10 <= 2 then 1 when value / 10 <= 4 then 2 else 3 end, case when extract(minute from ts) / 4 <= 5 then 1 when extract(minute from ts) / 4 <= 10 then 2 else 3 end) as t_stage from events")
def _threshold_stage(b):
    return b.events.select("event_id", m.threshold_stage(F.col("value") / 10, F.minute("ts") / 4).alias("t_stage"))


_LAY_SQL = " || ".join(f"case when regexp_matches(text, {k.q(p)}) then [{', '.join(k.q(t) for t in terms)}] else [] end" for p, terms in m.LAY_TERMS)


@query(
    "vocab_expand",
    f"""select note_id, array_to_string(list_filter({_LAY_SQL}, lambda t: not contains(lower(text), lower(t))), ';') as added, concat_ws(',', {', '.join(f"case when not regexp_matches(text, {k.q(p)}) then '{n}' end" for n, p in m.AXIS_WORDS)}) as gaps from notes""",
    "notes",
)
def _vocab(b):
    text = F.col("text")
    return b.notes.select("note_id", F.array_join(m.vocab_expand(text), ";").alias("added"), F.array_join(m.missing_axes(text), ",").alias("gaps"))


@query(
    "regimen_expand",
    """WITH t as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'folfox ' when '2-HIGH' then 'TCHP' when '3-MEDIUM' then 'AC-T' else 'Cisplatin' end as regimen from orders),
    d as (select *, unnest(case upper(trim(regimen)) when 'FOLFOX' then ['folinic acid', 'fluorouracil', 'oxaliplatin'] when 'TCHP' then ['docetaxel', 'carboplatin', 'trastuzumab', 'pertuzumab'] when 'AC-T' then ['doxorubicin', 'cyclophosphamide', 'paclitaxel'] else [lower(trim(regimen))] end) as drug from t) select * from d""",
)
def _regimen(b):
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "folfox ").when(p == "2-HIGH", "TCHP").when(p == "3-MEDIUM", "AC-T").otherwise("Cisplatin")
    return m.regimen_expand(b.orders.select("o_orderkey", name.alias("regimen")), "o_orderkey", "regimen")
