"""Filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import rules
from cohortloom.operators import filters
from cohortloom.plans import sqlkit as k
from cohortloom.plans.registry import query
from cohortloom.session import rule_table

PREFS = {
    "study_types": ["Randomized controlled trial", "Prospective cohort", "Phase II randomized trial"],
    "min_patients": 50,
    "max_patients": 400,
    "min_publication_year": 1995,
    "exclude_treatment_modalities": ["cohort"],
    "race_ethnicities": ["Asian", "Black"],
}
RACE_SQL = "(race_ethnicity ilike '%asian%' or race_ethnicity ilike '%chinese%' or race_ethnicity ilike '%japanese%' or race_ethnicity ilike '%korean%' or race_ethnicity ilike '%black%' or race_ethnicity ilike '%african american%' or race_ethnicity is null or race_ethnicity = '')"
PREF_SQL = f"""study_type in ('Randomized controlled trial', 'Prospective cohort', 'Phase II randomized trial')
  and number_of_patients >= 50 and number_of_patients <= 400 and year(cast(publish_date as date)) >= 1995
  and not (study_type ilike '%cohort%') and {RACE_SQL}"""


@query(
    "preference_filter",
    f"select study_id, study_type, number_of_patients, race_ethnicity from studies where {PREF_SQL}",
    "studies",
)
def _preference(b):
    return filters.preference_filter(b.studies, PREFS).select("study_id", "study_type", "number_of_patients", "race_ethnicity")


@query(
    "valid_ids",
    """select distinct doc_id from studies where doc_id is not null and number_of_patients >= 100
    and (study_phase ilike '%phase iii%' or study_phase ilike '%phase 3%') and study_type ilike '%random%'""",
    "studies",
)
def _valid(b):
    return filters.valid_doc_ids(b.studies, {"min_patients": 100, "study_phases": ["Phase III", "Phase 3"], "study_types": ["random"]})


_WORDS = [w for g in ("surgery", "immunotherapy") for w in rules.MODALITY_WORDS[g]]


@query(
    "keyword_any_filter",
    f"select study_id, modality from studies where {k.has_any('lower(modality || chr(32) || coalesce(cancer_type, chr(32)))', _WORDS)}",
    "studies",
)
def _keyword_any(b):
    text = F.concat_ws(" ", "modality", F.coalesce("cancer_type", F.lit(" ")))
    return filters.keyword_any_filter(b.studies, text, ["surgery", "immunotherapy"]).select("study_id", "modality")


@query(
    "profile_search",
    """select study_id, cancer_type, publish_date from studies where (cancer_type ilike '%breast%' or cancer_type ilike '%lung%')
    and (stage_text ilike '%IIIA%' or stage_text ilike '%IV%') order by publish_date desc nulls last, study_id limit 20""",
    "studies",
)
def _profile_search(b):
    axes = {"site": (["cancer_type"], ["breast", "lung"]), "stage": (["stage_text"], ["IIIA", "IV"]), "histology": (["cancer_type"], [])}
    return filters.profile_search(b.studies, axes, 20).select("study_id", "cancer_type", "publish_date")


@query(
    "exists_filter",
    """select study_id, cancer_type from studies s where cancer_type ilike '%cancer%'
    and exists (select 1 from stages d where d.study_id = s.study_id and d.stage_category ilike 'III%')""",
    "studies stages",
)
def _exists(b):
    rows = b.studies.filter(F.col("cancer_type").ilike("%cancer%"))
    return filters.exists_filter(rows, b.stages, "study_id", F.col("stage_category").ilike("III%")).select("study_id", "cancer_type")


@query(
    "hard_soft_filter",
    """WITH m as (select query_id, chunk_id, coalesce(section = 'Results' and qty > 49, false) as is_hard,
      cast(flag = 'R' as int) * 0.15 as soft_boost from hits),
    s as (select query_id, max(is_hard) as any_hard from m group by 1)
    select query_id, chunk_id, is_hard, any_hard, cast(soft_boost as double) as soft_boost from m join s using (query_id) where is_hard or not any_hard""",
    "hits",
)
def _hard_soft(b):
    hard = (F.col("section") == "Results") & (F.col("qty") > 49)
    out = filters.hard_filter_with_fallback(b.hits.select("query_id", "chunk_id", "section", "qty", "flag"), "query_id", hard, F.col("flag") == "R")
    return out.select("query_id", "chunk_id", "is_hard", "any_hard", F.col("soft_boost").cast("double").alias("soft_boost"))


@query(
    "must_not",
    "select study_id, modality from studies where not list_has_any(string_split(modality, ','), ['surgery', 'chemotherapy'])",
    "studies",
)
def _must_not(b):
    rows = b.studies.withColumn("terms", F.split("modality", ","))
    return filters.must_not(rows, "terms", ["surgery", "chemotherapy"]).select("study_id", "modality")


# Spellings of the categories searched together.
_VARIANTS = [("BUILDING", "breast"), ("building", "breast"), ("MACHINERY", "prostate"), ("HOUSEHOLD", "gi")]


@query(
    "category_variants",
    """select c_custkey, c_mktsegment, category from customer join (values ('BUILDING', 'breast'), ('building', 'breast'),
      ('MACHINERY', 'prostate'), ('HOUSEHOLD', 'gi')) v(spelling, category) on c_mktsegment = spelling""",
)
def _variants(b):
    table = rule_table(b.spark, _VARIANTS, "c_mktsegment string, category string")
    return b.customer.join(table, "c_mktsegment").select("c_custkey", "c_mktsegment", "category")


@query(
    "governance_filter",
    """select d.doc_id, d.source as source_key from documents d left join sources s on d.source = s.source_key
    where s.source_key is null or (s.is_active and s.patient_facing and (s.intents is null or list_contains(string_split(s.intents, ','), 'staging')))""",
    "sources",
)
def _governance(b):
    cands = b.documents.select("doc_id", F.col("source").alias("source_key"))
    return filters.governance_filter(cands, b.sources, "patient", "staging")




@query(
    "skip_sections",
    f"""WITH t as (select chunk_id, section, 'Department of medicine, University hospital. ' || flag || case when line_status = 'F' then ' patient dose'  else '' end as text from hits),
    h as (select *, trim(regexp_replace(regexp_replace(lower(trim(section)), '[#*_\\-\\d.]+', ' ', 'g'), '\\s+', ' ', 'g')) as name, lower(text) as head from t),
    n as (select *, {' + '.join(f"cast(contains(head, {k.q(w)}) as int)" for w in filters.AFFILIATION_WORDS)} as aff,
      {' + '.join(f"cast(contains(head, {k.q(w)}) as int)" for w in filters.CONTENT_WORDS)} as cont from h)
    select chunk_id, section, {k.has_any('name', filters.SKIPPED_SECTIONS)} or (aff >= 3 and cont <= 1) as skipped from n""",
    "hits",
)
def _skip(b):
    text = F.concat(
        F.lit("Department of medicine, University hospital. "), F.col("flag"),
        F.when(F.col("line_status") == "F", " patient dose").otherwise(""),
    )
    return b.hits.select("chunk_id", "section", filters.skip_section(F.col("section"), text).alias("skipped"))


@query(
    "section_type",
    f"""WITH t as (select chunk_id, section, case when flag = 'A' then 'In conclusion, survival rose' else 'plain words' end as text from hits)
    select chunk_id, coalesce({k.case_rules("trim(regexp_replace(lower(trim(section)), '^#+', ''))", rules.SECTION_PATTERNS)},
      {k.case_rules('lower(text)', rules.SECTION_PATTERNS)}, 'other') as section_type from t""",
    "hits",
)
def _section_type(b):
    text = F.when(F.col("flag") == "A", "In conclusion, survival rose").otherwise("plain words")
    return b.hits.select("chunk_id", rules.section_type(F.col("section"), text).alias("section_type"))


@query(
    "min_confidence",
    """select chunk_id, level from (select chunk_id, case when score_dense > 0.6 then 'high' when score_dense > 0.3 then 'medium' else 'low' end as level, score_lex from hits)
    where case level when 'high' then 2 when 'medium' then 1 else 0 end >= 1 and score_lex >= 0.3""",
    "hits",
)
def _min_confidence(b):
    level = F.when(F.col("score_dense") > 0.6, "high").when(F.col("score_dense") > 0.3, "medium").otherwise("low")
    ordinal = F.when(F.col("level") == "high", 2).when(F.col("level") == "medium", 1).otherwise(0)
    return b.hits.withColumn("level", level).filter((ordinal >= 1) & (F.col("score_lex") >= 0.3)).select("chunk_id", "level")


@query(
    "id_normalised_join",
    """WITH l as (select doc_id || '_' || substr(md5(doc_id), 1, 8) as raw_id, score from abstracts)
    select raw_id, s.doc_id, s.citation_count from l join studies s on regexp_replace(l.raw_id, '_[a-f0-9]{6,}$', '') = s.doc_id""",
    "abstracts studies",
)
def _id_join(b):
    left = b.abstracts.select(F.concat("doc_id", F.lit("_"), F.substring(F.md5("doc_id"), 1, 8)).alias("raw_id"))
    keyed = left.withColumn("doc_id", filters.strip_hash_suffix(F.col("raw_id")))
    return keyed.join(b.studies.select("doc_id", "citation_count"), "doc_id").select("raw_id", "doc_id", "citation_count")


@query(
    "loose_eq",
    """select study_id, coalesce(lower(trim(study_phase)), '') = coalesce(lower(trim(cancer_type)), '') as same_text,
      case when modality = '' and stage_text = '' then true else list_has_any(string_split(modality, ','), ['surgery', 'radiotherapy']) end as overlap from studies""",
    "studies",
)
def _loose(b):
    listed = F.array(F.lit("surgery"), F.lit("radiotherapy"))
    return b.studies.select(
        "study_id",
        filters.loose_equal(F.col("study_phase"), F.col("cancer_type")).alias("same_text"),
        filters.loose_equal_arrays(F.split("modality", ","), listed).alias("overlap"),
    )


@query(
    "conflict_filter",
    """WITH t as (select query_id, chunk_id, case when query_id < 70 then 'A' when query_id < 90 then 'Z' else null end as wanted, nullif(flag, 'R') as found from hits),
    m as (select *, wanted is null or found is null or wanted = found as keep from t),
    s as (select query_id, count_if(keep) as kept, count(*) as total from m group by 1)
    select query_id, chunk_id, wanted, found from m join s using (query_id) where keep or (kept < 2 and total >= 2)""",
    "hits",
)
def _conflict(b):
    wanted = F.when(F.col("query_id") < 70, "A").when(F.col("query_id") < 90, "Z")
    rows = b.hits.select("query_id", "chunk_id", wanted.alias("wanted"), F.nullif("flag", F.lit("R")).alias("found"))
    return filters.conflict_filter(rows, "query_id", "wanted", "found")


@query("filter_impact", f"select count_if({PREF_SQL}) as matching, count(*) as total from studies", "studies")
def _impact(b):
    race = filters.any_of([F.col("race_ethnicity").ilike(f"%{w}%") for w in ("asian", "chinese", "japanese", "korean", "black", "african american")])
    condition = filters.all_of([
        F.col("study_type").isin(PREFS["study_types"]),
        F.col("number_of_patients").between(50, 400),
        F.year(F.col("publish_date").try_cast("date")) >= 1995,
        ~F.col("study_type").ilike("%cohort%"),
        race | F.col("race_ethnicity").isNull() | (F.col("race_ethnicity") == ""),
    ])
    return filters.filter_impact(b.studies, condition)


@query(
    "ci_list_filter",
    "select study_id, study_phase from studies where lower(trim(study_phase)) in ('phase iii', 'phase ii') and lower(country) in ('nation_1', 'nation_2', 'nation_3')",
    "studies",
)
def _ci_list(b):
    condition = filters.ci_list_filter(F.col("study_phase"), ["Phase III ", "PHASE ii"]) & filters.ci_list_filter(F.col("country"), ["Nation_1", "nation_2", "NATION_3"])
    return b.studies.filter(condition & filters.ci_list_filter(F.col("status"), [])).select("study_id", "study_phase")


@query(
    "source_gate",
    """WITH f as (select query_id, doc_id, case flag when 'A' then 'frame' when 'N' then 'structured' else case when line_status = 'F' then 'vector' else 'other' end end as lane, score_dense as score from hits),
    r as (select *, case lane when 'both' then 3 when 'frame' then 2 when 'structured' then 1 when 'vector' then 0 else -1 end as trust from f),
    g as (select query_id, doc_id, arg_max(lane, trust) as lane, max(score) as score from r group by 1, 2),
    t as (select *, cast(case lane when 'frame' then 0.28 when 'both' then 0.28 when 'structured' then 0.35 when 'vector' then 0.5 else 0.45 end as double) as threshold from g)
    select * from t where score >= threshold""",
    "hits",
)
def _source_gate(b):
    lane = F.when(F.col("flag") == "A", "frame").when(F.col("flag") == "N", "structured").when(F.col("line_status") == "F", "vector").otherwise("other")
    return filters.source_gate(b.hits.select("query_id", "doc_id", lane.alias("lane"), F.col("score_dense").alias("score")))


# Polarity pairs that contradict each other.
CONTRADICTIONS = [("mutant", "wild-type"), ("wild-type", "mutant"), ("positive", "negative"), ("negative", "positive")]


@query(
    "pair_exclusion",
    """WITH t as (select pair_id, case histology when 'MATCH' then 'positive' when 'COMPATIBLE' then 'mutant' else null end as mine,
      case stage when 'MATCH' then 'negative' when 'PARTIAL' then 'wild-type' when 'NA' then null else 'positive' end as theirs,
      case setting when 'MATCH' then 'First_line' else null end as line_a, case biomarkers when 'MATCH' then 'refractory' else 'adjuvant' end as line_b from verdicts)
    select * from t where not coalesce((mine = 'mutant' and theirs = 'wild-type') or (mine = 'wild-type' and theirs = 'mutant') or (mine = 'positive' and theirs = 'negative')
      or (mine = 'negative' and theirs = 'positive'), false)
      and not coalesce((lower(line_a) in ('treatment_naive', 'first_line') and line_b in ('second_line', 'later_line', 'refractory'))
      or (lower(line_a) in ('second_line', 'later_line', 'refractory') and line_b in ('treatment_naive', 'first_line')), false)""",
    "verdicts",
)
def _pair_exclusion(b):
    rows = b.verdicts.select(
        "pair_id",
        F.when(F.col("histology") == "MATCH", "positive").when(F.col("histology") == "COMPATIBLE", "mutant").alias("mine"),
        F.when(F.col("stage") == "MATCH", "negative").when(F.col("stage") == "PARTIAL", "wild-type").when(F.col("stage") == "MISMATCH", "positive").alias("theirs"),
        F.when(F.col("setting") == "MATCH", "First_line").alias("line_a"),
        F.when(F.col("biomarkers") == "MATCH", "refractory").otherwise("adjuvant").alias("line_b"),
    )
    pairs = rule_table(b.spark, CONTRADICTIONS, "mine string, theirs string")
    return rows.join(pairs, ["mine", "theirs"], "left_anti").filter(~filters.trajectory_conflict(F.col("line_a"), F.col("line_b")))


@query(
    "array_overlap",
    "select study_id from studies where list_has_any(string_split(modality, ','), ['immunotherapy', 'radiotherapy'])",
    "studies",
)
def _overlap(b):
    wanted = F.array(F.lit("immunotherapy"), F.lit("radiotherapy"))
    return b.studies.filter(F.arrays_overlap(F.split("modality", ","), wanted)).select("study_id")
