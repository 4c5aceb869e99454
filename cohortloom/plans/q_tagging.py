"""Tagging and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import tagging as t
from cohortloom.plans import sqlkit as k
from cohortloom.plans.registry import query


def vocab_sql(entries) -> str:
    return ", ".join(f"({k.q(v)}, {k.q(c)}, {k.q(s)})" for c, s, variants in entries for v in variants)


def occ_sql(entries, key: str = "note_id", src: str = "notes") -> str:
    return f"""vc as (select * from (values {vocab_sql(entries)}) v(variant, canonical, slot)), lw as (select {key}, lower(text) as low from {src}),
    sg as (select {key}, low, variant, canonical, slot, regexp_split_to_array(low, case when contains(variant, ' ') then '\\Q' || variant || '\\E' else '\\b\\Q' || variant || '\\E\\b' end) as segs from lw join vc on contains(low, variant)),
    oc as (select {key}, low, variant, canonical, slot, cast(list_sum(list_transform(segs[1:n], lambda s: length(s))) as bigint) + (n - 1) * length(variant) as start from (select *, unnest(range(1, len(segs))) as n from sg where len(segs) > 1)),
    occ as (select *, start + length(variant) as fin from oc)"""


def before_sql(n: int) -> str:
    return f"regexp_replace(substr(low, greatest(0, start - {n}) + 1, start - greatest(0, start - {n})), '(?s)^.*[.;!?]', '')"


def after_sql(n: int) -> str:
    return f"regexp_replace(substr(low, fin + 1, {n}), '(?s)[.;!?].*$', '')"


NEG_SQL = f"(regexp_matches({before_sql(60)}, {k.q(t.NEG_BEFORE)}) or regexp_matches({after_sql(35)}, {k.q(t.NEG_AFTER)}))"
NEG_EMB_SQL = f"(regexp_matches({before_sql(60)}, {k.q(t.NEG_BEFORE)}) or (not regexp_matches(variant, {k.q(t.EMBEDDED_STATUS)}) and regexp_matches({after_sql(35)}, {k.q(t.NEG_AFTER)})))"
STATUS_SQL = f"""coalesce(case when regexp_matches(lower(canonical), '-(?:high|h)\\b') then 'high' when regexp_matches(lower(canonical), '-(?:low|l)\\b') then 'low' end,
  case when regexp_extract({after_sql(20)}, {k.q(t.STATUS_VALUE)}, 1) <> '' then 'value:' || regexp_extract({after_sql(20)}, {k.q(t.STATUS_VALUE)}, 1) || coalesce(regexp_extract({after_sql(20)}, {k.q(t.STATUS_VALUE)}, 2), '') end,
  {k.case_rules(after_sql(20), t.STATUS_AFTER)}, {k.case_rules(before_sql(30), t.STATUS_BEFORE)})"""
SLOTS_SQL = "('biomarker', 'alteration', 'imaging', 'serum_marker')"
ROUTE_SQL = f"""{occ_sql(t.VOCABULARY)}, rt as (select note_id, slot, canonical, bool_and({NEG_EMB_SQL}) as all_neg, count(*) as mentions, list_sort(list_filter(list(distinct {STATUS_SQL}), lambda x: x is not null)) as st from occ group by 1, 2, 3),
    routed as (select note_id, slot, canonical, mentions, case when slot in {SLOTS_SQL} then array_to_string(st, '/') else '' end as statuses from rt where slot in {SLOTS_SQL} or not all_neg)"""


def _occ(b):
    return t.occurrences(b.notes, "note_id", "text")


def _routed(b):
    return t.by_text(b.notes, "note_id", "text", t.routed_text)


@query(
    "term_variants",
    """WITH d as (select distinct lower(trim(p_type)) || '_' || lower(p_brand) || case when p_size > 25 then '/neu' else '_≥' || p_size end as term from part),
    v as (select term, list_distinct(list_filter([term, replace(term, '_', ' '), replace(term, '_', '-'), case when contains(term, '≥') then replace(term, '≥', '>=') end, case when contains(term, '≥') then replace(term, '≥', ' ') end,
      case when contains(term, '≥') then replace(term, '_≥', ' ') end, case when contains(term, '≥') then replace(term, '_≥', '≥') end, case when contains(term, '/') and length(term) > 4 then replace(term, '/', ' ') end, case when contains(term, '/') and length(term) > 4 then replace(term, '/', '-') end], lambda x: x is not null)) as vs from d)
    select term, array_to_string(list_sort(vs), '|') as variants from v""",
)
def _variants(b):
    tail = F.when(F.col("p_size") > 25, "/neu").otherwise(F.concat(F.lit("_≥"), F.col("p_size").cast("string")))
    terms = b.part.select(F.concat(F.lower(F.trim("p_type")), F.lit("_"), F.lower("p_brand"), tail).alias("term")).distinct()
    return terms.select("term", F.array_join(F.array_sort(t.term_variants(F.col("term"))), "|").alias("variants"))


@query(
    "term_match",
    "select note_id, regexp_matches(lower(text), '\\ber\\b') as er, regexp_matches(lower(text), '\\bpd-l1\\b') as pdl1, contains(lower(text), 'bone met') as bone from notes",
    "notes",
)
def _match(b):
    c = F.col("text")
    return b.notes.select("note_id", t.term_match(c, "er").alias("er"), t.term_match(c, "pd-l1").alias("pdl1"), t.term_match(c, "bone met").alias("bone"))


@query("negation", f"WITH {occ_sql(t.VOCABULARY)} select note_id, variant, start, {NEG_SQL} as negated from occ", "notes")
def _negation(b):
    return _occ(b).select("note_id", "variant", "start", t.negated().alias("negated"))


@query("status_detect", f"WITH {occ_sql(t.VOCABULARY)} select note_id, variant, start, {STATUS_SQL} as status from occ where slot in {SLOTS_SQL}", "notes")
def _status(b):
    return _occ(b).filter(F.col("slot").isin(list(t.STATUS_SLOTS))).select("note_id", "variant", "start", t.status().alias("status"))


@query("slot_routing", f"WITH {ROUTE_SQL} select * from routed", "notes")
def _routing(b):
    return _routed(b).withColumn("statuses", F.array_join("statuses", "/"))


_ROMAN_SQL = "case {g} when '1' then 'I' when '2' then 'II' when '3' then 'III' when '4' then 'IV' else upper({g}) end"
STAGES_SQL = f"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(text, {k.q(t.STAGE_RE)}, 1), regexp_extract_all(text, {k.q(t.STAGE_RE)}, 2)), lambda z: 'Stage ' || {_ROMAN_SQL.format(g='z[1]')} || upper(coalesce(z[2], '')))))"


def _g(i: int) -> str:
    return f"lower(coalesce(regexp_extract(text, {k.q(t.TNM_RE)}, {i}), ''))"


TNM_SQL = f"list_sort(list_filter([case when {_g(2)} <> '' then {_g(1)} || 'T' || {_g(2)} || {_g(3)} end, case when {_g(4)} <> '' then {_g(1)} || 'N' || {_g(4)} || {_g(5)} end, case when {_g(6)} <> '' then {_g(1)} || 'M' || {_g(6)} end], lambda x: x is not null))"
DEMO_SQL = "list_sort(list_distinct(" + " || ".join(f"list_transform(regexp_extract_all(text, {k.q(p)}, 1), lambda v: '{n}:' || v)" for n, p in t.DEMOGRAPHICS) + "))"


@query(
    "stage_extract",
    f"""WITH s as (select note_id, array_to_string({STAGES_SQL}, ',') as stages, array_to_string({TNM_SQL}, ',') as tnm, try_cast(nullif(regexp_extract(text, {k.q(t.GLEASON_RE)}, 1), '') as int) as a, try_cast(nullif(regexp_extract(text, {k.q(t.GLEASON_RE)}, 2), '') as int) as b from notes)
    select note_id, stages, tnm, case when a is not null then 'Gleason ' || a || '+' || b || '=' || (a + b) end as grade from s""",
    "notes",
)
def _stage(b):
    c = F.col("text")
    return b.notes.select("note_id", F.array_join(t.stage_extract(c), ",").alias("stages"), F.array_join(t.tnm_extract(c), ",").alias("tnm"), t.grade_extract(c).alias("grade"))


@query("demographics", f"select note_id, array_to_string({DEMO_SQL}, ',') as demographics from notes", "notes")
def _demo(b):
    return b.notes.select("note_id", F.array_join(t.demographics(F.col("text")), ",").alias("demographics"))


def _slot_agg(slot: str) -> str:
    return f"coalesce(string_agg(distinct case when slot = '{slot}' then canonical end, ',' order by case when slot = '{slot}' then canonical end), '') as {slot}"


@query(
    "tag_text",
    f"""WITH {ROUTE_SQL}, pt as (select note_id, {', '.join(_slot_agg(s) for s in ('site', 'histology', 'drug', 'disease_status'))},
      coalesce(string_agg(distinct case when slot in {SLOTS_SQL} then canonical || '=' || statuses end, ',' order by case when slot in {SLOTS_SQL} then canonical || '=' || statuses end), '') as markers from routed group by 1)
    select note_id, array_to_string({STAGES_SQL}, ',') as stages, array_to_string({TNM_SQL}, ',') as tnm, array_to_string({DEMO_SQL}, ',') as demographics, site, histology, drug, disease_status, markers from notes left join pt using (note_id)""",
    "notes",
)
def _tag(b):
    return t.tag_text(b.notes, "note_id", "text")


_CLASS_SQL = ", ".join(f"({k.q(v)}, {k.q(c)}, {k.q(f)}, {w})" for v, c, f, w in t.CLASS_EVIDENCE)


@query(
    "weighted_class",
    f"""WITH {occ_sql([(v, f, [v]) for v, _, f, _ in t.CLASS_EVIDENCE])}, lv as (select note_id, variant from occ group by 1, 2 having not bool_and({NEG_SQL})), ev as (select * from (values {_CLASS_SQL}) e(variant, class, field, weight)),
    s as (select note_id, class, cast(sum(weight) as double) as score, bool_or(field in ('label', 'synonyms', 'related_diseases')) as spec, bool_or(variant not in ({', '.join(k.q(g) for g in t.GENERIC_TERMS)})) as ng from lv join ev using (variant) group by 1, 2)
    select note_id, class, score from s where ng and (spec or score >= 2.5)""",
    "notes",
)
def _class(b):
    return t.weighted_class(b.notes, "note_id", "text")


@query(
    "family_rollup",
    f"""WITH {ROUTE_SQL}, m as (select note_id, array_to_string(list_sort(list(distinct case canonical when 'Glioblastoma' then 'Glioma' when 'Melanoma' then 'Melanoma' else 'Carcinoma' end)), ',') as f from routed where slot = 'histology' group by 1)
    select note_id, coalesce(f, concat_ws(',', {', '.join(f"case when regexp_matches(lower(text), '\\b{w.lower()}\\b') then '{w}' end" for w in sorted(t.FAMILY_WORDS))})) as families, f is null as from_words from notes left join m using (note_id)""",
    "notes",
)
def _family(b):
    return t.family_rollup(_routed(b), b.notes, "note_id", "text").withColumn("families", F.array_join("families", ","))


@query(
    "primary_mention",
    f"WITH {occ_sql(t.VOCABULARY)} select note_id, canonical from occ where slot = 'site' group by 1, 2 having not bool_and(regexp_matches(substr(low, fin + 1, 15), {k.q(t.METASTATIC_AFTER)}))",
    "notes",
)
def _primary(b):
    return t.primary_mention(_occ(b), "note_id")


@query(
    "subject_pick",
    f"""WITH {occ_sql(t.VOCABULARY)}, p as (select note_id, canonical, start, fin, regexp_matches(substr(low, greatest(0, start - 150) + 1, start - greatest(0, start - 150)), {k.q(t.HISTORICAL)}) as past from occ where slot = 'histology')
    select note_id, arg_max(canonical, (not past, start, fin)) as subject, arg_max(past, (not past, start, fin)) as historical from p group by 1""",
    "notes",
)
def _subject(b):
    return t.subject_pick(_occ(b), "note_id", ["histology"])


# Groups of interchangeable concept names.
_GROUPS = [["HER2", "ERBB2"], ["Osimertinib", "Tagrisso", "EGFR TKI"], ["Glioblastoma", "GBM"], ["Lung", "Pulmonary"]]


@query(
    "synonym_expand",
    f"""WITH {ROUTE_SQL}, g(canonical, synonym) as (values {', '.join(f"({k.q(a)}, {k.q(b_)})" for g in _GROUPS for a in g for b_ in g if a != b_)}), a as (select distinct note_id, synonym from routed join g using (canonical))
    select note_id, array_to_string(list_sort(list(synonym)), ',') as synonyms from a where not exists (select 1 from routed r where r.note_id = a.note_id and r.canonical = a.synonym) group by 1""",
    "notes",
)
def _synonyms(b):
    expanded = lambda df, key, text: t.synonym_expand(t.routed_text(df, key, text), key, _GROUPS)
    return t.by_text(b.notes, "note_id", "text", expanded).withColumn("synonyms", F.array_join("synonyms", ","))


@query(
    "regex_flags",
    f"select note_id, concat_ws(',', {', '.join(f"case when regexp_matches(text, {k.q(p)}) then '{n}' end" for n, p in t.TRAJECTORY)}) as flags, concat_ws(',', {', '.join(f"case when regexp_matches(text, {k.q(p)}) then '{n}' end" for n, p in t.MET_SITES)}) as met_sites from notes",
    "notes",
)
def _flags(b):
    c = F.col("text")
    return b.notes.select("note_id", F.array_join(t.regex_flags(c, t.TRAJECTORY), ",").alias("flags"), F.array_join(t.regex_flags(c, t.MET_SITES), ",").alias("met_sites"))


@query(
    "expr_parse",
    f"""WITH z as (select note_id, unnest(list_zip(regexp_extract_all(text, {k.q(t.EXPR_RE)}, 1), regexp_extract_all(text, {k.q(t.EXPR_RE)}, 2), regexp_extract_all(text, {k.q(t.EXPR_RE)}, 3), regexp_extract_all(text, {k.q(t.EXPR_RE)}, 4))) as z from notes),
    e as (select note_id, upper(z[1]) as name, coalesce(z[2], '') as b, coalesce(z[3], '') as value, lower(coalesce(z[4], '')) as d from z)
    select distinct note_id, name, case when w in ('+', 'positive') then '+' when w in ('-', 'negative') then '-' when w = 'mutant' then 'mutant' when starts_with(w, 'wild') then 'wt' when w = '≤' then '<=' when w = '≥' then '>=' when w = '' then '=' else w end as op, value from (select *, case when d <> '' then d else lower(b) end as w from e)""",
    "notes",
)
def _expr(b):
    return t.expression_parse(b.notes, "note_id", "text")


# ---- findings ----------------------------------------------------------------------------------


def find_sql(kind: str, pattern: str, groups: int) -> str:
    g = lambda i: f"regexp_extract_all(text, {k.q(pattern)}, {i})"
    none = "list_transform(" + g(0) + ", lambda x: null::varchar)"
    return f"""select study_id, '{kind}' as kind, unnest({g(1)}) as v, unnest({g(2) if groups > 1 else none}) as e, unnest({g(3) if groups > 2 else none}) as f, unnest({g(0)}) as raw, unnest(range(len({g(0)}))) as pos from abstracts"""


FIND_SQL = "fl as (" + " union all ".join(find_sql(kind, p, n) for kind, p, n in t.FINDINGS) + "), finds as (select study_id, kind, pos, try_cast(v as double) as value, try_cast(nullif(e, '') as double) as extra, try_cast(nullif(f, '') as double) as extra2, raw from fl)"


@query("findings_long", f"WITH {FIND_SQL} select * from finds", "abstracts")
def _findings(b):
    return t.findings_long(b.abstracts, ["study_id"], "text")


NUM_SQL = "nl as (" + " union all ".join(find_sql(kind, p, 1) for kind, p in t.NUMBERS) + "), nums as (select study_id, kind, pos, try_cast(v as double) as value, raw from nl)"


@query("numbers_long", f"WITH {NUM_SQL} select * from nums", "abstracts")
def _numbers(b):
    return t.numbers_long(b.abstracts, ["study_id"], "text")


@query(
    "extract_findings",
    f"""WITH o as (select study_id, regexp_extract_all(text, {k.q(t.OUTCOMES[0][1])}, 1) as os, regexp_extract_all(text, {k.q(t.OUTCOMES[1][1])}, 1) as hr, regexp_extract(text, {k.q(t.DOSE_RE)}, 1) as d, regexp_extract(text, {k.q(t.DOSE_RE)}, 2) as f from abstracts)
    select study_id, d || ' Gy in ' || f || ' fx' as dose, os[-1] as os, hr[-1] as hr from o""",
    "abstracts",
)
def _extract(b):
    c = F.col("text")
    last = lambda p: F.try_element_at(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.lit(-1))
    dose = F.concat(F.regexp_extract(c, t.DOSE_RE, 1), F.lit(" Gy in "), F.regexp_extract(c, t.DOSE_RE, 2), F.lit(" fx"))
    return b.abstracts.select("study_id", dose.alias("dose"), last(t.OUTCOMES[0][1]).alias("os"), last(t.OUTCOMES[1][1]).alias("hr"))


def _level_sql(col: str, factor: float) -> str:
    ordered = sorted(t.LEVEL_RULES, key=lambda r: (r[0], -r[3]))
    body = " ".join(f"when regexp_matches({col}, {k.q(p)}) then struct_pack(level := {lv}, type := {k.q(kd)}, confidence := cast({round(cf * factor, 3)} as double))" for lv, p, kd, cf in ordered)
    return f"case when length({col}) < 10 then null {body} end"


LEVEL_SQL = f"lv as (select study_id, coalesce({_level_sql('title', 1.0)}, {_level_sql('text', 0.7)}, struct_pack(level := 7, type := 'Unclassified', confidence := cast(0.0 as double))) as r from abstracts)"


def _levels(b):
    return b.abstracts.select("study_id", t.evidence_level([(F.col("title"), 1.0), (F.col("text"), 0.7)]).alias("r"))


@query("evidence_level", f"WITH {LEVEL_SQL} select study_id, r.level as level, r.type as type, r.confidence as confidence from lv", "abstracts")
def _level(b):
    return _levels(b).select("study_id", "r.level", "r.type", "r.confidence")


@query("level_census", f"WITH {LEVEL_SQL} select r.level as level, r.type as type, count(*) as n from lv group by 1, 2", "abstracts")
def _census(b):
    return _levels(b).groupBy(F.col("r.level").alias("level"), F.col("r.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "signal_confidence",
    """WITH s as (select l_orderkey, count_if(l_returnflag = 'A') as p, count_if(l_returnflag = 'N') as t, count_if(l_returnflag = 'R') as o from lineitem group by 1)
    select l_orderkey, p, t, o, case when p > 0 and t > 0 and o > 0 and p + t + o >= 10 then 'high' when (p > 0 and t > 0 and o > 0) or p + t + o >= 5 then 'medium' else 'low' end as confidence from s""",
)
def _signals(b):
    count = lambda f: F.count_if(F.col("l_returnflag") == f)
    rows = b.lineitem.groupBy("l_orderkey").agg(count("A").alias("p"), count("N").alias("t"), count("R").alias("o"))
    return rows.withColumn("confidence", t.signal_confidence(F.col("p"), F.col("t"), F.col("o")))


_OS, _HR = t.OUTCOMES[0][1], t.OUTCOMES[1][1]


@query(
    "frame_build",
    f"""WITH ch as (select note_id as doc, 0 as ord, 'n' || note_id as chunk_id, text from notes union all select study_id, 1, 'a' || study_id, text from abstracts),
    rd as (select doc, ord, chunk_id, ({STAGES_SQL})[1] as stage, nullif(array_to_string({TNM_SQL}, ''), '') as tnm, case when regexp_matches(text, '(?i)\\d\\s*Gy\\s*in\\s*\\d+') then regexp_extract(text, {k.q(t.DOSE_RE)}, 1) || ' Gy in ' || regexp_extract(text, {k.q(t.DOSE_RE)}, 2) || ' fx' end as dose,
      (regexp_extract_all(text, {k.q(_OS)}, 1))[-1] as os, (regexp_extract_all(text, {k.q(_HR)}, 1))[-1] as hr, case when contains(lower(text), 'chemotherapy') then 'chemotherapy' when contains(lower(text), 'surgery') then 'surgery' end as modality from ch),
    lv as (select *, os is not null or hr is not null as has_o from rd where stage is not null or tnm is not null or dose is not null or os is not null or hr is not null),
    g as (select doc, arg_min(stage, ord) filter (stage is not null) as stage, arg_min(tnm, ord) filter (tnm is not null) as tnm, arg_min(dose, ord) filter (dose is not null) as dose, arg_max(os, ord) filter (os is not null) as os, arg_max(hr, ord) filter (hr is not null) as hr,
      count_if(stage is not null or tnm is not null) as p, count_if(dose is not null) as tn, count_if(has_o) as o, coalesce(string_agg(distinct modality, ',' order by modality), '') as modalities, string_agg(chunk_id, ',' order by chunk_id) as evidence from lv group by 1)
    select doc, stage, tnm, dose, os, hr, modalities, evidence, case when p > 0 and tn > 0 and o > 0 and p + tn + o >= 10 then 'high' when (p > 0 and tn > 0 and o > 0) or p + tn + o >= 5 then 'medium' else 'low' end as confidence from g""",
    "notes abstracts",
)
def _frames(b):
    chunk = lambda df, key, n, tag: df.select(
        F.col(key).alias("doc"), F.lit(n).alias("ord"), F.concat(F.lit(tag), F.col(key).cast("string")).alias("chunk_id"), "text"
    )
    frames = t.frame_build(chunk(b.notes, "note_id", 0, "n").unionByName(chunk(b.abstracts, "study_id", 1, "a")), "doc", "ord", "text")
    return frames.select(
        "doc", "stage", "tnm", "dose", F.try_element_at("outcomes", F.lit("OS")).alias("os"), F.try_element_at("outcomes", F.lit("HR")).alias("hr"),
        F.array_join("modalities", ",").alias("modalities"), F.array_join("evidence_ids", ",").alias("evidence"), "confidence",
    )
