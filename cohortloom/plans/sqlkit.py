"""Small builders for the DuckDB side of the checks."""

from __future__ import annotations

from cohortloom.functions import rules


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(col: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}, {group}), '')"


def num(col: str, pattern: str) -> str:
    return f"try_cast({rx(col, pattern)} as double)"


def rnd(expr: str, digits: int) -> str:
    return f"cast(round(cast({expr} as decimal(38,10)), {digits}) as double)"


def xsum(expr: str) -> str:
    return f"cast(sum(cast({expr} as decimal(28,6))) as double)"


def xavg(expr: str) -> str:
    return f"({xsum(expr)} / count({expr}))"


def initcap(col: str) -> str:
    return f"array_to_string(list_transform(string_split({col}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def has_any(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def case_rules(col: str, pairs, default: str = "null") -> str:
    body = " ".join(f"when regexp_matches({col}, {q(p)}) then {q(v)}" for p, v in pairs)
    return f"case {body} else {default} end"


def phase(col: str) -> str:
    clean = f"trim({col})"
    body = " ".join(
        f"when lower({clean}) in ({', '.join(q(x) for x in [c.lower(), *[s.lower() for s in sp]])}) then {q(c)}"
        for c, sp in rules.PHASE_SPELLINGS
    )
    return f"case when {col} is null or {clean} = '' then null {body} else {initcap(clean)} end"


def disease(col: str) -> str:
    low = f"lower(trim({col}))"
    body = " ".join(f"when {has_any(low, needles)} then {q(name)}" for name, needles in rules.disease_rules())
    return f"case when {col} is null or trim({col}) = '' then null {body} else {initcap(f'trim({col})')} end"


def technique(col: str) -> str:
    low = f"lower(trim({col}))"
    table = [(n, [n.lower(), *[a.lower() for a in alt]]) for n, alt in rules.TECHNIQUE_SPELLINGS.items()]
    table.append(("Radiotherapy (unspecified)", ["radiotherapy", "radiation therapy"]))
    body = " ".join(f"when {has_any(low, needles)} then {q(name)}" for name, needles in table)
    return f"case when {col} is null or trim({col}) = '' then null {body} else {initcap(f'trim({col})')} end"


def percent(col: str) -> str:
    return num(col, r"(\d+\.?\d*)\s*%")


def months(col: str) -> str:
    return f"coalesce({num(col, r'(\d+\.?\d*)\s*months?')}, {num(col, r'(\d+\.?\d*)\s*years?')} * 12.0)"


def gy(col: str) -> str:
    return f"coalesce({num(col, r'(\d+\.?\d*)\s*-?\s*[Gg][Yy]')}, {num(col, r'(\d+\.?\d*)\s*[Gg]ray')})"


def fractions(col: str) -> str:
    return f"try_cast({rx(col, r'(\d+)\s*fr')} as integer)"


SUMMARY = f"""summary AS (
select study_id, document_name, study_name, doi, pmid, {disease('cancer_type')} as cancer_type,
  cancer_type as cancer_type_raw, {phase('study_phase')} as normalized_phase, study_phase as phase_raw,
  study_type as study_type_normalized, number_of_patients, study_institution, country,
  coalesce(study_type ilike '%random%', false) as is_randomized,
  coalesce(study_institution ilike '%multi%', false) or coalesce(contains(country, ','), false) as is_multi_center,
  {num('median_age', r'(\d+\.?\d*)')} as median_age_numeric,
  {percent('overall_survival')} as os_rate_percent, {months('overall_survival')} as os_median_months,
  {percent('progression_free_survival')} as pfs_rate_percent, {months('progression_free_survival')} as pfs_median_months,
  {percent('disease_free_survival')} as dfs_rate_percent, {months('disease_free_survival')} as dfs_median_months,
  {percent('local_control')} as lc_rate_percent, {months('median_followup')} as median_followup_months,
  overall_survival as os_raw, progression_free_survival as pfs_raw, local_control as lc_raw, median_followup as followup_raw
from studies)"""

RADIATION = f"""radiation AS (
select d.detail_id, d.study_id, s.document_name, {disease('s.cancer_type')} as cancer_type,
  {phase('s.study_phase')} as normalized_phase, d.technique as technique_raw, {technique('d.technique')} as normalized_technique,
  {gy('d.total_dose')} as total_dose_gy, {gy('d.fractionation')} as fraction_dose_gy,
  coalesce({fractions('d.fractionation')}, {fractions('d.total_dose')}) as fractions_from_text,
  {gy("json_extract_string(d.additional_details, '$.total_dose')")} as dose_from_json,
  {gy("json_extract_string(d.additional_details, '$.CSI_dose')")} as csi_dose_gy,
  {gy("json_extract_string(d.additional_details, '$.boost_dose')")} as boost_dose_gy,
  coalesce({gy('d.total_dose')}, {gy("json_extract_string(d.additional_details, '$.total_dose')")},
    {gy("json_extract_string(d.additional_details, '$.CSI_dose')")}, {gy('d.evidence_quote')}) as best_dose_gy,
  d.target_volume, s.number_of_patients
from details d join studies s on d.study_id = s.study_id)"""


def lines(col: str, sep: str = "chr(10)") -> str:
    return f"list_filter(list_transform(string_split({col}, {sep}), lambda p: trim(p)), lambda p: p <> '')"


def count_in(col: str, words) -> str:
    return "(" + " + ".join(f"cast(contains({col}, {q(w)}) as int)" for w in words) + ")"


def skip_section(name: str, text: str) -> str:
    from cohortloom.operators import filters

    clean = f"trim(regexp_replace(regexp_replace(lower(trim({name})), '[#*_\\-\\d.]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    kind = case_rules(f"trim(regexp_replace(lower(trim({name})), '^#+', ''))", rules.SECTION_PATTERNS)
    start = f"trim({text})"
    head = f"lower({text})"
    return f"""({has_any(clean, filters.SKIPPED_SECTIONS)} or coalesce({kind} in ('references', 'acknowledgments', 'supplementary'), false)
      or (regexp_matches({start}, '^\\d+\\.\\s+[A-Z]') and len(regexp_extract_all({start}, '\\n\\s*\\d+\\.\\s+')) >= 3)
      or ({count_in(head, filters.AFFILIATION_WORDS)} >= 3 and {count_in(head, filters.CONTENT_WORDS)} <= 1))"""


def text_clean(col: str) -> str:
    out = f"regexp_replace({col}, '\\[\\^\\d+\\]', '', 'g')"
    out = f"regexp_replace({out}, '<br\\s*/?>', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\\\(?:mathrm|text|textbf|textit)\\{{([^}}]*)\\}}', '\\1', 'g')"
    out = f"regexp_replace({out}, '\\$([^$]*)\\$', '\\1', 'g')"
    out = f"regexp_replace({out}, '\\\\%', '%', 'g')"
    out = f"regexp_replace({out}, '\\\\[a-zA-Z]+', '', 'g')"
    return f"trim(regexp_replace({out}, '\\s{{3,}}', chr(10) || chr(10), 'g'))"
