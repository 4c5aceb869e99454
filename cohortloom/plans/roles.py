"""Role tables of the test bed, derived row by row from the given tables.

Each role is one SELECT written in the part of SQL that Spark and DuckDB share, so both
sides of a check start from the same input; the operators are written twice.
"""

from __future__ import annotations


def _s(x: str) -> str:
    return f"cast({x} as string)"


def _i(x: str) -> str:
    return f"cast(floor({x}) as bigint)"


_M = "extract(month from o_orderdate)"
_D = "extract(day from o_orderdate)"
_Y = "extract(year from o_orderdate)"
_P = _i("o_totalprice / 1000")

STUDIES = f"""
select o_orderkey as study_id,
  'study_' || {_s('o_orderkey')} as doc_id,
  'Report ' || {_s('o_orderkey')} || '.pdf' as document_name,
  case when o_orderstatus = 'P' and {_D} > 20 then null else 'TRIAL-' || {_s(_P)} end as study_name,
  case when {_D} > 5 then '10.1000/j.' || {_s('o_orderkey')} else null end as doi,
  case when {_D} > 25 then null else {_s('3000000 + o_orderkey')} end as pmid,
  {_s('cast(o_orderdate as date)')} as publish_date,
  {_i(_Y)} as pub_year,
  case o_orderpriority when '1-URGENT' then 'Randomized controlled trial' when '2-HIGH' then 'Prospective cohort'
    when '3-MEDIUM' then 'Phase II randomized trial' when '4-NOT SPECIFIED' then 'Retrospective review'
    else 'Systematic review' end as study_type,
  case {_M} when 1 then 'Phase III' when 2 then 'phase 3' when 3 then 'Phase 2/3' when 4 then 'PHASE II'
    when 5 then 'phase I/II' when 6 then 'Phase IV' when 7 then 'Phase IIB' when 8 then null
    when 9 then 'phase 1' when 10 then 'pilot study' when 11 then '   ' else 'Phase Ib' end as study_phase,
  case when o_orderstatus = 'P' and {_M} > 9 then null else {_P} end as number_of_patients,
  case when {_M} < 5 then 'Multicenter consortium' when {_M} < 9 then 'University hospital' else null end as study_institution,
  case when {_M} in (2, 7) then n_name || ', ' || 'NATION_0' else n_name end as country,
  {_i('o_totalprice / 2500')} as citation_count,
  {_s(f'40 + {_D}')} || ' years (range 18-' || {_s(f'70 + {_M}')} || ')' as median_age,
  case c_mktsegment when 'BUILDING' then case when {_M} < 7 then 'invasive breast cancer' else 'Breast carcinoma' end
    when 'AUTOMOBILE' then case when {_M} < 5 then 'NSCLC' when {_M} < 9 then 'non-small cell lung cancer' else 'small cell lung cancer' end
    when 'MACHINERY' then case when {_M} < 7 then 'prostate adenocarcinoma' else 'Prostate cancer' end
    when 'HOUSEHOLD' then case when {_M} < 6 then 'colorectal cancer' when {_M} < 10 then 'rectal cancer' else 'Non-Hodgkin lymphoma' end
    else case when {_M} < 4 then 'glioblastoma multiforme' when {_M} < 8 then 'thymoma' when {_M} < 11 then 'Hodgkin lymphoma' else null end
    end as cancer_type,
  case o_orderstatus when 'F' then {_s(f'40 + {_D}')} || '.' || {_s(f'{_M} - 1')} || '% at ' || {_s(f'1 + {_M}')} || ' years'
    when 'O' then {_s(f'10 + {_D}')} || '.5 months' else case when {_M} < 6 then 'not reached' else null end end as overall_survival,
  case when {_D} < 10 then {_s(f'20 + {_M}')} || ' %' when {_D} < 20 then 'median ' || {_s(_M)} || ' months'
    when {_D} < 26 then {_s(_M)} || ' years' else null end as progression_free_survival,
  case when {_M} < 4 then {_s(f'50 + {_D}')} || '% at 5 years' else null end as disease_free_survival,
  case when {_M} > 6 then {_s(f'60 + {_D}')} || '.25%' else null end as local_control,
  case when {_D} > 3 then {_s(f'{_D}')} || ' months' else '4 years' end as median_followup,
  case when {_M} < 4 then 'ER+, PR positive, HER2-negative' when {_M} < 7 then 'triple negative (TNBC)'
    when {_M} < 9 then 'HER2 positive; Oncotype DX recurrence score of 11-25' when {_M} < 11 then 'ER negative' else null end as molecular_subtype,
  case when {_D} < 8 then 'Asian 40%, White 60%' when {_D} < 16 then 'African American 30%' when {_D} < 24 then 'Hispanic' else null end as race_ethnicity,
  case when {_D} < 11 then 'Stage I-II' when {_D} < 21 then 'Stage IIIA' else 'Stage IV' end as stage_text,
  case when {_M} < 5 then 'chemoradiation,surgery' when {_M} < 9 then 'radiotherapy' else 'immunotherapy,chemotherapy' end as modality,
  c_mktsegment as segment, n_regionkey as region_key, o_orderstatus as status, o_orderpriority as priority,
  o_orderdate as created_at, o_totalprice as price
from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey
"""

_Q = _i("l_quantity")
_LD = "extract(day from l_shipdate)"

DETAILS = f"""
select {_s('l_orderkey')} || '-' || {_s('l_linenumber')} || '-' || {_s('l_partkey')} || '-' || {_s('l_suppkey')} as detail_id,
  l_orderkey as study_id,
  case l_returnflag when 'A' then case l_linestatus when 'F' then 'IMRT' else ' vmat ' end
    when 'N' then case l_linestatus when 'F' then 'external beam radiation' else 'proton beam' end
    else case when {_LD} < 10 then null when {_LD} < 20 then 'palliative radiotherapy' else 'hdr brachytherapy' end end as technique,
  case when l_returnflag = 'A' then {_s(_Q)} || ' Gy in ' || {_s('5 * l_linenumber')} || ' fractions'
    when l_returnflag = 'N' and l_linestatus = 'F' then {_s(_Q)} || '.5-Gy' else null end as total_dose,
  case when l_linestatus = 'O' then '2 Gy x ' || {_s('l_linenumber')} || ' fr' else null end as fractionation,
  case when {_LD} < 12 then chr(123) || '"total_dose": "' || {_s(_Q)} || ' Gy", "boost_dose": "10 Gy"' || chr(125)
    when {_LD} < 22 then chr(123) || '"CSI_dose": "' || {_s(f'{_Q} + 1')} || ' gy", "nested": ' || chr(123) || '"site": "axis' || {_s('l_linenumber')} || '"' || chr(125) || chr(125)
    else null end as additional_details,
  'patients were treated to ' || {_s(f'{_Q} + 2')} || ' Gray' as evidence_quote,
  case when l_linestatus = 'F' then 'primary' else 'nodal basin' end as target_volume
from {{lineitem}}
"""

STAGES = f"""
select l_orderkey as study_id,
  case when l_returnflag = 'A' and l_linestatus = 'F' then 'I' when l_returnflag = 'A' then 'II'
    when l_returnflag = 'N' and l_linestatus = 'F' then 'IIIA' when l_returnflag = 'N' then 'IIIB' else 'IV' end as stage_category,
  {_Q} as number_of_patients, l_linenumber as stage_order
from {{lineitem}}
"""

# One abstract-like text per study, with doses, rates, hazard ratios, p-values and statements.
ABSTRACTS = f"""
select o_orderkey as study_id, 'study_' || {_s('o_orderkey')} as doc_id, o_custkey as query_id,
  'Trial ' || {_s(_P)} || ' of local therapy' as title, {_i(_Y)} as pub_year, o_totalprice as score,
  'Patients received ' || {_s(f'30 + {_D}')} || ' Gy in ' || {_s(f'{_M} + 14')} || ' fractions'
  || case when {_M} < 6 then ', boosted with ' || {_s(f'5 + {_M}')} || '.5 Gy' else '' end
  || '. The ' || case when {_D} < 20 then {_s(f'50 + {_D}')} || '% ' || {_s(f'1 + {_M} ')} || '-year OS' else {_s(f'40 + {_D}')} || '.' || {_s(_M)} || '% survival' end
  || ' was reported. ' || case when {_D} > 15 then 'HR 0.' || {_s(f'60 + {_M}')} || ' (95% CI: 0.' || {_s(f'50 + {_M}')} || '-0.' || {_s(f'70 + {_M}')} || '), p<0.0' || {_s(_M)}
      when {_D} > 8 then 'HR=1.' || {_s(f'10 + {_D}')} || ', p = 0.' || {_s(f'20 + {_D}')} else 'no difference' end
  || case when o_orderpriority = '1-URGENT' then '. RTOG ' || {_s(f'100 + {_M}')} || ' randomized phase III trial'
      when o_orderpriority = '2-HIGH' then '. NCCN guideline (meta-analysis)' when o_orderpriority = '3-MEDIUM' then '. KEYNOTE pooled analysis'
      else '. Single arm cohort' end
  || '. Mean dose < ' || {_s(_M)} || ' Gy, V20 < ' || {_s(_D)} || '%.'
  || case when {_D} < 6 then ' After chemotherapy.' when {_D} < 12 then ' After surgery.' when {_D} < 18 then ' With immunotherapy.' when {_D} < 22 then ' Adjuvant intent.' else '' end as text
from {{orders}}
"""

# One clinical note per order: sites, histologies, stages, markers, negations and demographics.
NOTES = f"""
select o_orderkey as note_id, o_custkey as profile_id, o_orderdate as noted_at,
  {_s(f'30 + {_D}')} || '-year-old ' || case when {_M} < 7 then 'female' else 'male' end || ' with '
  || case o_orderpriority when '1-URGENT' then 'invasive ductal carcinoma of the breast' when '2-HIGH' then 'lung adenocarcinoma'
     when '3-MEDIUM' then 'prostate cancer, Gleason ' || {_s(f'3 + cast({_M} > 6 as int)')} || '+4' when '4-NOT SPECIFIED' then 'squamous cell carcinoma of the oropharynx'
     else 'glioblastoma' end
  || '. Stage ' || case when {_D} < 8 then 'IIA' when {_D} < 16 then 'III' when {_D} < 24 then '4' else 'IB' end
  || ', T' || {_s(f'1 + cast({_M} > 6 as int) + cast({_M} > 9 as int)')} || 'N' || {_s(f'cast({_D} > 10 as int)')} || 'M' || {_s(f'cast({_D} > 25 as int)')}
  || '. ' || case when {_M} in (1, 4, 7) then 'No evidence of brain metastases.' when {_M} in (2, 5, 8) then 'Known bone metastases and liver disease.'
     when {_M} in (3, 6) then 'Denies prior chemotherapy.' else 'Lung metastases were seen.' end
  || ' ' || case o_orderstatus when 'F' then 'HER2 positive, ER negative.' when 'O' then 'PD-L1: 50%. EGFR mutated, no ALK rearrangement.'
     else 'ER+ and PR positive. HER2 not amplified.' end
  || ' ECOG ' || {_s(f'cast({_D} > 12 as int)')} || ', CPS ' || {_s(_D)} || ', Ki-67 ' || {_s(f'{_D} + 5')} || '%.'
  || case when {_D} > 20 then ' History of melanoma.' else '' end
  || case when {_M} > 8 then ' Progressed on second-line osimertinib.' else '' end as text
from {{orders}}
"""

# Retrieval hits: a supplier is the query, an order the document, a line the chunk.
HITS = f"""
select l_suppkey as query_id, l_orderkey as doc_id,
  {_s('l_orderkey')} || ':' || {_s('l_linenumber')} || ':' || {_s('l_partkey')} || ':' || {_s('l_suppkey')} as chunk_id,
  case when l_linestatus = 'F' then 'paragraph_window' else 'table_row' end as chunk_type,
  case when l_linestatus = 'F' then case l_returnflag when 'A' then 'Results' when 'N' then 'Dose and technique' else 'References' end else '' end as section,
  case when l_linestatus = 'O' then 'Table ' || {_s('l_linenumber')} else null end as table_number,
  l_linenumber as window_idx,
  floor(l_extendedprice / 10.5) / 10000 as score_dense,
  floor(l_quantity * 200 + l_tax * 10000) / 10000 as score_lex,
  l_extendedprice as amount, l_quantity as qty, l_returnflag as flag, l_linestatus as line_status, l_shipdate as shipped_at,
  l_partkey as part_id, l_discount as discount, l_tax as tax
from {{lineitem}}
"""

# Query profiles to be matched: one per nation, a bounded set that is broadcast after a size check.
CASES = f"""
select n_nationkey as case_id,
  case n_regionkey when 0 then 'breast' when 1 then 'lung' when 2 then 'prostate' when 3 then 'rectal' else 'glioblastoma' end as site,
  case n_regionkey when 0 then 'invasive' when 1 then 'small cell' when 2 then 'adenocarcinoma' else null end as histology,
  case when n_nationkey < 8 then 'II' when n_nationkey < 16 then 'IIIA' else 'IV' end as stage,
  case when n_nationkey < 10 then 'her2' when n_nationkey < 18 then 'er' else null end as marker,
  case when n_nationkey < 10 then 'negative' else 'positive' end as marker_status,
  case when n_nationkey < 12 then 'radiotherapy' else 'surgery' end as modality,
  40 + n_nationkey as age, n_name as nation_name
from {{nation}}
"""

# Patient profiles, one per customer.
PROFILES = f"""
select c_custkey as profile_id, c_name as profile_name, c_nationkey as nation_key,
  30 + {_i('abs(c_acctbal) / 200')} as age,
  case c_mktsegment when 'BUILDING' then 'breast' when 'AUTOMOBILE' then 'lung' when 'MACHINERY' then 'prostate'
    when 'HOUSEHOLD' then 'rectal' else null end as site,
  case when c_acctbal < 0 then 'I' when c_acctbal < 3000 then 'IIA' when c_acctbal < 6000 then 'III' else 'IVB' end as stage,
  case when c_acctbal < 2000 then 'her2,er' when c_acctbal < 5000 then 'er' when c_acctbal < 8000 then 'egfr,pdl1' else '' end as markers,
  case when c_nationkey < 12 then 'female' else 'male' end as sex, c_acctbal as balance
from {{customer}}
"""

# Axis verdicts a judge produced for (query, document) pairs.
VERDICTS = f"""
select l_suppkey as query_id, l_orderkey as doc_id,
  {_s('l_orderkey')} || ':' || {_s('l_linenumber')} || ':' || {_s('l_partkey')} as pair_id,
  floor(3000 + l_discount * 50000) / 10000 as score,
  case l_returnflag when 'A' then 'MATCH' when 'N' then 'COMPATIBLE' else 'MISMATCH' end as histology,
  case when l_quantity < 10 then 'MATCH' when l_quantity < 25 then 'PARTIAL' when l_quantity < 45 then 'NA' else 'MISMATCH' end as stage,
  case l_linestatus when 'F' then 'MATCH' else 'MISMATCH' end as biomarkers,
  case when l_tax < 0.02 then 'MISMATCH' when l_tax < 0.05 then 'COMPATIBLE' else 'NA' end as prior_treatment,
  case when l_linenumber < 4 then 'MATCH' when l_linenumber < 6 then 'PARTIAL' else 'MISMATCH' end as setting
from {{lineitem}}
"""

# Longitudinal readings: lab or vital series per (profile, kind).
READINGS = f"""
select event_id, user_id as profile_id, event_type as kind, value, ts as created_at,
  case when value < 1 then null else ts end as collected_at, props
from {{events}}
"""

# Sources registered for governance and authority; several documents carry an unregistered source.
SOURCES = """
select distinct source as source_key,
  case when source in ('src3', 'src11') then false else true end as is_active,
  case when source in ('src5', 'src6') then false else true end as patient_facing,
  case when source in ('src1', 'src2') then 'staging,dose' when source = 'src7' then 'prognosis' else null end as intents,
  case when source in ('src0', 'src1') then 1 when source in ('src2', 'src3', 'src4') then 2
    when source in ('src5', 'src6', 'src7') then 3 when source in ('src8', 'src9') then 4 else null end as tier
from {documents} where source not in ('src18', 'src19')
"""

ROLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "studies": (STUDIES, ("orders", "customer", "nation")),
    "details": (DETAILS, ("lineitem",)),
    "stages": (STAGES, ("lineitem",)),
    "abstracts": (ABSTRACTS, ("orders",)),
    "notes": (NOTES, ("orders",)),
    "hits": (HITS, ("lineitem",)),
    "cases": (CASES, ("nation",)),
    "profiles": (PROFILES, ("customer",)),
    "verdicts": (VERDICTS, ("lineitem",)),
    "readings": (READINGS, ("events",)),
    "sources": (SOURCES, ("documents",)),
}


# Tables and roles whose rows are parsed as text; their scan is spread over the cores.
TEXT_TABLES = frozenset({"documents", "pages"})
TEXT_ROLES = frozenset({"studies", "details", "abstracts", "notes"})


def role_sql(name: str) -> str:
    """The role as plain SQL over the given tables (used inside oracle queries)."""
    sql, tables = ROLES[name]
    return sql.format(**{t: t for t in tables})


def with_roles(sql: str, names: list[str]) -> str:
    """Put the role tables an oracle reads in front of it as common table expressions."""
    sql = sql.strip()
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({role_sql(n).strip()})" for n in names)
    if sql[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{sql[14:].lstrip()}"
    if sql[:4].upper() == "WITH":
        return f"WITH {ctes},\n{sql[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"
