"""Evidence quality and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import audit as a
from cohortloom.operators import quality as q
from cohortloom.operators import retrieval as r
from cohortloom.operators import tagging as t
from cohortloom.plans import sqlkit as k
from cohortloom.plans.q_retrieval import APOOL_SQL, POOL_SQL, rnd6, sq6
from cohortloom.plans.q_tagging import FIND_SQL, NUM_SQL
from cohortloom.plans.registry import query
from cohortloom.session import shuffled
from cohortloom.sources.scan import dealt


def _ranked(b):
    return r.ranked(b.abstracts, "score", "study_id")


def _lists(pattern: str, groups: int, limit: int | None = None) -> str:
    g = lambda i: f"regexp_extract_all(text, {k.q(pattern)}, {i})"
    e = f"list_transform({g(2)}, lambda x: try_cast(nullif(x, '') as double))" if groups > 1 else f"list_transform({g(0)}, lambda x: cast(null as double))"
    z = f"list_transform(list_zip(list_transform({g(1)}, lambda x: cast(x as double)), {e}, {g(0)}), lambda z: struct_pack(v := z[1], e := z[2], r := z[3]))"
    return f"({z})[1:{limit}]" if limit else z


def _first_pair(x: str, y: str, test: str) -> str:
    return f"(list_filter(flatten(list_transform({x}, lambda a: list_transform({y}, lambda b: struct_pack(a := a, b := b)))), lambda p: {test}))[1]"


CONTRA_SQL = f"""{APOOL_SQL}, tp as (select query_id, doc_id, pos, {_lists(t.DOSE_RE, 2, 2)} as doses, {_lists(t.RATE_RE, 2)} as rates, {_lists(t.HR_RE, 1, 1)} as hrs from apool),
    pp as (select x.query_id, x.doc_id as doc_a, y.doc_id as doc_b, {_first_pair('x.doses', 'y.doses', 'abs(p.a.v - p.b.v) / greatest(p.a.v, p.b.v) > 0.10')} as d,
      {_first_pair('x.rates', 'y.rates', '(p.a.e is null or p.b.e is null or p.a.e = p.b.e) and abs(p.a.v - p.b.v) > 15')} as s,
      {_first_pair('x.hrs', 'y.hrs', '(p.a.v < 0.9 and p.b.v > 1.1) or (p.a.v > 1.1 and p.b.v < 0.9)')} as h from tp x join tp y on x.query_id = y.query_id and x.pos < y.pos),
    contra as (select query_id, doc_a, doc_b, 'dose' as topic, case when abs(d.a.e - d.b.e) > 3 then 'major' else 'minor' end as severity, d.a.r as finding_a, d.b.r as finding_b from pp where d is not null
      union all select query_id, doc_a, doc_b, 'survival', case when abs(s.a.v - s.b.v) > 25 then 'major' else 'minor' end, s.a.r, s.b.r from pp where s is not null
      union all select query_id, doc_a, doc_b, 'hazard_ratio', 'major', h.a.r, h.b.r from pp where h is not null)"""


@query("contradiction_pairs", f"WITH {CONTRA_SQL} select * from contra", "abstracts")
def _contra(b):
    return q.contradictions(_ranked(b), "text")


CONS_SQL = f"""{FIND_SQL}, cf as (select distinct a.query_id, f.study_id, kind, cast(round_even(value / 5, 0) * 5 as int) as rounded, case when kind = 'survival_rate' then cast(extra as int) end as timepoint from finds f join abstracts a using (study_id) where kind in ('dose', 'survival_rate')),
    cons as (select query_id, kind, rounded, timepoint, count(*) as studies from cf group by 1, 2, 3, 4 having count(*) >= 2)"""


def _consensus_rows(b):
    found = t.findings_long(b.abstracts, ["query_id", "study_id"], "text", ["dose", "survival_rate"])
    # Nearly every finding is another one: counted where they are read, they would all stand in the tasks of the scan.
    return q.consensus(dealt(found, b.rows("orders"), "query_id", "study_id"), "query_id", "study_id")


@query("consensus", f"WITH {CONS_SQL} select * from cons", "abstracts")
def _consensus(b):
    return _consensus_rows(b)


@query(
    "confidence",
    f"""WITH {CONS_SQL}, {CONTRA_SQL}, n as (select query_id, count(distinct doc_id) as studies from abstracts group by 1), h as (select query_id, count_if(studies >= 3) as high from cons group by 1), c as (select query_id, count_if(severity = 'major') as major, count_if(severity = 'minor') as minor from contra group by 1),
    s as (select n.query_id, studies, coalesce(high, 0) as high, coalesce(major, 0) as major, coalesce(minor, 0) as minor from n left join h using (query_id) left join c using (query_id)),
    z as (select *, round(greatest(0.1, least(1.0, cast(case when studies >= 5 then 0.8 when studies >= 3 then 0.7 when studies >= 2 then 0.6 else 0.4 end as double) + least(0.15, high * 0.05) - major * 0.15 - minor * 0.05)), 6) as sc from s)
    select query_id, studies, high, major, minor, {k.rnd('sc', 2)} as score, case when sc >= 0.75 then 'high' when sc >= 0.55 then 'moderate' when sc >= 0.35 then 'low' else 'uncertain' end as level from z""",
    "abstracts",
)
def _confidence(b):
    return q.confidence(b.abstracts, _consensus_rows(b), q.contradictions(_ranked(b), "text"), "query_id")


@query("dose_table", f"WITH {FIND_SQL} select study_id, pos, value as dose, extra as fractions, {k.rnd('value / extra', 2)} as per_fraction from finds where kind = 'dose' and pos < 2", "abstracts")
def _dose_table(b):
    return q.dose_table(t.findings_long(b.abstracts, ["study_id"], "text", ["dose"]), "study_id")


@query(
    "results_comparison",
    f"""WITH {FIND_SQL} select study_id, max(case when kind = 'survival_rate' then value end) as rate, max(case when kind = 'survival_rate' then extra end) as timepoint, max(case when kind = 'hazard_ratio' then value end) as hr, max(case when kind = 'hazard_ratio' then extra end) as ci_low, max(case when kind = 'hazard_ratio' then extra2 end) as ci_high
    from finds where pos = 0 and kind in ('survival_rate', 'hazard_ratio') group by 1""",
    "abstracts",
)
def _results(b):
    return q.results_comparison(t.findings_long(b.abstracts, ["study_id"], "text", ["survival_rate", "hazard_ratio"]), "study_id")


# ---- grounding: the numbers of an abstract against those of its treatment records ---------------

SRC_SQL = f"""src as (select study_id, 'dose' as kind, try_cast(regexp_extract(evidence_quote, '(?i)(\\d+\\.?\\d*)\\s*(?:Gy|gray)', 1) as double) as value, regexp_extract(evidence_quote, '(?i)(\\d+\\.?\\d*)\\s*(?:Gy|gray)', 0) as raw from details
      union all select study_id, 'percentage', number_of_patients + 20.4, number_of_patients + 20 || '.4%' from stages)"""
CHECK_SQL = f"""{NUM_SQL}, {SRC_SQL}, an as (select * from nums where not (kind = 'percentage' and value = 95 and regexp_matches(lower(raw), 'ci|confidence'))),
    nr as (select an.study_id, an.kind, an.pos, min(abs(s.value - an.value)) as gap, arg_min(s.value, (abs(s.value - an.value), s.value)) as found from an join src s on s.study_id = an.study_id and s.kind = an.kind and abs(s.value - an.value) <= 1.0 group by 1, 2, 3),
    ck as (select an.*, found, case when found is null then 'unvalidated' when round(found, 1) = round(an.value, 1) then 'exact' else 'near' end as verdict from an left join nr using (study_id, kind, pos))"""


def _sources(b):
    quotes = t.numbers_long(b.details.select("study_id", "evidence_quote"), ["study_id"], "evidence_quote").filter(F.col("kind") == "dose")
    rates = b.stages.select(
        "study_id", F.lit("percentage").alias("kind"), (F.col("number_of_patients") + 20.4).alias("value"), F.concat((F.col("number_of_patients") + 20).cast("string"), F.lit(".4%")).alias("raw")
    )
    return quotes.select("study_id", "kind", "value", "raw").unionByName(rates)


def _checked(b):
    return q.validate_numbers(t.numbers_long(b.abstracts, ["study_id"], "text"), _sources(b), "study_id")


@query("validate_numbers", f"WITH {CHECK_SQL} select study_id, kind, pos, found, verdict from ck", "abstracts details stages")
def _validate(b):
    return _checked(b).select("study_id", "kind", "pos", "found", "verdict")


@query(
    "validation_rate",
    f"WITH {CHECK_SQL}, c as (select study_id, count(*) as total, count_if(verdict <> 'unvalidated') as validated from ck group by 1) select a.study_id, coalesce(total, 0) as total, coalesce(validated, 0) as validated, cast(case when total > 0 then validated / total else 1.0 end as double) as rate from abstracts a left join c using (study_id)",
    "abstracts details stages",
)
def _rate(b):
    return q.validation_rate(b.abstracts, _checked(b), "study_id")


@query("join_band", f"WITH {NUM_SQL}, {SRC_SQL} select n.study_id, n.kind, n.pos, min(abs(s.value - n.value)) as gap from nums n join src s on s.study_id = n.study_id and s.kind = n.kind and abs(s.value - n.value) <= 2 group by 1, 2, 3", "abstracts details stages")
def _band(b):
    rows = q.band_join(t.numbers_long(b.abstracts, ["study_id"], "text"), _sources(b), ["study_id", "kind"], "value", 2.0)
    return rows.filter(F.col("gap").isNotNull()).select("study_id", "kind", "pos", "gap")


@query(
    "strip_unverified",
    f"""WITH RECURSIVE {CHECK_SQL}, bad as (select study_id, list(raw order by kind, pos, raw) as raws from ck where verdict = 'unvalidated' group by 1),
    z as (select a.study_id, a.text, coalesce(raws, []) as raws, 0 as i from abstracts a left join bad using (study_id)
      union all select study_id, case when instr(text, raws[i + 1]) > 0 then substr(text, 1, instr(text, raws[i + 1]) - 1) || '[unverified]' || substr(text, instr(text, raws[i + 1]) + length(raws[i + 1])) else text end, raws, i + 1 from z where i < len(raws))
    select study_id, text as clean from z where i = len(raws)""",
    "abstracts details stages",
)
def _strip(b):
    bad = _checked(b).filter(F.col("verdict") == "unvalidated")
    lists = bad.groupBy("study_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "pos", "raw"))), lambda e: e["raw"]).alias("raws"))
    rows = b.abstracts.select("study_id", "text").join(shuffled(lists), "study_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("study_id", q.strip_unverified(F.col("text"), F.coalesce("raws", none)).alias("clean"))


# What sources state of a study's rates: the survival rate of its abstract, and its V20 twice, the second time with less.
_STATS = """select o_orderkey as study_id, ord, case ord when 1 then 50.0 + day(o_orderdate) else day(o_orderdate) end as value,
  case when ord = 1 and o_orderkey % 2 = 0 then day(o_orderdate) + 47 end as ci_low, case when ord = 1 and o_orderkey % 2 = 0 then day(o_orderdate) + 53 end as ci_high,
  case when ord = 2 or o_orderkey % 3 = 0 then '0.0' || (o_orderkey % 5 + 1) end as p_value, case when ord = 2 and o_orderkey % 4 = 0 then '0.7' || (o_orderkey % 7) end as hr
  from {orders}"""


@query(
    "enrich_rates",
    """WITH d as (select o_orderkey as study_id, day(o_orderdate) as d from orders),
    s as (select study_id, case when study_id % 2 = 0 then '95% CI: ' || (d + 47) || '-' || (d + 53) || '%' end as ci, case when study_id % 3 = 0 then 'p=0.0' || (study_id % 5 + 1) end as p1, 'p=0.0' || (study_id % 5 + 1) as p2, case when study_id % 4 = 0 then 'HR=0.7' || (study_id % 7) end as hr, d from d),
    m as (select a.study_id, text, 50 + d || '% ' as rate, 'V20 < ' || d || '%' as v20, concat_ws(', ', ci, p1) as one, concat_ws(', ', p2, hr) as two, d from abstracts a join s using (study_id))
    select study_id, replace(case when d < 20 and one <> '' then replace(text, rate, trim(rate) || ' (' || one || ') ') else text end, v20, v20 || ' (' || two || ')') as enriched from m""",
    "abstracts",
)
def _enrich(b):
    rows = b.spark.sql(_STATS.replace("{orders}", "{o}"), o=b.orders.withColumn("ord", F.explode(F.array(*map(F.lit, (1, 2, 3))))))
    stated = q.stat_additions(rows, "study_id")
    return b.abstracts.join(stated, "study_id", "left").select("study_id", q.enrich(F.col("text"), F.coalesce("additions", F.expr("cast(map() as map<string,string>)"))).alias("enriched"))


@query(
    "relaxed_validation",
    f"""WITH {NUM_SQL}, {SRC_SQL}, x as (select n.study_id, n.kind, n.pos, lower(n.raw) as raw, exists (select 1 from src s where s.study_id = n.study_id and lower(s.raw) = lower(n.raw)) as ex, exists (select 1 from src s where s.study_id = n.study_id and s.value > 0 and abs(n.value - s.value) / s.value <= 0.05) as nr from nums n)
    select study_id, kind, pos, raw, case when ex then 'VERIFIED' when raw in ({', '.join(k.q(c) for c in q.KNOWN_CONSTANTS)}) then 'KNOWN_CONSTANT' when nr then 'LIKELY_CORRECT' else 'UNVERIFIED' end as verdict from x""",
    "abstracts details stages",
)
def _relaxed(b):
    return q.relaxed_validation(t.numbers_long(b.abstracts, ["study_id"], "text"), _sources(b), "study_id")


_AUTHOR_SQL = "case when c_mktsegment = 'BUILDING' then 'García-López' when c_mktsegment = 'MACHINERY' then 'Smith' else 'Okafor' end"


@query(
    "verify_citations",
    f"""WITH tx as (select o_orderkey, 'As ' || {_AUTHOR_SQL} || ' et al., ' || extract(year from o_orderdate) || ' showed and Jones, ' || (1990 + extract(month from o_orderdate)) || ' confirmed.' as text from orders join customer on o_custkey = c_custkey),
    kn as (select distinct lower({_AUTHOR_SQL}) as a, cast(extract(year from o_orderdate) as int) as y from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' and c_acctbal > 9900),
    z as (select o_orderkey, unnest(regexp_extract_all(text, '{q.CITATION_RE.replace("'", "''")}', 1)) as author, cast(unnest(regexp_extract_all(text, '{q.CITATION_RE.replace("'", "''")}', 2)) as int) as year, unnest(range(len(regexp_extract_all(text, '{q.CITATION_RE.replace("'", "''")}', 1)))) as pos from tx)
    select o_orderkey, pos, author, year, a is not null as verified from z left join kn on lower(author) = a and year = y""",
)
def _citations(b):
    seg = F.col("c_mktsegment")
    author = F.when(seg == "BUILDING", "García-López").when(seg == "MACHINERY", "Smith").otherwise("Okafor")
    rows = b.orders.join(b.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("author", author).withColumn("year", F.year("o_orderdate"))
    text = F.concat(
        F.lit("As "), "author", F.lit(" et al., "), F.col("year").cast("string"), F.lit(" showed and Jones, "), (F.month("o_orderdate") + 1990).cast("string"), F.lit(" confirmed.")
    )
    known = rows.filter((F.col("o_orderstatus") == "F") & (F.col("c_acctbal") > 9900)).select("author", "year")
    return q.verify_citations(rows.select("o_orderkey", text.alias("text")), known, "o_orderkey", "text")


@query(
    "gap_detection",
    f"""WITH {APOOL_SQL}, qs as (select c_custkey as query_id, case c_mktsegment when 'BUILDING' then 'What does the guideline recommend?' when 'MACHINERY' then 'Second-line therapy options' else 'dose of 50 Gy' end as query_text from customer),
    h as (select query_id, bool_or(regexp_matches(text, {k.q(next(p for n, p, _ in r.LANDMARKS if n == 'guidelines'))})) as has from apool where pos <= 10 group by 1), n as (select query_id, regexp_matches(lower(query_text), {k.q(q.NEEDS_GUIDELINE)}) as needs, coalesce(has, false) as has from qs left join h using (query_id))
    select query_id, needs, needs and has as has_guideline, needs and not has as gap from n""",
    "abstracts",
)
def _gap(b):
    seg = F.col("c_mktsegment")
    text = F.when(seg == "BUILDING", "What does the guideline recommend?").when(seg == "MACHINERY", "Second-line therapy options").otherwise("dose of 50 Gy")
    queries = b.customer.select(F.col("c_custkey").alias("query_id"), text.alias("query_text"))
    return q.gap_detection(queries, _ranked(b), "query_text", "text", 10)


@query(
    "evidence_packet",
    f"""WITH {POOL_SQL}, d as (select * from pool qualify row_number() over (partition by query_id, part_id order by pos) = 1), tp as (select *, row_number() over (partition by query_id order by pos) as rank from d qualify rank <= 8)
    select query_id, count(*) as passages, string_agg(cast(doc_id as varchar), ',' order by rank) as documents, max(score_dense) as best, bool_or(chunk_type = 'table_row') as has_table from tp group by 1""",
    "hits",
)
def _packet(b):
    ranked = r.ranked(b.hits, "score_dense", "chunk_id").withColumn("score", F.col("score_dense"))
    return q.packet_summary(ranked, "part_id", 8)


@query(
    "value_grounded",
    """WITH t as (select study_id, number_of_patients || ' patients at ' || pub_year as v, median_age || ' ' || publish_date || ' n=' || coalesce(number_of_patients, 0) as s from studies where number_of_patients is not null)
    select study_id, len(list_filter(regexp_extract_all(v, '\\d+(?:\\.\\d+)?'), lambda n: not contains(s, n))) = 0 as grounded from t""",
    "studies",
)
def _grounded(b):
    text = lambda c: F.col(c).cast("string")
    value = F.concat(text("number_of_patients"), F.lit(" patients at "), text("pub_year"))
    source = F.concat("median_age", F.lit(" "), "publish_date", F.lit(" n="), F.coalesce(text("number_of_patients"), F.lit("0")))
    return b.studies.filter(F.col("number_of_patients").isNotNull()).select("study_id", q.value_grounded(value, source).alias("grounded"))


@query(
    "source_finder",
    """WITH v as (select detail_id as value_id, study_id, total_dose as value from details where total_dose is not null), c as (select detail_id as chunk_id, study_id, evidence_quote as text, case target_volume when 'primary' then 'Results' else 'Methods of dose' end as section from details where not technique ilike '%palliative%'),
    s as (select value_id, chunk_id, (case when contains(lower(text), lower(value)) then 10 else 0 end) + len(list_filter(regexp_extract_all(value, '\\d+\\.?\\d*'), lambda p: contains(lower(text), p))) * 5 + (case when contains(lower(text), 'dose') then 2 else 0 end) + (case when contains(lower(text), 'gray') then 2 else 0 end)
      + (case when contains(lower(section), 'result') then 3 when contains(lower(section), 'method') then 2 else 0 end) as points from v join c using (study_id))
    select value_id, chunk_id, points, row_number() over (partition by value_id order by points desc, chunk_id) as rank from s where points > 0 qualify rank <= 10""",
    "details",
)
def _finder(b):
    d = b.details
    values = d.filter(F.col("total_dose").isNotNull()).select(F.col("detail_id").alias("value_id"), "study_id", F.col("total_dose").alias("value"))
    section = F.when(F.col("target_volume") == "primary", "Results").otherwise("Methods of dose")
    chunks = d.filter(~F.col("technique").ilike("%palliative%")).select(F.col("detail_id").alias("chunk_id"), "study_id", F.col("evidence_quote").alias("text"), section.alias("section"))
    return q.source_finder(values, chunks, "study_id", ["dose", "gray"], 10).select("value_id", "chunk_id", "points", "rank")


@query(
    "mode_share",
    """WITH c as (select l_suppkey, l_returnflag || l_linestatus as v, count(*) as n, min((l_orderkey, l_linenumber, l_partkey)) as f from lineitem group by 1, 2) select l_suppkey, arg_min(v, (-n, f)) as answer, max(n) / sum(n) as share from c group by 1""",
)
def _mode(b):
    rows = b.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("v"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"))
    return q.mode_share(rows, "l_suppkey", "v", "o")


TRUTH_SQL = "tr as (select query_id, doc_id, case when max(discount) > 0.07 then 'relevant' when max(discount) < 0.01 then 'forbidden' else 'neutral' end as truth from hits group by 1, 2)"


@query(
    "precision_recall_at_k",
    f"""WITH {POOL_SQL}, {TRUTH_SQL}, m as (select p.query_id, p.pos, tr.truth from pool p left join tr using (query_id, doc_id)), g as (select query_id, count_if(pos <= 10) as shown, count_if(pos <= 10 and truth = 'relevant') as hits_n, count_if(pos <= 50 and truth = 'relevant') as found, count_if(pos <= 10 and truth = 'forbidden') as violations from m group by 1),
    e as (select query_id, count(*) as expected from tr where truth = 'relevant' group by 1) select query_id, hits_n / least(10, shown) as precision, cast(case when expected > 0 then found / expected else 0.0 end as double) as recall, violations from g left join e using (query_id)""",
    "hits",
)
def _precision(b):
    best, worst = F.max("discount") > 0.07, F.max("discount") < 0.01
    truth = b.hits.groupBy("query_id", "doc_id").agg(F.when(best, "relevant").when(worst, "forbidden").otherwise("neutral").alias("truth"))
    return q.precision_recall(r.ranked(b.hits, "score_dense", "chunk_id"), truth, 10, 50)


@query(
    "coverage_grade",
    f"""WITH t as (select study_id, title as ref, 'Trial of ' || modality || ' ' || number_of_patients as ans, ['trial', 'therapy', 'local'] as concepts, [cast(number_of_patients as varchar), 'trial of'] as cites from studies join (select study_id, title from abstracts) using (study_id) where number_of_patients is not null),
    s as (select study_id, 1 - levenshtein(lower(ans), lower(ref)) / greatest(length(ans), length(ref)) as sim, len(list_filter(concepts, lambda x: contains(lower(ans), x))) / 3 as con, len(list_filter(cites, lambda x: contains(lower(ans), x))) / 2 as cit from t)
    select study_id, {sq6('sim')} as similarity, {sq6('con')} as concept, {sq6('cit')} as cite, case when sim > 0.8 and cit > 0.7 then 'excellent' when sim > 0.6 and con > 0.6 then 'pass' when sim > 0.5 or con > 0.5 then 'partial' else 'fail' end as grade from s""",
    "studies abstracts",
)
def _grade(b):
    s = b.studies.filter(F.col("number_of_patients").isNotNull()).join(b.abstracts.select("study_id", "title"), "study_id")
    n = F.col("number_of_patients").cast("string")
    answer = F.concat(F.lit("Trial of "), "modality", F.lit(" "), n)
    parts = q.coverage_grade(answer, F.col("title"), F.array(F.lit("trial"), F.lit("therapy"), F.lit("local")), F.array(n, F.lit("trial of")))
    return s.select("study_id", rnd6(parts[0]).alias("similarity"), rnd6(parts[1]).alias("concept"), rnd6(parts[2]).alias("cite"), parts[3].alias("grade"))


# ---- audit -------------------------------------------------------------------------------------

_AXES = ["histology", "stage", "biomarkers", "prior_treatment", "setting"]


@query(
    "verdict_census",
    "WITH l as (" + " union all ".join(f"select '{x}' as criterion, {x} as verdict from verdicts" for x in _AXES) + ") select criterion, count_if(verdict <> 'NA') as evaluated, count_if(verdict = 'MATCH') as matches, count_if(verdict = 'MISMATCH') as mismatches, count_if(verdict = 'NA') as not_available, count_if(verdict <> 'NA') > 0 and count_if(verdict = 'MISMATCH') = 0 as never_rejects from l group by 1",
    "verdicts",
)
def _verdicts(b):
    return a.verdict_census(b.verdicts, "pair_id", _AXES)


@query("metric_rollup", "select user_id, event_type, json_extract_string(props, '$.k')::int >= 50 as large, cast(sum(json_extract_string(props, '$.k')::int) as bigint) as total from events group by 1, 2, 3")
def _metrics(b):
    amount = F.get_json_object("props", "$.k").cast("int")
    return a.metric_rollup(b.events.withColumn("large", amount >= 50), ["user_id", "event_type", "large"], amount)


_LANE_SQL = "case flag when 'A' then 'frame' when 'N' then 'structured' else 'vector' end"


@query(
    "lane_counts",
    f"WITH d as (select part_id, query_id, bool_or({_LANE_SQL} = 'frame') as p, bool_or({_LANE_SQL} = 'structured') as s from hits group by 1, 2) select case when p and s then 'both' when p then 'frame' when s then 'structured' else 'vector' end as lane, count(*) as docs from d group by 1",
    "hits",
)
def _lane_counts(b):
    lane = F.when(F.col("flag") == "A", "frame").when(F.col("flag") == "N", "structured").otherwise("vector")
    return a.lane_counts(b.hits.select("query_id", F.col("part_id").alias("doc_id"), lane.alias("lane")))


@query(
    "store_diff",
    """WITH l as (select study_id, 'country' as field, country as value from studies where status <> 'P' union all select study_id, 'phase', study_phase from studies where status <> 'P'), r as (select study_id, 'country' as field, case when region_key = 1 then 'x' else lower(country) end as value from studies where region_key > 0 union all select study_id, 'phase', case when region_key = 2 then null else study_phase end from studies where region_key > 0),
    j as (select coalesce(l.field, r.field) as field, l.value as a, r.value as b from l full outer join r on l.study_id = r.study_id and l.field = r.field)
    select field, case when a is null and b is null then 'both_null' when a is null then 'left_null' when b is null then 'right_null' when lower(trim(a)) = lower(trim(b)) then 'match' else 'mismatch' end as state, count(*) as n from j group by 1, 2""",
    "studies",
)
def _store(b):
    def long(df, country, phase):
        e = F.array(F.struct(F.lit("country").alias("field"), country.alias("value")), F.struct(F.lit("phase").alias("field"), phase.alias("value")))
        return df.select("study_id", F.explode(e).alias("e")).select("study_id", "e.field", "e.value")

    s = b.studies
    left = long(s.filter(F.col("status") != "P"), F.col("country"), F.col("study_phase"))
    right = long(
        s.filter(F.col("region_key") > 0), F.when(F.col("region_key") == 1, "x").otherwise(F.lower("country")), F.when(F.col("region_key") != 2, F.col("study_phase"))
    )
    return a.store_diff(left, right, ["study_id", "field"])


@query(
    "retrieval_profile",
    """WITH d as (select flag, part_id, count(*) as n, count(distinct nullif(section, '')) as s from hits group by 1, 2) select flag, cast(sum(n) as bigint) as chunks, count(*) as docs, round(sum(n) / count(*), 4) as chunks_per_doc, round(sum(s) / count(*), 4) as sections_per_doc from d group by 1""",
    "hits",
)
def _profile(b):
    return a.retrieval_profile(b.hits, "flag", "part_id", "section")


_TERMS = ["rtog", "nccn", "keynote", "surgery", "survival"]


@query(
    "term_coverage",
    f"""WITH {APOOL_SQL} select query_id, ({' + '.join(f"cast(bool_or(contains(lower(text), '{x}')) as int)" for x in _TERMS)}) / 5 as coverage, bool_or(pos <= 3 and ({' or '.join(f"contains(lower(text), '{x}')" for x in _TERMS)})) as top3_hit from apool group by 1""",
    "abstracts",
)
def _terms(b):
    return a.term_coverage(_ranked(b), _TERMS, "text")


_FIELDS = ["study_name", "doi", "pmid", "study_phase", "number_of_patients", "cancer_type", "overall_survival", "molecular_subtype"]


@query(
    "field_coverage",
    " union all ".join(f"select '{f}' as field, count_if(coalesce(cast({f} as varchar), '') <> '') as filled, count(*) as rows from studies" for f in _FIELDS).join(["WITH s as (select 1) ", ""]),
    "studies",
)
def _fields(b):
    return a.field_coverage(b.studies, _FIELDS)
