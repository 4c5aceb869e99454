"""Vocabularies from tables and ranges on scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import scales, vocabulary
from cohortloom.plans.registry import query

# Terms taken from the documents: their first one to three words; the concept is the first word, the slot the language.
_TERMS_SQL = """tx as (select 'd' || doc_id as text_id, text from documents union all select 'c' || conv_id || '-' || turn, text from conversations),
  hw as (select lang, doc_id, string_split(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), ' ') as w from documents),
  vc as (select distinct array_to_string(w[1:1 + doc_id % 3], ' ') as term, w[1] as canonical, lang as slot from hw where w[1] <> ''),
  vt as (select term, canonical, slot, array_to_string(regexp_extract_all(lower(term), '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]'), ' ') as gram, len(regexp_extract_all(lower(term), '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]')) as size from vc),
  tk as (select text_id, regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]') as ts from tx),
  ps as (select text_id, ts, unnest(range(len(ts))) as start from tk),
  gr as (select text_id, start, n as size, array_to_string(ts[start + 1:start + n], ' ') as gram, ts[greatest(start - 7, 1):start] as before from ps, (select distinct size as n from vt) where start + n <= len(ts)),
  ht as (select text_id, start, size, term, canonical, slot, before from gr join vt using (gram, size)),
  hn as (select *, list_has_any(list_slice(before, coalesce(list_max(list_filter(range(1, len(before) + 1), lambda i: before[i] in ('.', ';', '!', '?'))), 0) + 1, len(before)), ['no', 'not', 'without', 'denies', 'denied', 'excluded', 'absent', 'never']) as negated from ht)"""


def _terms(b):
    words = F.split(F.regexp_replace(F.trim(F.lower("text")), r"\s+", " "), " ")
    cut = b.documents.select(words.alias("w"), F.col("lang").alias("slot"), (F.col("doc_id") % 3 + 1).cast("int").alias("n")).where(F.get("w", F.lit(0)) != "")
    return cut.select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("term"), F.get("w", F.lit(0)).alias("canonical"), "slot").distinct()


def _texts(b):
    docs = b.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    turn = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return docs.unionByName(b.conversations.select(turn.alias("text_id"), "text"))


@query(
    "tag_vocabulary",
    f"""WITH RECURSIVE {_TERMS_SQL}, pl as (select text_id, start, max(size) as size from hn group by 1, 2),
    nx as (select text_id, start, size, (select min(start) from pl q where q.text_id = pl.text_id and q.start >= pl.start + pl.size) as next from pl),
    ch as (select text_id, start, size, next from nx qualify start = min(start) over (partition by text_id)
      union all select nx.text_id, nx.start, nx.size, nx.next from ch join nx on nx.text_id = ch.text_id and nx.start = ch.next)
    select text_id, canonical, slot, count(*) as mentions, bool_and(negated) as negated from (select distinct text_id, start, size, canonical, slot, bool_or(negated) over (partition by text_id, start, size) as negated from ch join hn using (text_id, start, size)) group by 1, 2, 3""",
)
def _tag_vocabulary(b):
    return vocabulary.tag_vocabulary(_texts(b), "text_id", "text", _terms(b))


_WEIGHT_SQL = "case slot when 'en' then 1.5 when 'de' then 2.0 else 0.75 end"


@query(
    "vocabulary_classes",
    f"""WITH {_TERMS_SQL}, ev as (select text_id, term, slot, canonical, bool_and(negated) as neg from hn where text_id like 'd%' group by 1, 2, 3, 4),
    s as (select text_id, slot as class, sum(cast({_WEIGHT_SQL} as decimal(18,6))) as score, bool_or(length(canonical) > 9) as specific from ev where not neg group by 1, 2)
    select text_id, class, cast(score as double) as score from s where specific or score >= 40""",
)
def _classes(b):
    weight = F.when(F.col("slot") == "en", 1.5).when(F.col("slot") == "de", 2.0).otherwise(0.75)
    # The concept stands in the term column's place: two concepts of one term weigh twice.
    field = F.when(F.length("canonical") > 9, "label").otherwise("keywords")
    evidence = _terms(b).select("term", F.col("slot").alias("class"), field.alias("field"), weight.alias("weight"))
    docs = _texts(b).where(F.col("text_id").startswith("d"))
    return vocabulary.weigh_classes(docs, "text_id", "text", evidence, 40.0, ["label"])


# Ranges as criteria write them, one per part; positions as notes state them, one per order line.
_RANGES = ["T2-4", "T1a – T2", "≥T3", "T1 or less", "cT2b", "TX", "not stated", "T4-T1"]
_STAGES = ["stage IB-IIIA", "II", "stage III or higher", "≤ IIA", "IV", "I to II", "Stage 0", "unknown"]
_POINTS = ["T0", "T1", "T1B", "T2", "T2C", "T3", "T4", "T4B", "TIS"]


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Ranks of the range texts, worked out by hand from the order of the labels.
_T_BOUNDS = {"T2-4": (7, 16), "T1a – T2": (4, 10), "≥T3": (11, 16), "T1 or less": (0, 6), "cT2b": (9, 9), "TX": (0, 0)}
_S_BOUNDS = {"stage IB-IIIA": (3, 9), "II": (4, 7), "stage III or higher": (8, 15), "≤ IIA": (0, 5), "IV": (12, 15), "I to II": (1, 7), "Stage 0": (0, 0)}
_T_RANKS = {"T0": 1, "T1": 3, "T1B": 5, "T2": 7, "T2C": 10, "T3": 11, "T4": 14, "T4B": 16, "TIS": 2}


def _bounds_sql(bounds) -> str:
    return "(values " + ", ".join(f"('{x}', {lo}, {hi})" for x, (lo, hi) in bounds.items()) + ")"


@query(
    "scale_containment",
    f"""WITH r as (select p_size as size, ({_list_sql(_RANGES)})[p_partkey % {len(_RANGES)} + 1] as written, count(*) as parts from part group by 1, 2),
    p as (select l_linenumber as line, ({_list_sql(_POINTS)})[l_suppkey % {len(_POINTS)} + 1] as stated, count(*) as lines from lineitem group by 1, 2),
    b as (select * from {_bounds_sql(_T_BOUNDS)} t(written, lo, hi)), k as (select * from (values {', '.join(f"('{x}', {i})" for x, i in _T_RANKS.items())}) t(stated, rank))
    select size, line, stated, written, parts, lines from r join b using (written) join (p join k using (stated)) on rank between lo and hi""",
)
def _containment(b):
    ranges = b.part.groupBy(F.col("p_size").alias("size"), _pick(_RANGES, F.col("p_partkey")).alias("written")).agg(F.count(F.lit(1)).alias("parts"))
    ranges = ranges.select(F.lit("t").alias("scale"), "*", scales.rank_range("t", F.col("written")).alias("r")).select("*", "r.*").drop("r")
    points = b.lineitem.groupBy(F.col("l_linenumber").alias("line"), _pick(_POINTS, F.col("l_suppkey")).alias("stated")).agg(F.count(F.lit(1)).alias("lines"))
    points = points.select(F.lit("t").alias("scale"), "*", scales.rank_range("t", F.col("stated"))["lo"].alias("rank"))
    return scales.contained(points, ranges).select("size", "line", "stated", "written", "parts", "lines")


@query(
    "scale_overlap",
    f"""WITH b as (select * from {_bounds_sql(_S_BOUNDS)} t(written, lo, hi)),
    x as (select c_nationkey as nation, ({_list_sql(_STAGES)})[c_custkey % {len(_STAGES)} + 1] as written, count(*) as people from customer group by 1, 2),
    y as (select s_nationkey as region, ({_list_sql(_STAGES)})[s_suppkey % {len(_STAGES)} + 1] as written, count(*) as trials from supplier group by 1, 2)
    select nation, region, x.written as stage, y.written as criterion, people, trials from (x join b using (written)) x join (y join b using (written)) y on x.lo <= y.hi and y.lo <= x.hi""",
)
def _overlap(b):
    def ranged(df, text, lo, hi):
        found = df.select(F.lit("stage").alias("scale"), "*", scales.rank_range("stage", F.col(text)).alias("r")).where("r is not null")
        return found.select("*", F.col("r.lo").alias(lo), F.col("r.hi").alias(hi)).drop("r")

    people = b.customer.groupBy(F.col("c_nationkey").alias("nation"), _pick(_STAGES, F.col("c_custkey")).alias("stage")).agg(F.count(F.lit(1)).alias("people"))
    trials = b.supplier.groupBy(F.col("s_nationkey").alias("region"), _pick(_STAGES, F.col("s_suppkey")).alias("criterion")).agg(F.count(F.lit(1)).alias("trials"))
    both = scales.overlapping(ranged(people, "stage", "lo", "hi"), ranged(trials, "criterion", "low", "high"))
    return both.select("nation", "region", "stage", "criterion", "people", "trials")


@query(
    "scale_groups",
    f"""WITH b as (select * from {_bounds_sql(_S_BOUNDS)} t(written, lo, hi)), o as (select o_orderkey, ({_list_sql(_STAGES)})[o_custkey % {len(_STAGES)} + 1] as written from orders)
    select o_orderkey, written, array_to_string((['0', 'I', 'IA', 'IB', 'II', 'IIA', 'IIB', 'IIC', 'III', 'IIIA', 'IIIB', 'IIIC', 'IV', 'IVA', 'IVB', 'IVC'])[lo + 1:hi + 1], ' ') as members from o left join b using (written)""",
)
def _groups(b):
    written = b.orders.select("o_orderkey", _pick(_STAGES, F.col("o_custkey")).alias("written"))
    return written.select("o_orderkey", "written", F.array_join(scales.members("stage", scales.rank_range("stage", F.col("written"))), " ").alias("members"))
