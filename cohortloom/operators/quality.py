"""Evidence quality: contradictions, consensus, number and citation grounding."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.parse import round_half_up
from cohortloom.operators.retrieval import LANDMARKS, top_per
from cohortloom.operators.tagging import DOSE_RE, HR_RE, RATE_RE, findings
from cohortloom.session import shuffled

# Tolerances of the number checks, and doses that are common knowledge.
ABSOLUTE_TOLERANCE = 1.0
RELATIVE_TOLERANCE = 0.05
KNOWN_CONSTANTS = [
    "50 gy", "2 gy/fraction", "1.8 gy", "60 gy", "45 gy", "70 gy", "54 gy", "30 gy", "20 gy", "66 gy", "74 gy", "50.4 gy",
    "1.8 gy/fraction", "2 gy per fraction", "100 mg/m2", "75 mg/m2", "200 mg", "240 mg", "480 mg", "3 mg/kg", "10 mg/kg",
]
CITATION_RE = r"([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ\-']{2,})(?:\s+et\s+al\.?)?[,\s]+((?:19|20)\d{2})"
NEEDS_GUIDELINE = r"nccn|category\s*\d|guideline[s]?\s+recommend|(?:first|second|third)[- ]?line\s+(?:therapy|treatment|regimen)|preferred\s+(?:regimen|treatment|therapy)|standard\s+(?:of\s+care|treatment)"


def _pairs(a: Column, b: Column, test) -> Column:
    """First pair (in mention order) of the two lists that fulfils the test."""
    grid = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return F.get(F.filter(grid, lambda p: test(p["a"], p["b"])), F.lit(0))


def contradictions(ranked: DataFrame, text: str, k: int | None = None) -> DataFrame:
    """Contradictory doses, rates and hazard ratios among the studies of a query.

    ``ranked`` holds query_id, doc_id, pos and the text. Every two studies of a query are compared, or
    of its first ``k`` where the caller states a number. Studies without findings leave first; the
    findings of the others, not their texts, meet in an equi join on the query, which AQE can split.
    """
    rows = ranked if k is None else ranked.filter(F.col("pos") <= k)
    t = F.col(text)
    found = rows.select(
        "query_id", "pos", "doc_id", F.slice(findings(t, DOSE_RE, 2), 1, 2).alias("doses"), findings(t, RATE_RE, 2).alias("rates"), F.slice(findings(t, HR_RE, 3), 1, 1).alias("hrs")
    ).filter((F.size("doses") > 0) | (F.size("rates") > 0) | (F.size("hrs") > 0))
    side = lambda n: found.select("query_id", F.col("pos").alias(f"pos_{n}"), F.struct("doc_id", "doses", "rates", "hrs").alias(n))
    rows = side("x").join(side("y"), "query_id").filter(F.col("pos_x") < F.col("pos_y"))
    dose = _pairs(F.col("x.doses"), F.col("y.doses"), lambda a, b: F.abs(a["value"] - b["value"]) / F.greatest(a["value"], b["value"]) > 0.10)
    rate = _pairs(
        F.col("x.rates"), F.col("y.rates"),
        lambda a, b: (a["extra"].isNull() | b["extra"].isNull() | (a["extra"] == b["extra"])) & (F.abs(a["value"] - b["value"]) > 15),
    )
    hr = _pairs(
        F.col("x.hrs"), F.col("y.hrs"), lambda a, b: ((a["value"] < 0.9) & (b["value"] > 1.1)) | ((a["value"] > 1.1) & (b["value"] < 0.9))
    )
    dose_level = lambda p: F.when(F.abs(p["a"]["extra"] - p["b"]["extra"]) > 3, "major").otherwise("minor")
    rate_level = lambda p: F.when(F.abs(p["a"]["value"] - p["b"]["value"]) > 25, "major").otherwise("minor")
    found = F.array(
        F.struct(F.lit("dose").alias("topic"), dose.alias("p"), dose_level(dose).alias("severity")),
        F.struct(F.lit("survival").alias("topic"), rate.alias("p"), rate_level(rate).alias("severity")),
        F.struct(F.lit("hazard_ratio").alias("topic"), hr.alias("p"), F.lit("major").alias("severity")),
    )
    out = rows.select("query_id", F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b"), F.explode(found).alias("f"))
    return out.filter(F.col("f.p").isNotNull()).select(
        "query_id", "doc_a", "doc_b", F.col("f.topic").alias("topic"), F.col("f.severity").alias("severity"),
        F.col("f.p.a.raw").alias("finding_a"), F.col("f.p.b.raw").alias("finding_b"),
    )


def consensus(found: DataFrame, query: str, doc: str) -> DataFrame:
    """Doses and rates (rounded to the nearest 5, half to even) that several distinct studies report."""
    rows = found.filter(F.col("kind").isin("dose", "survival_rate")).withColumn("rounded", (F.bround(F.col("value") / 5, 0) * 5).cast("int"))
    timed = rows.withColumn("timepoint", F.when(F.col("kind") == "survival_rate", F.col("extra").cast("int")))
    distinct = timed.select(query, doc, "kind", "rounded", "timepoint").distinct()
    return distinct.groupBy(query, "kind", "rounded", "timepoint").agg(F.count(F.lit(1)).alias("studies")).filter(F.col("studies") >= 2)


def confidence(studies: DataFrame, agreed: DataFrame, contra: DataFrame, query: str) -> DataFrame:
    """Score from distinct studies, consensus and contradictions, with its level."""
    n = studies.groupBy(query).agg(F.count_distinct("doc_id").alias("studies"))
    high = agreed.groupBy(query).agg(F.count_if(F.col("studies") >= 3).alias("high"))
    bad = contra.groupBy(query).agg(F.count_if(F.col("severity") == "major").alias("major"), F.count_if(F.col("severity") == "minor").alias("minor"))
    joined = n.join(high, query, "left").join(bad, query, "left").fillna(0, ["high", "major", "minor"])
    s = F.col("studies")
    base = F.when(s >= 5, 0.8).when(s >= 3, 0.7).when(s >= 2, 0.6).otherwise(0.4)
    raw = base + F.least(F.lit(0.15), F.col("high") * 0.05) - F.col("major") * 0.15 - F.col("minor") * 0.05
    score = F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), raw)), 6)
    level = F.when(score >= 0.75, "high").when(score >= 0.55, "moderate").when(score >= 0.35, "low").otherwise("uncertain")
    return joined.select(query, "studies", "high", "major", "minor", round_half_up(score, 2).alias("score"), level.alias("level"))


def dose_table(found: DataFrame, doc: str) -> DataFrame:
    """At most the first two doses per study with the dose per fraction."""
    rows = found.filter((F.col("kind") == "dose") & (F.col("pos") < 2))
    return rows.select(doc, "pos", F.col("value").alias("dose"), F.col("extra").alias("fractions"), round_half_up(F.col("value") / F.col("extra"), 2).alias("per_fraction"))


def results_comparison(found: DataFrame, doc: str) -> DataFrame:
    """First rate and first hazard ratio per study."""
    first = found.filter(F.col("kind").isin("survival_rate", "hazard_ratio") & (F.col("pos") == 0))
    rate, hr = F.col("kind") == "survival_rate", F.col("kind") == "hazard_ratio"
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    return first.groupBy(doc).agg(
        pick(rate, "value").alias("rate"), pick(rate, "extra").alias("timepoint"), pick(hr, "value").alias("hr"), pick(hr, "extra").alias("ci_low"), pick(hr, "extra2").alias("ci_high")
    )


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """For every left row the nearest right value within the tolerance, by buckets as wide as the tolerance.

    Values of both sides are made distinct first, matched once, and joined back, so equal left rows
    all stay. A value looks into three buckets, so nothing is compared outside them. Both joins shuffle, whatever
    sizes Spark guesses for numbers read from texts.
    """
    bucket = F.floor(F.col(value) / tolerance).cast("bigint")
    side = right.select(*keys, F.col(value).alias("found")).distinct().withColumn("bucket", F.floor(F.col("found") / tolerance).cast("bigint"))
    asks = left.select(*keys, value).distinct().withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    gap = F.abs(F.col("found") - F.col(value))
    near = asks.join(shuffled(side), [*keys, "bucket"]).filter(gap <= tolerance).groupBy(*keys, value).agg(F.min(F.struct(gap.alias("gap"), F.col("found").alias("found"))).alias("_n"))
    return left.join(shuffled(near), [*keys, value], "left").select(*left.columns, F.col("_n.found").alias("found"), F.col("_n.gap").alias("gap"))


def validate_numbers(answers: DataFrame, sources: DataFrame, key: str, tolerance: float = ABSOLUTE_TOLERANCE) -> DataFrame:
    """Answer numbers with a source number of the same kind: exact to one decimal, within the tolerance, or none.

    "95% CI" is boilerplate and skipped.
    """
    kept = answers.filter(~((F.col("kind") == "percentage") & (F.col("value") == 95.0) & F.lower("raw").rlike("ci|confidence")))
    checked = band_join(kept.select(key, "kind", "pos", "value", "raw"), sources, [key, "kind"], "value", tolerance)
    exact = F.round("found", 1) == F.round("value", 1)
    verdict = F.when(F.col("found").isNull(), "unvalidated").when(exact, "exact").otherwise("near")
    return checked.withColumn("verdict", verdict)


def validation_rate(docs: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """Share of validated numbers per answer, 1 when it has none."""
    counts = checked.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") != "unvalidated").alias("validated"))
    total = F.coalesce("total", F.lit(0))
    rate = F.when(total > 0, F.col("validated") / F.col("total")).otherwise(1.0)
    return docs.select(key).join(shuffled(counts), key, "left").select(key, total.alias("total"), F.coalesce("validated", F.lit(0)).alias("validated"), rate.alias("rate"))


def strip_unverified(text: Column, raws: Column) -> Column:
    """The first place of every unvalidated number, in order, becomes "[unverified]"."""

    def step(acc: Column, raw: Column) -> Column:
        at = F.instr(acc, raw)
        cut = F.concat(F.substring(acc, F.lit(1), at - 1), F.lit("[unverified]"), F.substring(acc, at + F.length(raw), F.length(acc)))
        return F.when(at > 0, cut).otherwise(acc)

    return F.aggregate(raws, text, step)


# Fixed value: a percentage in an answer.
PERCENTAGE = r"(?i)(\d+\.?\d*)\s*%"


def stat_additions(sources: DataFrame, key: str) -> DataFrame:
    """Per key a map from a percentage, to one decimal, to what its source states beside it.

    ``sources`` has (key, ord, value, ci_low, ci_high, p_value, hr), NULL where nothing is stated. Of several sources of a
    value the one that states most counts, then the first. One row per key and value is left before a map is built.
    """
    both = F.col("ci_low").isNotNull() & F.col("ci_high").isNotNull()
    parts = F.array_compact(F.array(
        F.when(both, F.concat(F.lit("95% CI: "), F.col("ci_low").cast("string"), F.lit("-"), F.col("ci_high").cast("string"), F.lit("%"))),
        F.concat(F.lit("p="), F.col("p_value").cast("string")),
        F.concat(F.lit("HR="), F.col("hr").cast("string")),
    ))
    said = both.cast("int") * 2 + F.col("p_value").isNotNull().cast("int") + F.col("hr").isNotNull().cast("int")
    rows = sources.select(key, "ord", F.round("value", 1).cast("decimal(12,1)").cast("string").alias("at"), said.alias("said"), F.array_join(parts, ", ").alias("text"))
    best = rows.groupBy(key, "at").agg(F.max_by(F.struct("said", "text"), F.struct("said", -F.col("ord"))).alias("b")).where("b.said > 0")
    return best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "b.text"))).alias("additions"))


def enrich(text: Column, additions: Column) -> Column:
    """Every percentage with a known value is followed by what its source states, in one pass over the text."""
    found, gaps = F.regexp_extract_all(text, F.lit(PERCENTAGE), F.lit(0)), F.split(text, PERCENTAGE, -1)
    value = lambda raw: F.round(F.regexp_extract(raw, PERCENTAGE, 1).try_cast("double"), 1).cast("decimal(12,1)").cast("string")
    said = F.transform(found, lambda raw: F.concat(raw, F.coalesce(F.concat(F.lit(" ("), F.try_element_at(additions, value(raw)), F.lit(")")), F.lit(""))))
    joined = F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), said, lambda gap, s: F.concat(gap, s)), "")
    return F.concat(joined, F.element_at(gaps, -1))


def relaxed_validation(answers: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """VERIFIED, KNOWN_CONSTANT, LIKELY_CORRECT (within 5 % of a source number) or UNVERIFIED.

    The 5 % band is an equi join on buckets of the logarithm. All joins shuffle.
    """
    width = -math.log(1 - RELATIVE_TOLERANCE)
    exact = sources.select(key, F.lower("raw").alias("raw")).distinct().withColumn("_x", F.lit(True))
    known = F.lower("raw").isin(KNOWN_CONSTANTS)
    side = sources.filter(F.col("value") > 0).select(key, F.col("value").alias("found")).distinct().withColumn("bucket", F.floor(F.ln("found") / width))
    asks = answers.select(key, "kind", "pos", "value", F.lower("raw").alias("raw"))
    at = F.floor(F.ln("value") / width)
    near = (
        asks.filter(F.col("value") > 0).withColumn("bucket", F.explode(F.array(at - 1, at, at + 1))).join(shuffled(side), [key, "bucket"])
        .filter(F.abs(F.col("value") - F.col("found")) / F.col("found") <= RELATIVE_TOLERANCE)
        .select(key, "kind", "pos").distinct().withColumn("_n", F.lit(True))
    )
    joined = asks.join(shuffled(exact), [key, "raw"], "left").join(shuffled(near), [key, "kind", "pos"], "left")
    verdict = F.when(F.col("_x"), "VERIFIED").when(known, "KNOWN_CONSTANT").when(F.col("_n"), "LIKELY_CORRECT").otherwise("UNVERIFIED")
    return joined.select(key, "kind", "pos", "raw", verdict.alias("verdict"))


def verify_citations(texts: DataFrame, studies: DataFrame, key: str, text: str) -> DataFrame:
    """Every (author, year) cited, and whether a retrieved study carries it."""
    authors = F.regexp_extract_all(text, F.lit(CITATION_RE), F.lit(1))
    years = F.regexp_extract_all(text, F.lit(CITATION_RE), F.lit(2))
    cited = texts.select(key, F.posexplode(F.arrays_zip(authors.alias("a"), years.alias("y"))).alias("pos", "c")).select(
        key, "pos", F.col("c.a").alias("author"), F.col("c.y").try_cast("int").alias("year")
    )
    known = studies.select(F.lower("author").alias("_a"), F.col("year").alias("_y")).distinct().withColumn("_k", F.lit(True))
    match = (F.lower("author") == F.col("_a")) & (F.col("year") == F.col("_y"))
    return cited.join(known, match, "left").select(key, "pos", "author", "year", F.coalesce("_k", F.lit(False)).alias("verified"))


def gap_detection(queries: DataFrame, ranked: DataFrame, query_text: str, text: str, k: int) -> DataFrame:
    """Queries that need guideline evidence, and whether their first ``k`` hits hold any."""
    guideline = next(p for n, p, _ in LANDMARKS if n == "guidelines")
    top = ranked.filter(F.col("pos") <= k).groupBy("query_id").agg(F.bool_or(F.col(text).rlike(guideline)).alias("has"))
    needs = F.lower(query_text).rlike(NEEDS_GUIDELINE)
    joined = queries.withColumn("needs", needs).join(top, "query_id", "left")
    has = F.col("needs") & F.coalesce("has", F.lit(False))
    return joined.select("query_id", "needs", has.alias("has_guideline"), (F.col("needs") & ~has).alias("gap"))


def packet_summary(ranked: DataFrame, text_key: str, k: int) -> DataFrame:
    """Per query its first ``k`` distinct passages as a list, with flags over them."""
    best = top_per(ranked, ["query_id", text_key], [F.asc("pos")], 1, "_p")
    top = top_per(best, ["query_id"], [F.asc("pos")], k)
    return top.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("passages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda e: e["doc_id"].cast("string")), ",").alias("documents"),
        F.max("score").alias("best"),
        F.bool_or(F.col("chunk_type") == "table_row").alias("has_table"),
    )


def value_grounded(value: Column, source: Column) -> Column:
    """Every number of a field stands in the source text."""
    numbers = F.regexp_extract_all(value, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.when(F.size(numbers) > 0, F.forall(numbers, lambda n: source.contains(n))).otherwise(True)


def source_finder(values: DataFrame, chunks: DataFrame, doc: str, context: Sequence[str], k: int) -> DataFrame:
    """Passages of a document scored for an extracted value; back matter is skipped."""
    skip = F.lower(F.coalesce("section", F.lit(""))).rlike("acknowledg|reference|funding|conflict")
    low, sec = F.lower("text"), F.lower(F.coalesce("section", F.lit("")))
    parts = F.regexp_extract_all("value", F.lit(r"\d+\.?\d*"), F.lit(0))
    points = (
        F.when(low.contains(F.lower("value")), 10).otherwise(0)
        + F.size(F.filter(parts, lambda p: low.contains(p))) * 5
        + sum((F.when(low.contains(w), 2).otherwise(0) for w in context), F.lit(0))
        + F.when(sec.contains("result"), 3).when(sec.contains("method"), 2).when(sec.contains("abstract"), 1).otherwise(0)
    )
    scored = values.join(chunks.filter(~skip), doc).withColumn("points", points).filter(F.col("points") > 0)
    return top_per(scored, ["value_id"], [F.desc("points"), F.asc("chunk_id")], k)


def mode_share(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent value per key with its share, ties to the value seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col("_first"))).alias("answer"),
        (F.max("n") / F.sum("n")).alias("share"),
    )


def precision_recall(ranked: DataFrame, truth: DataFrame, k: int, k_recall: int) -> DataFrame:
    """Precision at k, recall at k_recall and forbidden documents returned, per query."""
    marked = ranked.join(truth, ["query_id", "doc_id"], "left")
    relevant = F.coalesce(F.col("truth") == "relevant", F.lit(False))
    forbidden = F.coalesce(F.col("truth") == "forbidden", F.lit(False))
    per_query = marked.groupBy("query_id").agg(
        F.count_if(F.col("pos") <= k).alias("shown"),
        F.count_if((F.col("pos") <= k) & relevant).alias("hits"),
        F.count_if((F.col("pos") <= k_recall) & relevant).alias("found"),
        F.count_if((F.col("pos") <= k) & forbidden).alias("violations"),
    )
    expected = truth.filter(F.col("truth") == "relevant").groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    joined = per_query.join(expected, "query_id", "left")
    return joined.select(
        "query_id", (F.col("hits") / F.least(F.lit(k), F.col("shown"))).alias("precision"),
        F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(0.0).alias("recall"), "violations",
    )


def coverage_grade(answer: Column, reference: Column, concepts: Column, cites: Column) -> tuple[Column, Column, Column, Column]:
    """Similarity by edit distance, concept and citation coverage, and the grade they give."""
    low = F.lower(answer)
    share = lambda xs: F.when(F.size(xs) > 0, F.size(F.filter(xs, lambda x: low.contains(F.lower(x)))) / F.size(xs)).otherwise(0.0)
    longest = F.greatest(F.length(answer), F.length(reference))
    similarity = F.when(longest > 0, 1 - F.levenshtein(low, F.lower(reference)) / longest).otherwise(1.0)
    concept, cite = share(concepts), share(cites)
    grade = (
        F.when((similarity > 0.8) & (cite > 0.7), "excellent").when((similarity > 0.6) & (concept > 0.6), "pass")
        .when((similarity > 0.5) | (concept > 0.5), "partial").otherwise("fail")
    )
    return similarity, concept, cite, grade

