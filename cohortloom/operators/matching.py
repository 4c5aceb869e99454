"""Structured matching and applicability of profiles against studies.

Scores are columns over (case, study) rows. The rows come from an equi join on the gate
axis (site), with the batch of cases broadcast only when its size is checked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.binding import let
from cohortloom.operators.retrieval import top_per

# Base weights of the match criteria.
BASE_WEIGHTS = {
    "cancer_site": 25, "site_detail": 10, "histology": 15, "stage": 15, "disease_descriptor": 8, "tnm_t": 5, "tnm_n": 5,
    "tnm_m": 5, "treatment": 15, "treatment_setting": 8, "age_range": 5, "gender": 3, "performance_status": 5,
    "biomarkers": 20, "metastatic_sites": 8, "title_relevance": 10, "metastatic_status": 15, "risk_stratification": 8,
    "biomarker_jsonb": 20,
}
# Overlap score weights and the cap for a wrong disease.
OVERLAP_WEIGHTS = {"cancer_type": 25, "cancer_sites": 15, "histologies": 15, "stages": 10, "biomarkers": 15, "prior_treatments": 10, "disease_status": 10}
SUBSTRING_AXES = ("biomarkers", "prior_treatments")
WRONG_TYPE_CAP = 35
# Points of a verdict and weights of the judged axes.
VERDICT_POINTS = {"MATCH": 1.0, "EXACT": 1.0, "COMPATIBLE": 0.7, "PARTIAL": 0.4, "NA": 0.0, "MISMATCH": -0.2}
VERDICT_WEIGHTS = {"histology": 15, "stage": 15, "biomarkers": 20, "prior_treatment": 15, "setting": 10}
HARD_DROP_AXES = ("cancer_type", "histology", "stage", "prior_treatment", "disease_status", "surgical_candidacy")
MIN_STUDIES = 3
RESTORED_FACTOR = 0.3
# Axis weights per question intent, and the share lost on a treatment conflict.
INTENT_WEIGHTS = {
    "medication": {"semantic": 0.30, "symptom": 0.05, "modality": 0.15, "regimen": 0.10, "drug": 0.20, "cancer": 0.05, "phase": 0.05, "authority": 0.10},
    "symptom": {"semantic": 0.25, "symptom": 0.25, "modality": 0.15, "regimen": 0.05, "drug": 0.05, "cancer": 0.05, "phase": 0.10, "authority": 0.10},
    "nutrition": {"semantic": 0.30, "symptom": 0.20, "modality": 0.10, "regimen": 0.05, "drug": 0.05, "cancer": 0.05, "phase": 0.15, "authority": 0.10},
    "treatment": {"semantic": 0.25, "symptom": 0.05, "modality": 0.20, "regimen": 0.15, "drug": 0.05, "cancer": 0.15, "phase": 0.05, "authority": 0.10},
    "diagnosis": {"semantic": 0.30, "symptom": 0.05, "modality": 0.05, "regimen": 0.05, "drug": 0.05, "cancer": 0.30, "phase": 0.05, "authority": 0.15},
    "general": {"semantic": 0.35, "symptom": 0.10, "modality": 0.10, "regimen": 0.05, "drug": 0.05, "cancer": 0.10, "phase": 0.05, "authority": 0.20},
}
CONFLICT_PENALTY = 0.35
HARD_PENALTY = 0.35
# Prior score by authority tier, score of the untagged, and its share in the blend.
TIER_SCORES = [1.0, 0.85, 0.7, 0.55, 0.45, 0.35]
UNTAGGED_PRIOR = 0.5
PRIOR_WEIGHT = 0.15
# Other names and status words of the markers matched in a status map.
MARKER_ALIASES = {"her2": ["HER2", "ERBB2"], "er": ["ER", "ESR1"], "pdl1": ["PD-L1"], "egfr": ["EGFR"]}
STATUS_WORDS = {"positive": ["positive", "high", "amplified", "mutant"], "negative": ["negative", "low", "wild-type", "stable"]}


def case_pairs(cases: DataFrame, studies: DataFrame, gate: str = "site") -> DataFrame:
    """Candidate rows: studies of the case's site. Cases without a site have no candidates."""
    return studies.join(cases.filter(F.col(gate).isNotNull()), gate)


def either_contains(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    return x.contains(y) | y.contains(x)


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


# ---- case and profile scores -------------------------------------------------------------------


def case_similarity(axes: Sequence[tuple[Column, Column, float]]) -> Column:
    """weighted hits over the axes that count; an axis is (counts, share hit, weight)."""
    hit = total([F.when(F.coalesce(on, F.lit(False)), F.coalesce(share, F.lit(0.0)) * w).otherwise(0.0) for on, share, w in axes])
    possible = total([F.when(F.coalesce(on, F.lit(False)), F.lit(float(w))).otherwise(0.0) for on, _, w in axes])
    return F.when(possible > 0, hit / possible).otherwise(0.0)


def age_share(age: Column, median: Column) -> Column:
    """Full credit at the study's median age, none ten years away."""
    gap = F.abs(age - median)
    return F.when(gap <= 10, 1 - gap / 10).otherwise(0.0)


def tiered(*tiers: tuple[Column, float], full: float) -> Column:
    """points of the first tier that holds, as a share of the full points."""
    out = F.lit(0.0)
    for condition, points in reversed(tiers):
        out = F.when(condition, F.lit(points / full)).otherwise(out)
    return out


def sort_by_preference(df: DataFrame, by: str) -> DataFrame:
    """all rows in order of a preference; outcomes weigh overall survival 1 and progression-free survival .8."""
    keys = {
        "relevance": F.col("relevance"),
        "patient_relevance": F.col("relevance"),
        "population": F.col("number_of_patients"),
        "date": F.col("publish_date"),
        "citations": F.col("citation_count"),
        "outcomes": F.coalesce("os_rate_percent", F.lit(0.0)) + 0.8 * F.coalesce("pfs_rate_percent", F.lit(0.0)),
    }
    return df.withColumn("sort_key", keys[by].cast("string")).orderBy(keys[by].desc_nulls_last(), F.asc("study_id"))


def dynamic_weights(present: DataFrame, user: Mapping[str, float]) -> DataFrame:
    """weights of the criteria present, user factors in [0, 3], scaled to 100, residue to the heaviest.

    ``present``: case_id, criterion, one row each; a case has at most as many rows as there are criteria.
    """
    order = {name: i for i, name in enumerate(BASE_WEIGHTS)}
    base, factor, rank = F.lit(0.0), F.lit(1.0), F.lit(99)
    for name, weight in BASE_WEIGHTS.items():
        hit = F.col("criterion") == name
        base = F.when(hit, F.lit(float(weight))).otherwise(base)
        rank = F.when(hit, F.lit(order[name])).otherwise(rank)
        factor = F.when(hit, F.lit(max(0.0, min(3.0, float(user.get(name, 1.0)))))).otherwise(factor)
    case = Window.partitionBy("case_id")
    rows = present.withColumn("raw", base * factor).withColumn("_rank", rank).filter(F.col("_rank") < 99)
    scaled = rows.withColumn("_sum", F.sum("raw").over(case)).filter(F.col("_sum") > 0)
    rounded = scaled.withColumn("weight", F.bround(F.col("raw") * (100 / F.col("_sum")), 0).cast("int"))
    heaviest = F.row_number().over(case.orderBy(F.desc("weight"), F.asc("_rank")))
    residue = 100 - F.sum("weight").over(case)
    return rounded.withColumn("_h", heaviest).withColumn("weight", F.col("weight") + F.when(F.col("_h") == 1, residue).otherwise(0).cast("int")).select(
        "case_id", "criterion", "weight"
    )


def map_alias_match(status_map: Column, marker: Column, wanted: Column) -> Column:
    """does any alias of the marker carry a status that means the wanted one; NULL when none is reported."""
    out = F.lit(None).cast("boolean")
    for name, aliases in MARKER_ALIASES.items():
        values = F.array_compact(F.array(*[F.try_element_at(status_map, F.lit(a)) for a in aliases]))
        for status, words in STATUS_WORDS.items():
            hit = F.arrays_overlap(values, F.array(*map(F.lit, words)))
            out = F.when((marker == name) & (wanted == status) & (F.size(values) > 0), hit).otherwise(out)
    return out


def contra_exclusion(condition: Column) -> Column:
    """exclude only on a proven contradiction; NULL keeps the row."""
    return ~F.coalesce(condition, F.lit(False))


def structured_match(pairs: DataFrame, shares: Mapping[str, Column], weights: str, limit: int) -> DataFrame:
    """sum of share x weight per axis, axes kept as columns, best studies per case.

    ``weights`` is a map column criterion -> weight of the case.
    """
    axis = {
        name: F.coalesce(share, F.lit(0.0)) * F.coalesce(F.try_element_at(weights, F.lit(name)), F.lit(0)) for name, share in shares.items()
    }
    scored = pairs.select("*", *[c.alias(f"axis_{n}") for n, c in axis.items()]).withColumn("score", total([F.col(f"axis_{n}") for n in axis]))
    order = [F.desc("score"), F.col("number_of_patients").desc_nulls_last(), F.asc("study_id")]
    return top_per(scored, ["case_id"], order, limit)


def match_breakdown(scored: DataFrame, axes: Sequence[str], weights: str) -> DataFrame:
    """one row per axis with points earned, points possible and a label."""
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("axis"), F.col(f"axis_{a}").alias("earned"),
                F.coalesce(F.try_element_at(weights, F.lit(a)), F.lit(0)).cast("double").alias("possible"),
            )
            for a in axes
        ]
    )
    rows = scored.select("case_id", "study_id", F.explode(entries).alias("e")).select("case_id", "study_id", "e.*").filter(F.col("possible") > 0)
    label = F.when(F.col("earned") >= F.col("possible"), "exact").when(F.col("earned") > 0, "partial").otherwise("not reported")
    return rows.withColumn("label", label)


def fractional_score(wanted: Column, text: Column, weight: float) -> Column:
    """share of the wanted terms the text holds, times the weight."""
    hits = let(F.lower(text), lambda low: F.size(F.filter(wanted, lambda t: low.contains(F.lower(t)))))
    return F.when(F.size(wanted) > 0, hits / F.size(wanted) * weight).otherwise(0.0)


def _substring_hits(wanted: Column, told: Column) -> Column:
    return F.filter(wanted, lambda x: F.exists(told, lambda y: y.contains(x) | x.contains(y)))


def _member_of(values: Column):
    return lambda x: F.array_contains(values, x)


def profile_overlap(df: DataFrame, axes: Sequence[str], cap_lower_denominator: bool = False) -> DataFrame:
    """weighted overlap over arrays ``p_axis`` (profile) and ``s_axis`` (study).

    Axes the study is silent on do not count, unless its disease is unknown; a wrong disease
    caps the score. ``cap_lower_denominator`` also applies the all-axes denominator and keeps
    the lower score.
    """
    low = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    earned, strict, legacy = [], [], []
    for axis in axes:
        p, s, w = F.col(f"p_{axis}"), F.col(f"s_{axis}"), float(OVERLAP_WEIGHTS[axis])
        ls = low(s)
        matched = _substring_hits(low(p), ls) if axis in SUBSTRING_AXES else F.filter(low(p), _member_of(ls))
        asked, told = size(p) > 0, size(s) > 0
        earned.append(F.when(asked & told, w * F.size(matched) / F.size(p)).otherwise(0.0))
        strict.append(F.when(asked & told, w).otherwise(0.0))
        legacy.append(F.when(asked, w).otherwise(0.0))
    weighted, strict_total, legacy_total = total(earned), total(strict), total(legacy)
    knows_type, asks_type = size(F.col("s_cancer_type")) > 0, size(F.col("p_cancer_type")) > 0
    use_strict = (strict_total > 0) & (~asks_type | knows_type)
    base = df.withColumn("_w", weighted).withColumn("_legacy", legacy_total).withColumn("_den", F.when(use_strict, strict_total).otherwise(legacy_total))
    score = F.when(F.col("_den") == 0, 0.0).otherwise(F.bround(100.0 * F.col("_w") / F.col("_den"), 0))
    wrong = asks_type & knows_type & ~F.arrays_overlap(low(F.col("p_cancer_type")), low(F.col("s_cancer_type")))
    out = base.withColumn("score", F.when(wrong, F.least(score, F.lit(float(WRONG_TYPE_CAP)))).otherwise(score)).withColumn("capped", wrong & (score > WRONG_TYPE_CAP))
    if cap_lower_denominator:
        all_axes = F.when(F.col("_legacy") > 0, F.bround(100.0 * F.col("_w") / F.col("_legacy"), 0)).otherwise(F.col("score"))
        out = out.withColumn("score", F.least("score", all_axes))
    return out.drop("_w", "_legacy", "_den")


# ---- verdicts ----------------------------------------------------------------------------------


def soft_score(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """verdict points times axis weights as a share of all weights, blended .7/.3 with the score."""
    parts = []
    for axis in axes:
        points = F.lit(0.0)
        for verdict, value in VERDICT_POINTS.items():
            points = F.when(F.col(axis) == verdict, value).otherwise(points)
        parts.append(points * VERDICT_WEIGHTS[axis])
    full = float(sum(VERDICT_WEIGHTS.values()))
    soft = total(parts) / full * 100
    return df.withColumn("soft", soft).withColumn("blended", 0.7 * F.col("score") + 0.3 * F.col("soft") / 100)


def _mismatches(axes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(a) == "MISMATCH").cast("int") for a in axes], F.lit(0))


def tiered_eligibility(df: DataFrame, axes: Sequence[str], boost: Column) -> DataFrame:
    """hard axes drop, other mismatches cost .15 each up to .45, clean rows gain their boost."""
    hard = [a for a in axes if a in HARD_DROP_AXES]
    soft = [a for a in axes if a not in HARD_DROP_AXES]
    n = _mismatches(soft)
    penalty = F.least(n * 0.15, F.lit(0.45))
    dropped = _mismatches(hard) > 0
    tier = F.when(dropped, "hard_filter").when(n > 0, "penalty").otherwise("boost")
    final = F.when(dropped, F.col("score")).when(n > 0, F.greatest(F.lit(0.0), F.col("score") - penalty)).otherwise(F.least(F.lit(1.0), F.col("score") + boost))
    return df.withColumn("tier", tier).withColumn("final_score", final).withColumn("mismatches", _mismatches(axes))


def eligibility_fallback(df: DataFrame, floor: int = MIN_STUDIES) -> DataFrame:
    """when fewer than ``floor`` rows of a query are kept, restore the least mismatched at a reduced score."""
    kept = df.filter(F.col("tier") != "hard_filter").withColumn("restored", F.lit(False))
    counts = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept_n"))
    order = [F.asc("mismatches"), F.desc("score"), F.asc("pair_id")]
    best_removed = top_per(df.filter(F.col("tier") == "hard_filter"), ["query_id"], order, floor)
    need = floor - F.coalesce("kept_n", F.lit(0))
    restored = best_removed.join(counts, "query_id", "left").filter(F.col("rank") <= need)
    back = restored.withColumn("final_score", F.col("score") * RESTORED_FACTOR).withColumn("restored", F.lit(True)).select(*kept.columns)
    return kept.unionByName(back)


_ROMAN = r"(?:III|II|IV|I)"


def _stage_index(roman: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ["I", "II", "III", "IV"])), roman)


def stage_features(stage: Column) -> Column:
    """Stage text parsed once: clean text, base, suffix, and the ends of a range as positions."""
    one, span = rf"^({_ROMAN})([A-C]?)$", rf"^({_ROMAN})\s*[-–]\s*({_ROMAN})$"
    group = lambda c, pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return let(
        F.upper(F.trim(F.regexp_replace(F.trim(stage), r"(?i)^stage\s*", ""))),
        lambda c: F.struct(
            c.alias("clean"), group(c, one, 1).alias("base"), F.regexp_extract(c, one, 2).alias("suffix"), _stage_index(group(c, one, 1)).alias("at"),
            _stage_index(group(c, span, 1)).alias("lo"), _stage_index(group(c, span, 2)).alias("hi"),
        ),
    )


def stage_verdict(p: Column, s: Column) -> Column:
    """MATCH, COMPATIBLE (sub-stage or range) or MISMATCH of two parsed stages."""
    missing = F.coalesce(p["clean"], F.lit("")) == ""
    missing = missing | (F.coalesce(s["clean"], F.lit("")) == "")
    return (
        F.when(missing, "MISMATCH").when(p["clean"] == s["clean"], "MATCH")
        .when(s["lo"].isNotNull(), F.when(p["at"].between(s["lo"], s["hi"]), "COMPATIBLE").otherwise("MISMATCH"))
        .when((p["base"] == s["base"]) & ((p["suffix"] == "") != (s["suffix"] == "")), "COMPATIBLE").otherwise("MISMATCH")
    )


def stage_subsumption(patient: Column, study: Column) -> Column:
    """verdict on two stage texts."""
    both = F.struct(stage_features(patient).alias("p"), stage_features(study).alias("s"))
    return let(both, lambda v: stage_verdict(v["p"], v["s"]))


# ---- applicability -----------------------------------------------------------------------------


def set_match(terms: Column, tags: Column, text: Column, general: str | None = None) -> Column:
    """1 on overlap or mention, .75 on a general tag, 0 on other tags, .5 when either side is silent."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    t, g = low(terms), low(tags)
    mention = F.exists(t, lambda x: F.lower(text).contains(x))
    out = F.when(F.size(t) < 1, 0.5)
    if general:
        out = out.when(F.array_contains(g, general), 0.75)
    return out.when(F.arrays_overlap(t, g) | mention, 1.0).when(F.size(g) > 0, 0.0).otherwise(0.5)


def applicability(df: DataFrame, components: Sequence[str], intent: str, conflict: Column) -> DataFrame:
    """components weighted by the intent of the question, less a share on a treatment conflict."""
    def weighted(name: str) -> Column:
        weight = F.lit(INTENT_WEIGHTS["general"][name])
        for key, row in INTENT_WEIGHTS.items():
            weight = F.when(F.col(intent) == key, row[name]).otherwise(weight)
        return weight * F.col(name)

    combined = total([weighted(n) for n in components]) * F.when(conflict, 1 - CONFLICT_PENALTY).otherwise(1.0)
    return df.withColumn("applicability_score", combined)


def freshness(year: Column, as_of: int) -> Column:
    """1 up to three years, .2 from fifteen, linear between, .5 when unknown."""
    age = F.greatest(F.lit(0), F.lit(as_of) - year)
    return F.when(year.isNull(), 0.5).when(age <= 3, 1.0).when(age >= 15, 0.2).otherwise(1.0 - (age - 3) / 12 * 0.8)


def incompatibilities(checks: Sequence[tuple[str, Column, Column, Column]]) -> Column:
    """array of typed findings; a check is (type, severity, patient text, evidence text), severity NULL when fine."""
    return F.array_compact(
        F.array(
            *[
                F.when(sev.isNotNull(), F.struct(F.lit(kind).alias("type"), sev.alias("severity"), p.alias("patient"), e.alias("evidence")))
                for kind, sev, p, e in checks
            ]
        )
    )


def bound_check(value: Column, lo: Column, hi: Column) -> Column:
    """Hard outside the interval, unknown when the evidence states no bound, NULL when inside or not asked."""
    outside = F.coalesce(value < lo, F.lit(False)) | F.coalesce(value > hi, F.lit(False))
    return F.when(value.isNotNull(), F.when(lo.isNull() & hi.isNull(), "unknown").when(outside, "hard"))


def authority_blend(relevance: Column, tier: Column) -> Column:
    """relevance with a small share of the prior of the authority tier (1 is best)."""
    prior = F.lit(UNTAGGED_PRIOR)
    for i, score in enumerate(TIER_SCORES):
        prior = F.when(tier == i + 1 if i < len(TIER_SCORES) - 1 else tier >= i + 1, score).otherwise(prior)
    return (1 - PRIOR_WEIGHT) * relevance + PRIOR_WEIGHT * prior


def calibrate(raw: Column) -> Column:
    """F32: raw score to 0-.95 in linear pieces."""
    pieces = (
        F.when(raw >= 10, 0.90 + F.least((raw - 10) * 0.01, F.lit(0.05)))
        .when(raw >= 7, 0.75 + (raw - 7) * 0.05)
        .when(raw >= 4, 0.55 + (raw - 4) * 0.067)
        .when(raw >= 1, 0.35 + (raw - 1) * 0.067)
        .when(raw >= -2, 0.15 + (raw + 2) * 0.067)
        .otherwise(F.greatest(F.lit(0.0), 0.15 + (raw + 2) * 0.05))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(0.95), pieces))


def calibrated_scores(df: DataFrame, score: str) -> DataFrame:
    """F32: calibrated score, spread by rank position where a query's scores lie within 3 points."""
    span = df.groupBy("query_id").agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    base = calibrate(F.col(score))
    width = F.col("_hi") - F.col("_lo")
    spread = F.greatest(F.lit(0.10), base - (1 - (F.col(score) - F.col("_lo")) / width) * 0.15)
    tight = (F.col("_n") > 1) & (width > 0) & (width < 3)
    return df.join(span, "query_id").withColumn("calibrated", F.when(tight, spread).otherwise(base)).drop("_hi", "_lo", "_n")


def trial_score(checks: Sequence[tuple[Column, Column, float]]) -> tuple[Column, Column]:
    """sum of the points of the checks that hold, at most 1, and the array of their reasons."""
    score = F.least(F.lit(1.0), total([F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, _, w in checks]))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), label) for c, label, _ in checks]))
    return score, reasons


def age_in_text(age: Column, text: Column) -> Column:
    """age inside the years a text names; a single number is a minimum."""
    nums = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d{1,3})\s*(?:years?|yrs?)"), F.lit(1)), lambda n: n.cast("int"))
    return F.when(F.size(nums) >= 2, age.between(F.array_min(nums), F.array_max(nums))).when(F.size(nums) == 1, age >= F.array_min(nums)).otherwise(False)


# ---- filling and candidates --------------------------------------------------------------------


def similar_fill(structured: DataFrame, vectors: DataFrame, limit: int, exclude: Column) -> DataFrame:
    """Structured matches first, vector hits fill up; no repeats, never the query's own document."""
    first = structured.select("query_id", "doc_id", F.lit(0.9).alias("score"), F.lit(0).alias("src"))
    both = first.unionByName(vectors.select("query_id", "doc_id", "score", F.lit(1).alias("src"))).filter(~exclude)
    best = both.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("src", "score"), F.struct(F.col("src"), -F.col("score"))).alias("_b"))
    rows = best.select("query_id", "doc_id", F.col("_b.src").alias("src"), F.col("_b.score").alias("score"))
    return top_per(rows, ["query_id"], [F.asc("src"), F.desc("score"), F.asc("doc_id")], limit)


def record_candidates(signals: DataFrame, records: DataFrame, owner: str, axes: Sequence[str]) -> DataFrame:
    """Best record per signal of the same owner by axes that contain one another either way.

    Signals and records are first reduced to distinct axis combinations per owner, so equal
    records are compared once; the count of records behind the best score is exact.
    """
    left = signals.groupBy(owner, *[F.col(a).alias(f"n_{a}") for a in axes]).agg(F.count(F.lit(1)).alias("_s"))
    right = records.groupBy(owner, *axes).agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("_r"))
    hit = lambda a: F.coalesce((F.col(a) != "") & (F.col(f"n_{a}") != "") & either_contains(F.col(a), F.col(f"n_{a}")), F.lit(False))
    clash = F.lit(False)
    for a in axes:
        clash = clash | F.coalesce((F.col(a) != "") & (F.col(f"n_{a}") != "") & ~either_contains(F.col(a), F.col(f"n_{a}")), F.lit(False))
    scored = left.join(right, owner).withColumn("score", reduce(lambda x, y: x + y, [hit(a).cast("int") for a in axes])).withColumn("conflict", clash)
    names = [f"n_{a}" for a in axes]
    kept = scored.filter(F.col("score") > 0)
    summary = kept.groupBy(owner, *names).agg(
        F.max_by(F.struct("record_id", "conflict", "score"), F.struct(F.col("score"), -F.col("record_id"))).alias("_b"), F.sum("_r").alias("candidates")
    )
    keyed = signals.select("signal_id", owner, *[F.col(a).alias(f"n_{a}") for a in axes])
    renamed = summary.select(*[F.col(c).alias(f"_{c}") for c in [owner, *names]], "_b", "candidates")
    condition = [F.col(owner) == F.col(f"_{owner}")] + [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return keyed.join(renamed, condition).select(
        "signal_id", F.col("_b.record_id").alias("record_id"), F.col("_b.score").alias("score"), F.col("_b.conflict").alias("conflict"), "candidates"
    )


# ---- query text --------------------------------------------------------------------------------

# CPS cut points that are written out, and the ECOG scale.
CPS_CUTS = [1, 5, 10, 20, 50]
# Synonym groups appended to a query that names one of their terms.
QUERY_SYNONYMS: dict[str, list[str]] = {
    "glioblastoma": ["GBM", "glioblastoma multiforme"],
    "lung adenocarcinoma": ["NSCLC", "non-small cell lung cancer"],
    "osimertinib": ["Tagrisso", "EGFR TKI"],
    "metastases": ["metastatic disease", "stage IV"],
    "melanoma": ["cutaneous melanoma"],
}


def range_expand(kind: str, value: Column) -> Column:
    """Members of a written range ("0-1", "≥65", "100") as an array of terms."""
    lo = F.regexp_extract(value, r"(\d+)", 1).try_cast("int")
    hi = F.coalesce(F.nullif(F.regexp_extract(value, r"\d+\s*[-–]\s*(\d+)", 1), F.lit("")).try_cast("int"), lo)
    if kind == "ecog":
        low = value.rlike(r"(?i)<|≤|at most|up to|or less")
        high = value.rlike(r"(?i)>|≥|at least|or more|\+")
        # The scale runs from 0 to 5; an open range ends where it does.
        first = F.greatest(F.lit(0), F.when(low, 0).otherwise(F.least(lo, hi)))
        last = F.least(F.lit(5), F.when(high, 5).otherwise(F.greatest(lo, hi)))
        values = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda v: (v >= first) & (v <= last))
        return F.flatten(F.transform(values, lambda v: F.array(*[F.concat(F.lit(p), v.cast("string")) for p in ("ECOG ", "PS ", "performance status ")])))
    if kind == "cps":
        cuts = F.filter(F.array(*map(F.lit, CPS_CUTS)), lambda c: c <= lo)
        named = F.flatten(F.transform(cuts, lambda c: F.array(F.concat(F.lit("CPS ≥ "), c.cast("string")), F.concat(F.lit("CPS >= "), c.cast("string")))))
        own = F.array(F.concat(F.lit("CPS "), lo.cast("string")), F.concat(F.lit("CPS score "), lo.cast("string")))
        high = F.when(lo >= 50, F.array(F.lit("PD-L1 high"), F.lit("high CPS"))).otherwise(F.array().cast("array<string>"))
        positive = F.when(lo >= 1, F.array(F.lit("PD-L1 positive"), F.lit("CPS positive"))).otherwise(F.array().cast("array<string>"))
        return F.concat(named, own, high, positive)
    if kind == "age":
        base = F.array(lo.cast("string"), (F.floor(lo / 10) * 10).cast("string"))
        older = F.when(lo >= 65, F.array(F.lit("elderly"), F.lit("older adult"))).when(lo < 40, F.array(F.lit("young adult"))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(base, older))
    raise ValueError("kind must be ecog, cps or age")


def query_expand(text: Column, extra: Column, max_terms: int | None = None) -> Column:
    """The query followed by sorted distinct new terms, the first ``max_terms`` if given."""
    low = F.lower(text)
    groups = [
        F.when(low.contains(trigger), F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")) for trigger, terms in QUERY_SYNONYMS.items()
    ]
    added = F.array_sort(F.array_distinct(F.filter(F.concat(*groups, extra), lambda t: ~low.contains(F.lower(t)))))
    added = F.slice(added, 1, max_terms) if max_terms else added
    return F.when(F.size(added) > 0, F.concat(text, F.lit(" "), F.array_join(added, " "))).otherwise(text)


def threshold_status(marker: Column) -> Column:
    """I28: "marker:status" of a numeric marker statement, NULL when it is none."""
    norm = F.trim(F.regexp_replace(F.replace(F.replace(F.lower(marker), F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<=")), r"\s+", " "))
    pdl1 = r"^(?:pd-?l1\s+)?(cps|tps)(?:\s*(?:score|value))?(?:\s*(?:of|=|>=?|<=?))?\s*(\d+)\s*%?$"
    kind, value = F.regexp_extract(norm, pdl1, 1), F.regexp_extract(norm, pdl1, 2).try_cast("int")
    cut = F.when(kind == "cps", 20).otherwise(50)
    onc = F.regexp_extract(norm, r"^(?:21[-\s]?gene\s+)?(?:oncotype(?:\s*dx)?)?\s*(?:recurrence\s*score|rs)?\s*(?:of|=)?\s*(\d+)$", 1).try_cast("int")
    named = norm.rlike("oncotype|recurrence|21-gene")
    ki = F.regexp_extract(norm, r"^(?:ki-?67|mki67)\s*(?:index\s*)?(?:of|=)?\s*(\d+)\s*%?$", 1).try_cast("int")
    return (
        F.when(value == 0, "PD-L1:negative").when(value >= cut, "PD-L1:high").when(value.isNotNull(), "PD-L1:positive")
        .when(named & (onc < 11), "ONCOTYPE:low").when(named & (onc < 26), "ONCOTYPE:intermediate").when(named & onc.isNotNull(), "ONCOTYPE:high")
        .when(ki >= 20, "Ki-67:high").when(ki.isNotNull(), "Ki-67:low")
    )


# Text signs that a question is about one patient, with their points; two points decide.
PATIENT_SIGNS: list[tuple[str, int]] = [
    (r"(?i)\b\d{1,3}[\s-]*(?:year|yr|y/?o)", 2),
    (r"(?i)\b(?:male|female|man|woman)\b", 1),
    (r"(?i)\b(?:my patient|patient with|presents with|presented with|diagnosed with)\b", 2),
    (r"(?i)\b(?:her2|er|pr|egfr|pd-l1)\s*(?:\+|positive|negative|mutated)", 2),
    (r"(?i)\b(?:prior|previous|progressed on)\b", 2),
    (r"\bT[0-4]", 1),
]


def signal_score(text: Column) -> Column:
    """I32: additive points of patient signs."""
    return reduce(lambda a, b: a + b, [F.when(text.rlike(p), n).otherwise(0) for p, n in PATIENT_SIGNS])


def threshold_stage(size_cm: Column, depth_mm: Column) -> Column:
    """Higher of the size-based and depth-based T stage."""
    by_size = F.when(size_cm <= 2, 1).when(size_cm <= 4, 2).otherwise(3)
    by_depth = F.when(depth_mm <= 5, 1).when(depth_mm <= 10, 2).otherwise(3)
    return F.concat(F.lit("T"), F.greatest(by_size, by_depth).cast("string"))


# Everyday phrases and their clinical terms.
LAY_TERMS: list[tuple[str, list[str]]] = [
    (r"(?i)\bspread\b|metastas", ["metastatic", "stage IV"]),
    (r"(?i)\btired|fatigue\b", ["fatigue", "asthenia"]),
    (r"(?i)\bchemo(?:therapy)?\b", ["chemotherapy", "systemic therapy"]),
    (r"(?i)\bbrain\b|glioblastoma", ["CNS", "intracranial"]),
    (r"(?i)\bbreast\b", ["mammary carcinoma"]),
]
# Words that show an axis is stated.
AXIS_WORDS = [
    ("cancer_type", r"(?i)\b(breast|lung|prostate|colon|colorectal|rectal|bladder|kidney|renal|liver|pancrea\w+|stomach|gastric|oesophag\w+|esophag\w+|ovar\w+|cervi\w+"
                    r"|uterine|endometrial|head and neck|throat|tongue|larynx|thyroid|melanoma|skin|lymphoma|leukemia|leukaemia|myeloma|sarcoma|brain|glioma|testic\w+)\b"),
    ("treatment", r"(?i)\b(chemo\w*|radiation|radiotherapy|immunotherapy|surgery|operation|pembrolizumab|pembro|nivolumab|nivo|targeted|hormone|infusion|pill|tablet|trial|transplant)\b"),
    ("stage", r"(?i)\b(stage\s*(?:1|2|3|4|i{1,3}v?|iv)|early|advanced|metastatic|spread|localis?ed|localiz?ed)\b"),
]


def vocab_expand(text: Column, max_terms: int | None = None) -> Column:
    """Clinical terms of the everyday phrases in a text, those already present left out; the first ``max_terms`` if given."""
    low = F.lower(text)
    groups = [F.when(text.rlike(p), F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")) for p, terms in LAY_TERMS]
    terms = F.array_distinct(F.filter(F.concat(*groups), lambda t: ~low.contains(F.lower(t))))
    return F.slice(terms, 1, max_terms) if max_terms else terms


def missing_axes(text: Column) -> Column:
    """Axes a text does not mention, most useful first."""
    return F.array_compact(F.array(*[F.when(~text.rlike(p), F.lit(name)) for name, p in AXIS_WORDS]))


# Regimens and their drugs.
REGIMENS = {"FOLFOX": ["folinic acid", "fluorouracil", "oxaliplatin"], "TCHP": ["docetaxel", "carboplatin", "trastuzumab", "pertuzumab"],
            "AC-T": ["doxorubicin", "cyclophosphamide", "paclitaxel"]}


def regimen_expand(df: DataFrame, key: str, regimen: str) -> DataFrame:
    """One row per drug of a regimen; an unknown name stands for itself."""
    drugs = F.lit(None).cast("array<string>")
    for name, parts in REGIMENS.items():
        drugs = F.when(F.upper(F.trim(regimen)) == name, F.array(*map(F.lit, parts))).otherwise(drugs)
    return df.select(key, regimen, F.explode(F.coalesce(drugs, F.array(F.lower(F.trim(regimen))))).alias("drug"))
