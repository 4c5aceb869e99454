"""Row filters with the NULL and fallback rules of study search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.binding import let
from cohortloom.functions.rules import MODALITY_WORDS, SECTION_PATTERNS, any_contains, section_type

# Words that show a race or ethnicity group in prose.
RACE_WORDS: dict[str, list[str]] = {
    "asian": ["asian", "chinese", "japanese", "korean"],
    "black": ["black", "african american"],
    "hispanic": ["hispanic", "latino"],
    "white": ["white", "caucasian"],
}

# Sections that are not searched.
SKIPPED_SECTIONS = [
    "references", "bibliography", "acknowledgments", "acknowledgements", "funding", "disclosure",
    "author contributions", "competing interests", "conflict of interest", "data availability",
    "supplementary material", "data sharing", "prior presentation", "affiliations", "corresponding author",
    "footnotes", "editorial", "correspondence to", "supplemental data", "trial registration",
]
BACK_MATTER = ("references", "acknowledgments", "supplementary")
# Words that show an affiliation list, and words that show clinical content.
AFFILIATION_WORDS = ["department of", "university", "hospital", "institute", "school of medicine", "medical center",
                     "e-mail:", "correspondence", "@", "orcid"]
CONTENT_WORDS = ["patient", "treatment", "study", "trial", "survival", "dose", "radiation", "cancer", "tumor", "stage",
                 "outcome", "result", "method"]

# Lowest relevance a document needs, by the source that found it, and trust in the source.
SOURCE_GATES = [("frame", 0.28, 2), ("both", 0.28, 3), ("structured", 0.35, 1), ("vector", 0.50, 0)]
OTHER_GATE = 0.45

# Disease trajectories before and after a first line of treatment.
NAIVE_TRAJECTORIES = ["treatment_naive", "first_line"]
LATER_TRAJECTORIES = ["second_line", "later_line", "refractory"]


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def count_contained(txt: Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, [txt.contains(w).cast("int") for w in words], F.lit(0))


def preference_filter(df: DataFrame, prefs: Mapping[str, object]) -> DataFrame:
    """Every preference present narrows the set; unknown race is kept unless told otherwise."""
    c, conditions = F.col, []
    for key, column in (
        ("study_types", "study_type"), ("study_phases", "study_phase"),
        ("countries", "country"), ("institutions", "study_institution"),
    ):
        if prefs.get(key):
            conditions.append(c(column).isin(list(prefs[key])))
    if prefs.get("min_patients"):
        conditions.append(c("number_of_patients") >= prefs["min_patients"])
    if prefs.get("max_patients"):
        conditions.append(c("number_of_patients") <= prefs["max_patients"])
    year = F.year(c("publish_date").try_cast("date"))
    if prefs.get("min_publication_year"):
        conditions.append(year >= prefs["min_publication_year"])
    if prefs.get("max_publication_year"):
        conditions.append(year <= prefs["max_publication_year"])
    for modality in prefs.get("exclude_treatment_modalities") or []:
        conditions.append(~c("study_type").ilike(f"%{modality}%"))
    if prefs.get("race_ethnicities"):
        words = [w for r in prefs["race_ethnicities"] for w in RACE_WORDS.get(r.lower(), [r.lower()])]
        race = any_of([c("race_ethnicity").ilike(f"%{w}%") for w in words])
        if prefs.get("include_unknown_race", True):
            race = race | c("race_ethnicity").isNull() | (c("race_ethnicity") == "")
        conditions.append(race)
    return df.filter(all_of(conditions))


def valid_doc_ids(df: DataFrame, prefs: Mapping[str, object]) -> DataFrame | None:
    """Distinct ids that pass; None (no filter) when no preference needs the study table."""
    c, conditions = F.col, []
    if prefs.get("min_patients"):
        conditions.append(c("number_of_patients") >= prefs["min_patients"])
    if prefs.get("max_patients"):
        conditions.append(c("number_of_patients") <= prefs["max_patients"])
    for key, column in (("study_phases", "study_phase"), ("study_types", "study_type")):
        if prefs.get(key):
            conditions.append(any_of([c(column).ilike(f"%{v}%") for v in prefs[key]]))
    year = F.year(c("publish_date").try_cast("date"))
    if prefs.get("min_publication_year"):
        conditions.append(year >= prefs["min_publication_year"])
    if prefs.get("max_publication_year"):
        conditions.append(year <= prefs["max_publication_year"])
    if not conditions:
        return None
    return df.filter(c("doc_id").isNotNull() & all_of(conditions)).select("doc_id").distinct()


def keyword_any_filter(df: DataFrame, txt: Column, groups: Sequence[str]) -> DataFrame:
    """Keep rows whose text shows one of the modalities."""
    words = [w for g in groups for w in MODALITY_WORDS.get(g, [g.lower()])]
    return df.filter(any_contains(F.lower(txt), words))


def profile_search(df: DataFrame, axes: Mapping[str, tuple[Sequence[str], Sequence[str]]], limit: int) -> DataFrame:
    """OR over terms and columns inside an axis, AND across axes; no criteria, no rows."""
    wanted = {k: v for k, v in axes.items() if v[1]}
    if not wanted:
        return df.limit(0)
    conditions = [any_of([F.col(c).ilike(f"%{t}%") for c in cols for t in terms]) for cols, terms in wanted.values()]
    return df.filter(all_of(conditions)).orderBy(F.col("publish_date").desc_nulls_last(), F.asc("study_id")).limit(limit)


def exists_filter(df: DataFrame, children: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows that have a child fulfilling the condition."""
    return df.join(children.filter(condition).select(key).distinct(), key, "left_semi")


def hard_filter_with_fallback(df: DataFrame, query: str, hard: Column, soft: Column, boost: float = 0.15) -> DataFrame:
    """Hard matches per query; a query without any keeps all its rows with a soft boost.

    Whether a query has a hard match is a mergeable aggregate joined back, not a window, so a
    query with very many rows stays spread over tasks.
    """
    hard_hit = F.coalesce(hard, F.lit(False))
    marked = df.withColumn("is_hard", hard_hit).withColumn("soft_boost", F.coalesce(soft, F.lit(False)).cast("int") * boost)
    status = marked.groupBy(query).agg(F.max("is_hard").alias("any_hard"))
    return marked.join(status, query).filter(F.col("is_hard") | ~F.col("any_hard"))


def must_not(df: DataFrame, column: str, negated: Sequence[str]) -> DataFrame:
    """Drop rows that carry a negated term; rows without terms stay."""
    return df.filter(~F.arrays_overlap(F.coalesce(column, F.array().cast("array<string>")), F.array(*map(F.lit, negated))))


def skip_section(name: Column, text: Column, head_chars: int | None = None) -> Column:
    """References, back matter and affiliation lists; ``head_chars`` limits the text that is judged."""
    judged = F.substring(text, 1, head_chars) if head_chars else text
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[#*_\-\d.]+", " "), r"\s+", " "))
    start = F.trim(judged)
    numbered = start.rlike(r"^\d+\.\s+[A-Z]") & (F.regexp_count(start, F.lit(r"\n\s*\d+\.\s+")) >= 3)
    affiliations = let(
        F.lower(judged),
        lambda head: (count_contained(head, AFFILIATION_WORDS) >= 3) & (count_contained(head, CONTENT_WORDS) <= 1),
    )
    backmatter = "|".join(p for p, kind in SECTION_PATTERNS if kind in BACK_MATTER)
    by_type = F.when(F.lower(name).rlike(backmatter), section_type(name).isin(*BACK_MATTER)).otherwise(False)
    return any_contains(clean, SKIPPED_SECTIONS) | by_type | numbered | affiliations


def governance_filter(cands: DataFrame, sources: DataFrame, audience: str, intent: str | None) -> DataFrame:
    """Drop documents of inactive, non-public or off-intent sources; unregistered ones pass."""
    c = F.col
    blocked = ~c("is_active")
    if audience == "patient":
        blocked = blocked | ~c("patient_facing")
    if intent:
        blocked = blocked | (c("intents").isNotNull() & ~F.array_contains(F.split("intents", ","), intent))
    return cands.join(sources, "source_key", "left").filter(~F.coalesce(blocked, F.lit(False))).select(*cands.columns)


def strip_hash_suffix(doc_id: Column) -> Column:
    """Id without its trailing hash, for matching ids across stores."""
    return F.regexp_replace(doc_id, r"_[a-f0-9]{6,}$", "")


def loose_equal(a: Column, b: Column) -> Column:
    """Empty equals empty, then case-insensitive comparison of the trimmed text."""
    left, right = (F.coalesce(F.lower(F.trim(x)), F.lit("")) for x in (a, b))
    return left == right


def loose_equal_arrays(a: Column, b: Column) -> Column:
    """Empty lists are equal; otherwise any common element."""
    empty_a, empty_b = (F.coalesce(F.size(x), F.lit(0)) < 1 for x in (a, b))
    return F.when(empty_a & empty_b, True).when(empty_a | empty_b, False).otherwise(F.coalesce(F.arrays_overlap(a, b), F.lit(False)))


def conflict_filter(df: DataFrame, query: str, wanted: str, found: str, floor: int = 2) -> DataFrame:
    """Drop rows whose known type differs from the query's; keep all when fewer than ``floor`` would stay."""
    keep = F.col(wanted).isNull() | F.col(found).isNull() | (F.col(found) == F.col(wanted))
    marked = df.withColumn("keep", keep)
    stats = marked.groupBy(query).agg(F.count_if("keep").alias("kept"), F.count(F.lit(1)).alias("total"))
    safe = (F.col("kept") < floor) & (F.col("total") >= floor)
    return marked.join(stats, query).filter(F.col("keep") | safe).drop("keep", "kept", "total")


def filter_impact(df: DataFrame, condition: Column) -> DataFrame:
    """Matching against total rows."""
    return df.agg(F.count_if(condition).alias("matching"), F.count(F.lit(1)).alias("total"))


def ci_list_filter(column: Column, wanted: Sequence[str] | None) -> Column:
    """Exact but case-insensitive; no list passes everything, a missing value fails."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.lower(F.trim(column)).isin([w.strip().lower() for w in wanted]), F.lit(False))


def source_gate(found: DataFrame) -> DataFrame:
    """A document found by several sources counts for the most trusted one, whose threshold applies."""
    trust = F.lit(-1)
    gate = F.lit(OTHER_GATE)
    for name, threshold, rank in SOURCE_GATES:
        trust = F.when(F.col("lane") == name, F.lit(rank)).otherwise(trust)
        gate = F.when(F.col("lane") == name, F.lit(threshold)).otherwise(gate)
    best = found.groupBy("query_id", "doc_id").agg(
        F.max_by("lane", F.struct(trust, F.col("lane"))).alias("lane"), F.max("score").alias("score")
    )
    return best.withColumn("threshold", gate).filter(F.col("score") >= F.col("threshold"))


def trajectory_conflict(a: Column, b: Column) -> Column:
    """One side untreated, the other beyond first line; unknown sides never conflict."""
    left, right = F.lower(F.trim(a)), F.lower(F.trim(b))
    clash = (left.isin(NAIVE_TRAJECTORIES) & right.isin(LATER_TRAJECTORIES)) | (
        left.isin(LATER_TRAJECTORIES) & right.isin(NAIVE_TRAJECTORIES)
    )
    return F.coalesce(clash, F.lit(False))
