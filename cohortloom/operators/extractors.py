"""Clinical statements of a text as maps and arrays, and full frames per document.

All patterns are read where the text lies; only what they find is grouped. A frame merges its chunks' findings by
chunk order without gathering any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.tagging import let, signal_confidence, stage_extract, tnm_extract
from cohortloom.session import shuffled

# Outcome statements in the order they are read, with the key and value that a match writes; {1} and {2} are its groups.
OUTCOME_PATTERNS: list[tuple[str, str, str]] = [
    (r"(?i)(\d+)[\s-]*(?:year|yr|mo(?:nth)?)\s*(?:OS|overall\s+survival)[:\s]*(\d+(?:\.\d+)?)\s*%", "{1}yr_OS", "{2}%"),
    (r"(?i)(?:OS|overall\s+survival)[:\s]*(\d+(?:\.\d+)?)\s*%", "OS", "{1}%"),
    (r"(?i)median\s+(?:OS|overall\s+survival)[:\s]*(\d+(?:\.\d+)?)\s*(?:months?|mo|years?|yr)", "median_OS", "{1} mo"),
    (r"(?i)(\d+)[\s-]*(?:year|yr)\s*(?:PFS|progression[- ]free)[:\s]*(\d+(?:\.\d+)?)\s*%", "{1}yr_PFS", "{2}%"),
    (r"(?i)median\s+(?:PFS|progression[- ]free)[:\s]*(\d+(?:\.\d+)?)\s*(?:months?|mo)", "median_PFS", "{1} mo"),
    (r"(?i)(\d+)[\s-]*(?:year|yr)\s*(?:local|locoregional)\s*control[:\s]*(\d+(?:\.\d+)?)\s*%", "{1}yr_LC", "{2}%"),
    (r"(?i)(?:local|locoregional)\s*control[:\s]*(\d+(?:\.\d+)?)\s*%", "LC", "{1}%"),
    (r"(?i)(\d+)[\s-]*(?:year|yr)\s*(?:DFS|disease[- ]free)[:\s]*(\d+(?:\.\d+)?)\s*%", "{1}yr_DFS", "{2}%"),
    (r"(?i)HR\s*[=:]\s*(\d+\.\d+)(?:\s*[,;]\s*(?:95%?\s*CI|p)[:\s=]*[\d\.\-\s]+)?", "HR", "{1}"),
    (r"(?i)(\d+(?:\.\d+)?)\s*%\s*(?:recurrence|relapse)", "recurrence_rate", "{1}%"),
    (r"(?i)(?:pCR|pathologic(?:al)?\s+complete\s+response)[:\s]*(\d+(?:\.\d+)?)\s*%", "pCR", "{1}%"),
]
# Dose statements in the order they are tried, and what the first match says.
DOSE_PATTERNS: list[tuple[str, str]] = [
    (r"(?i)(\d+(?:\.\d+)?)\s*Gy\s*(?:in\s*)?(\d+)\s*(?:fx|fractions?)", "{1} Gy in {2} fx"),
    (r"(?i)(\d+(?:\.\d+)?)\s*Gy(?!\s*in|\s*/)", "{1} Gy"),
    (r"(?i)(\d+(?:\.\d+)?)\s*Gy\s*BID", "{1} Gy BID"),
]
# Marker statements.
BIOMARKER_PATTERNS = [
    r"(?i)\b(?:ER|estrogen\s+receptor)\s*[+\-](?!\w)", r"(?i)\b(?:PR|progesterone\s+receptor)\s*[+\-](?!\w)", r"(?i)\bHER2\s*[+\-/]", r"(?i)\btriple\s*negative\b",
    r"(?i)\b(?:EGFR|ALK|ROS1|KRAS|BRAF|PD-?L1)\s*(?:mutation|positive|negative|[+\-]|\d+%)", r"(?i)\b(?:HPV|p16)\s*(?:positive|negative|[+\-])",
    r"(?i)\b(?:MSI|microsatellite)[- ]?(?:high|low|stable|H|L|S)\b",
]
# Treatments and agents, found as parts of the text in any case.
MODALITIES = ["radiotherapy", "radiation therapy", "RT", "IMRT", "SBRT", "SRS", "chemotherapy", "chemoradiation", "chemoRT", "concurrent chemo", "surgery", "resection",
              "mastectomy", "lumpectomy", "orchiectomy", "immunotherapy", "checkpoint inhibitor", "targeted therapy", "hormone therapy", "endocrine therapy",
              "brachytherapy", "proton therapy"]
AGENTS = ["cisplatin", "carboplatin", "paclitaxel", "docetaxel", "trastuzumab", "pertuzumab", "pembrolizumab", "nivolumab", "cetuximab", "bevacizumab", "osimertinib",
          "tamoxifen", "anastrozole", "letrozole", "vincristine", "doxorubicin", "cyclophosphamide", "5-FU", "fluorouracil", "capecitabine", "gemcitabine",
          "FOLFOX", "FOLFIRI", "TCHP", "AC-T"]


def _filled(template: str, raw: Column, pattern: str) -> Column:
    """The template with the groups of one statement, read from the statement alone."""
    parts, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        number, rest = tail.split("}", 1)
        parts += [F.lit(head), F.regexp_extract(raw, pattern, int(number))]
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(template)


def outcome_entries(text: Column) -> Column:
    """Array of (key, value) of all outcome statements; a later entry of a key replaces an earlier one."""

    def read(pattern: str, key: str, value: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda raw: F.struct(_filled(key, raw, pattern).alias("key"), _filled(value, raw, pattern).alias("value")))

    return F.concat(*[read(*p) for p in OUTCOME_PATTERNS])


def outcome_map(text: Column) -> Column:
    """The outcomes of a text by key, the last statement of a key kept."""

    def kept(entries: Column) -> Column:
        return let(F.transform(entries, lambda e: e["key"]), lambda keys: F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))

    return F.map_from_entries(F.array_sort(let(F.reverse(outcome_entries(text)), kept)))


def dose(text: Column) -> Column:
    """The first dose statement of the first pattern that matches."""
    return F.coalesce(*[F.when(text.rlike(p), _filled(said, text, p)) for p, said in DOSE_PATTERNS])


def biomarkers(text: Column) -> Column:
    """Sorted distinct marker statements as written."""
    return F.array_sort(F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in BIOMARKER_PATTERNS]), lambda x: F.trim(x))))


def named(text: Column, names: list[str]) -> Column:
    """The names of a list that a text holds, sorted."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n.lower()).alias("low")) for n in names])
    return F.array_sort(let(F.lower(text), lambda low: F.transform(F.filter(pairs, lambda p: low.contains(p["low"])), lambda p: p["name"])))


def frame_profile(chunks: DataFrame, doc: str, chunk: str, order: str, text: str) -> DataFrame:
    """A frame per document: first stage, TNM and dose, outcomes (the last chunk's statement of a key), markers,
    treatments, agents, evidence chunks and confidence. Documents without any signal are dropped.

    Chunks with a signal give rows of (document, kind, key, value); they are combined per key before a document is put together.
    A pattern is read once for the first statements and once for the lists.
    """
    t = F.col(text)
    tnm = F.array_join(tnm_extract(t), "")
    read = chunks.select(
        doc, F.col(chunk).alias("_chunk"), F.col(order).alias("_order"), F.get(stage_extract(t), F.lit(0)).alias("stage"), F.nullif(tnm, F.lit("")).alias("tnm"),
        dose(t).alias("dose"), outcome_entries(t).alias("outcomes"), biomarkers(t).alias("markers"), named(t, MODALITIES).alias("modalities"), named(t, AGENTS).alias("agents"),
    )
    profile, outcome = F.col("stage").isNotNull() | F.col("tnm").isNotNull(), F.size("outcomes") > 0
    treatment = F.col("dose").isNotNull() | (F.size("agents") > 0)
    held = read.withColumns({"_p": profile, "_t": treatment, "_o": outcome}).filter(F.col("_p") | F.col("_t") | F.col("_o"))
    item = lambda kind, key, value, at: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), at.alias("at"))
    listed = lambda c: F.transform(c, lambda v: item(c, v, v, F.lit(0)))
    lists = [listed(c) for c in ("markers", "modalities", "agents")]
    said = F.concat(F.transform("outcomes", lambda e, i: item("outcomes", e["key"], e["value"], i)), *lists)
    items = held.select(doc, "_order", F.explode(said).alias("i")).groupBy(doc, "i.kind", "i.key").agg(F.max_by("i.value", F.struct("_order", "i.at")).alias("value"))
    of = lambda kind, v: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, v)))
    sets = items.groupBy(doc).agg(F.map_from_entries(of("outcomes", F.struct("key", "value"))).alias("outcomes"), *[of(c, F.col("value")).alias(c) for c in ("markers", "modalities", "agents")])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c)
    heads = held.groupBy(doc).agg(
        first("stage"), first("tnm"), first("dose"), F.count_if("_p").alias("profile_n"), F.count_if("_t").alias("treatment_n"), F.count_if("_o").alias("outcome_n"),
        F.array_sort(F.collect_set("_chunk")).alias("evidence_ids"),
    )
    heads = heads.join(shuffled(sets), doc, "left")
    none = F.array().cast("array<string>")
    return heads.select(
        doc, "stage", "tnm", "dose", F.coalesce("outcomes", F.expr("cast(map() as map<string,string>)")).alias("outcomes"),
        *[F.coalesce(c, none).alias(c) for c in ("markers", "modalities", "agents")], "evidence_ids",
        signal_confidence(F.col("profile_n"), F.col("treatment_n"), F.col("outcome_n")).alias("confidence"),
    )
