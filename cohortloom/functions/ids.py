"""Stable ids, slugs, DOIs and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

# Query parameters that only track the visitor.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid",
                   "mc_eid", "intcmp"]

# Page topics, first match wins.
BUCKET_PATTERNS: list[tuple[str, str]] = [
    ("cancer_type", r"/cancer-types?(?:/|$)|/types(?:/|$)|/cancer/types|breast-cancer|lung-cancer|colorectal|prostate"
                    r"|melanoma|leukemia|lymphoma|myeloma"),
    ("diagnosis_testing", r"diagnos|staging|stages-|biomarker|tumou?r-marker|tests?-and-procedures|biopsy|pathology"
                          r"|genetic-testing"),
    ("treatment", r"/treatment|how-cancer-treated|chemotherapy|radiation|immunotherapy|targeted-therap|surgery"
                  r"|hormone-therap|stem-cell|car-t|clinical-trial"),
    ("side_effects", r"side-effect|fatigue|nausea|vomit|diarrhea|constipation|neuropathy|mucositis|mouth-sore|pain"
                     r"|hair-loss|lymphedema|infection|neutropenia"),
    ("nutrition_lifestyle", r"nutrition|diet|eating|appetite|taste|food|physical-activity|exercise|sleep|sexual"
                            r"|fertility|wellness|healthy-living"),
    ("supportive_care", r"supportive-care|palliative|coping-with-cancer|mental-health|anxiety|depression|distress"
                        r"|counsel|support-group|social-support|patient-navigation"),
    ("financial_practical", r"financial|cost|insurance|employment|transport|lodging|legal|practical"),
    ("caregiver", r"caregiver|family-and-friends|caring-for"),
    ("survivorship", r"survivorship|after-treatment|life-after-cancer|recurrence|follow-up-care"),
    ("prevention_screening", r"screening|early-detection|prevention|reduce.*risk"),
]
WEIGHTED_BUCKETS = ["treatment", "side_effects", "nutrition_lifestyle", "supportive_care"]


def content_hash(text: Column) -> Column:
    """SHA-256 of the text, empty for NULL."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stable_id(*parts: Column | str) -> Column:
    """Name-based UUID (version 5) of the SHA-256 of the joined parts."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.sha2(F.concat_ws("|", *cols), 256)
    raw = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(digest, "UTF-8")))
    variant = F.translate(F.substring(raw, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-5"), F.substring(raw, 14, 3), F.lit("-"),
        variant, F.substring(raw, 18, 3), F.lit("-"), F.substring(raw, 21, 12),
    )


def normalize_doc_id(raw: Column) -> Column:
    """Safe name of at most 50 characters plus a hash of the raw name."""
    name = F.coalesce(F.nullif(raw, F.lit("")), F.lit("unknown"))
    clean = F.regexp_replace(F.regexp_replace(F.trim(name), r"[^\w\-.]", "_"), r"_+", "_")
    clean = F.substring(F.regexp_replace(clean, r"^_+|_+$", ""), 1, 50)
    return F.concat(clean, F.lit("_"), F.substring(F.md5(name), 1, 8))


def section_key(section: Column) -> Column:
    """Short slug of a section plus a hash of its lower-cased name."""
    low = F.lower(F.trim(F.coalesce(F.nullif(section, F.lit("")), F.lit("NO_SECTION"))))
    slug = F.substring(F.regexp_replace(F.regexp_replace(low, r"\s+", "_"), r"[^a-z0-9_]+", ""), 1, 60)
    return F.concat(F.coalesce(F.nullif(slug, F.lit("")), F.lit("no_section")), F.lit("-"), F.substring(F.md5(low), 1, 8))


def normalize_doi(doi: Column) -> Column:
    """registrant/suffix form of a DOI written with an underscore or no separator."""
    d = F.trim(doi)
    return (
        F.when(d.rlike(r"^10\.\d{4,}/"), d)
        .when(d.rlike(r"^10\.\d{4,}_."), F.regexp_replace(d, r"^(10\.\d{4,})_", "$1/"))
        .when(d.rlike(r"^10\.\d{4,}[a-zA-Z]."), F.regexp_replace(d, r"^(10\.\d{4,})([a-zA-Z])", "$1/$2"))
        .otherwise(d)
    )


def doi_from_filename(name: Column) -> Column:
    """DOI in a file name; three spellings, the first that hits."""
    stem = F.regexp_replace(name, r"\.[A-Za-z]+$", "")
    patterns = (
        r"(?i)(10\.\d{4,}/[^\s]+)",
        r"(?i)(10\.\d{4,}_[a-zA-Z][^\s_-]*(?:\.[^\s_-]+)*)",
        r"(?i)(?:DOI|doi)[_\s]*(10\.\d{4,}[a-zA-Z]?[^\s_-]*)",
    )
    return normalize_doi(F.coalesce(*[F.nullif(F.regexp_extract(stem, p, 1), F.lit("")) for p in patterns]))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, single slashes, no trailing slash, fragment or tracking parameters."""
    scheme = F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1), F.lit("")), F.lit("https")))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/{2,}", "/")
    path = F.when(path == "", "/").when((path != "/") & path.endswith("/"), F.regexp_replace(path, r"/$", "")).otherwise(path)
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    kept = F.filter(query, lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING_PARAMS))
    tail = F.array_join(kept, "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def url_bucket(url: Column) -> Column:
    """I16: topic of a page by its address."""
    low = F.lower(url)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(name)) for name, p in BUCKET_PATTERNS], F.lit("general"))


def url_importance(url: Column, bucket: Column, is_seed: Column) -> Column:
    """I16: additive importance from seed, topic, path depth and file type."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return (
        F.when(is_seed, 5.0).otherwise(0.0)
        + F.when(bucket != "general", 3.0).otherwise(0.0)
        + F.when(bucket.isin(WEIGHTED_BUCKETS), 1.0).otherwise(0.0)
        + F.when(depth.between(2, 6), 1.0).otherwise(0.0)
        + F.when(F.lower(url).endswith(".pdf"), 0.25).otherwise(0.0)
    )
