"""Normalised summary tables over free-text study records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import parse, rules


# Parts that the rows of one value are dealt to.
VALUE_PARTS = 64


def by_distinct_value(df: DataFrame, key: str, raw: str, rule: Callable[[Column], Column], out: str) -> DataFrame:
    """``df`` with ``out`` = rule(raw), worked out once for each different raw value and part of its rows, and joined back.

    Rule tables try over a hundred spellings on a text; free-text fields repeat the same few values. Rows of a value, or
    of none, are dealt to VALUE_PARTS parts by ``key``, so that no task reads all rows of a value.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(VALUE_PARTS)))
    values = dealt.select(F.col(raw).alias("_raw"), F.col("_part").alias("_of")).where(F.col("_raw").isNotNull()).distinct()
    table = values.select("_raw", "_of", rule(F.col("_raw")).alias(out))
    return dealt.join(table, (dealt[raw] == table["_raw"]) & (dealt["_part"] == table["_of"]), "left").drop("_raw", "_of", "_part")


def build_study_summary(studies: DataFrame) -> DataFrame:
    """B1: one row per study with normalised type and phase, flags and parsed outcomes."""
    c = F.col
    named = by_distinct_value(studies, "study_id", "cancer_type", rules.normalize_category, "_category")
    return named.select(
        "study_id", "document_name", "study_name", "doi", "pmid",
        c("_category").alias("cancer_type"),
        c("cancer_type").alias("cancer_type_raw"),
        rules.normalize_phase(c("study_phase")).alias("normalized_phase"),
        c("study_phase").alias("phase_raw"),
        c("study_type").alias("study_type_normalized"),
        "number_of_patients", "study_institution", "country",
        F.coalesce(c("study_type").ilike("%random%"), F.lit(False)).alias("is_randomized"),
        (F.coalesce(c("study_institution").ilike("%multi%"), F.lit(False))
         | F.coalesce(c("country").contains(","), F.lit(False))).alias("is_multi_center"),
        parse.first_number(c("median_age"), r"(\d+\.?\d*)").alias("median_age_numeric"),
        parse.extract_percent(c("overall_survival")).alias("os_rate_percent"),
        parse.extract_months(c("overall_survival")).alias("os_median_months"),
        parse.extract_percent(c("progression_free_survival")).alias("pfs_rate_percent"),
        parse.extract_months(c("progression_free_survival")).alias("pfs_median_months"),
        parse.extract_percent(c("disease_free_survival")).alias("dfs_rate_percent"),
        parse.extract_months(c("disease_free_survival")).alias("dfs_median_months"),
        parse.extract_percent(c("local_control")).alias("lc_rate_percent"),
        parse.extract_months(c("median_followup")).alias("median_followup_months"),
        c("overall_survival").alias("os_raw"),
        c("progression_free_survival").alias("pfs_raw"),
        c("local_control").alias("lc_raw"),
        c("median_followup").alias("followup_raw"),
    )


def build_radiation_summary(details: DataFrame, studies: DataFrame) -> DataFrame:
    """B2: treatment details joined to their study; best dose is the first source that parses."""
    c = F.col
    heads = by_distinct_value(studies, "study_id", "cancer_type", rules.normalize_category, "_category").select(
        "study_id", "document_name", "number_of_patients",
        c("_category").alias("cancer_type"),
        rules.normalize_phase(c("study_phase")).alias("normalized_phase"),
    )
    direct = parse.extract_gy(c("total_dose"))
    from_json = parse.extract_gy(parse.json_text(c("additional_details"), "$.total_dose"))
    csi = parse.extract_gy(parse.json_text(c("additional_details"), "$.CSI_dose"))
    parsed = by_distinct_value(details, "detail_id", "technique", rules.normalize_technique, "_technique").select(
        "detail_id", "study_id", c("technique").alias("technique_raw"),
        c("_technique").alias("normalized_technique"),
        direct.alias("total_dose_gy"),
        parse.extract_gy(c("fractionation")).alias("fraction_dose_gy"),
        F.coalesce(parse.extract_fractions(c("fractionation")), parse.extract_fractions(c("total_dose")))
        .alias("fractions_from_text"),
        from_json.alias("dose_from_json"),
        csi.alias("csi_dose_gy"),
        parse.extract_gy(parse.json_text(c("additional_details"), "$.boost_dose")).alias("boost_dose_gy"),
        F.coalesce(direct, from_json, csi, parse.extract_gy(c("evidence_quote"))).alias("best_dose_gy"),
        "target_volume",
    )
    return parsed.join(heads, "study_id")
