"""The operators' queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import centroids, contamination, fill_middle, html_text, jaccard, language, lattice, lines, personal, quality_rules, secret_scan, substrings, urls
from cohortloom.llm.base import table
from cohortloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_report(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rules_frame(spark, urls.SITE_RULES + urls.PATTERN_RULES)
    return urls.url_filter(table(spark, sf_dir, "pages"), rules)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.sampled_report(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_report(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_html_extraction, op2_jaccard_join, op3_benchmark_decontamination, op4_line_dedup, op5_substring_dedup, op6_url_filters, op7_language_id, op8_secret_scans, op9_quality_rules, op10_sentencepiece,
    op11_centroid_clustering, op12_personal_data, op13_fill_in_middle,
)}
