"""Grouped statistics, histograms, facets and pooled estimates (D1-D9, D29, G)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.parse import exact_avg, exact_sum, extract_percentage_or_proportion, metric_label, metric_unit, round_half_up

METRICS = frozenset(
    "os_rate_percent os_median_months pfs_rate_percent pfs_median_months dfs_rate_percent dfs_median_months "
    "lc_rate_percent median_followup_months number_of_patients median_age_numeric".split()
)
GROUPS = frozenset("normalized_phase cancer_type study_type_normalized is_randomized is_multi_center country".split())

_AGGREGATES = {
    "avg": exact_avg,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "min": F.min,
    "max": F.max,
    "sum": exact_sum,
}


def kpi_overview(summary: DataFrame, radiation: DataFrame) -> DataFrame:
    """Long form (section, label, value) of the landing figures; each table is read once."""
    head = summary.agg(
        F.count(F.lit(1)).cast("double").alias("total_studies"),
        F.count_distinct("cancer_type").cast("double").alias("cancer_types"),
        round_half_up(exact_avg(F.col("os_rate_percent")), 1).alias("avg_os"),
        round_half_up(exact_avg(F.col("pfs_rate_percent")), 1).alias("avg_pfs"),
        round_half_up(exact_avg(F.col("median_followup_months")), 1).alias("avg_followup"),
        round_half_up(exact_avg(F.col("number_of_patients")), 0).alias("avg_n"),
    )
    rad = radiation.filter(F.col("best_dose_gy").isNotNull()).agg(
        F.count(F.lit(1)).cast("double").alias("total_rad_records"),
        F.count_distinct("normalized_technique").cast("double").alias("unique_techniques"),
        round_half_up(exact_avg(F.col("best_dose_gy")), 1).alias("avg_dose"),
    )
    phases = (
        summary.filter(F.col("normalized_phase").isNotNull())
        .groupBy(F.col("normalized_phase").alias("label"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.lit("phase").alias("section"), "label", "value")
    )

    def long_form(df: DataFrame, section: str) -> DataFrame:
        return df.unpivot([], df.columns, "label", "value").select(F.lit(section).alias("section"), "label", "value")

    return long_form(head, "studies").unionByName(long_form(rad, "radiation")).unionByName(phases)


def aggregate_metric(
    df: DataFrame,
    metric: str,
    group_by: str,
    agg: str = "avg",
    filters: Mapping[str, object] | None = None,
    *,
    limit: int,
    min_support: int = 2,
    metrics: frozenset[str] = METRICS,
    groups: frozenset[str] = GROUPS,
) -> DataFrame:
    """One figure per group; NULLs dropped on both sides, thin groups dropped, best groups first."""
    if metric not in metrics:
        raise ValueError(f"metric must be one of {sorted(metrics)}")
    if group_by not in groups:
        raise ValueError(f"group_by must be one of {sorted(groups)}")
    if agg not in _AGGREGATES:
        raise ValueError(f"agg must be one of {sorted(_AGGREGATES)}")
    kept = df.filter(F.col(metric).isNotNull() & F.col(group_by).isNotNull())
    for name, value in (filters or {}).items():
        if name in groups:
            kept = kept.filter(F.col(name) == F.lit(value))
    return (
        kept.groupBy(F.col(group_by).cast("string").alias("grp"))
        .agg(round_half_up(_AGGREGATES[agg](F.col(metric)), 2).alias("val"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_support)
        .orderBy(F.col("val").desc(), F.col("grp"))
        .limit(limit)
    )


def histogram(df: DataFrame, column: str, width: float = 5.0, unit: str = "Gy") -> DataFrame:
    """D3: counts per bin over positive values, labelled "lo-hi unit"."""
    start = (F.floor(F.col(column) / width) * width).cast("double")
    text = lambda c: F.round(c, 0).cast("bigint").cast("string")
    return (
        df.filter(F.col(column) > 0)
        .groupBy(start.alias("bin_start"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "label",
            F.concat(text(F.col("bin_start")), F.lit("-"), text(F.col("bin_start") + width), F.lit(f" {unit}")),
        )
    )


def top_frequency(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Most frequent values; ties by value so that the cut is stable."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("value"))
        .limit(limit)
    )


def outcomes_by_group(children: DataFrame, summary: DataFrame, metric: str, group: str = "stage_category") -> DataFrame:
    """Average of a study metric per child category, with at least two distinct studies.

    Children are counted per (group, study) before the join, so a hot category meets each
    study once and the join carries no repeated rows.
    """
    per_study = children.filter(F.col(group).isNotNull()).groupBy(group, "study_id").agg(F.count(F.lit(1)).alias("rows"))
    facts = summary.filter(F.col(metric).isNotNull()).select("study_id", metric)
    weighted = F.sum((F.col(metric) * F.col("rows")).cast("decimal(28,6)")).cast("double") / F.sum("rows")
    return (
        per_study.join(facts, "study_id")
        .groupBy(F.col(group).alias("grp"))
        .agg(round_half_up(weighted, 1).alias("avg_val"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= 2)
    )


def facet_values(df: DataFrame, column: str, min_support: int = 1) -> DataFrame:
    """Distinct values with minimum support."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_support)
    )


def facet_counts(df: DataFrame, column: str, search: str | None, limit: int) -> DataFrame:
    """Non-empty values that hold the search text, most frequent first, then by value."""
    kept = df.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    if search:
        kept = kept.filter(F.col(column).ilike(f"%{search}%"))
    return (
        kept.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("value"))
        .limit(limit)
    )


def meta_fixed_effect(df: DataFrame, group: str, hr: str = "hr", lo: str = "ci_low", hi: str = "ci_high") -> DataFrame:
    """Inverse-variance pooling of log hazard ratios per group; one mergeable aggregate."""
    ln_hr = F.ln(F.col(hr))
    se = (F.ln(F.col(hi)) - F.ln(F.col(lo))) / 3.92
    rows = (
        df.filter((F.col(hr) > 0) & (F.col(lo) > 0) & (F.col(hi) > 0))
        .select(group, ln_hr.alias("ln_hr"), se.alias("se"))
        .filter(F.col("se") > 0)
        .withColumn("w", 1.0 / (F.col("se") * F.col("se")))
    )
    pooled = rows.groupBy(group).agg(
        F.sum("w").alias("sum_w"), (F.sum(F.col("w") * F.col("ln_hr")) / F.sum("w")).alias("ln"), F.count(F.lit(1)).alias("n")
    )
    pooled_se = 1.0 / F.sqrt("sum_w")
    return pooled.select(
        group,
        round_half_up(F.exp("ln"), 3).alias("hr"),
        round_half_up(F.exp(F.col("ln") - 1.96 * pooled_se), 3).alias("ci_low"),
        round_half_up(F.exp(F.col("ln") + 1.96 * pooled_se), 3).alias("ci_high"),
        round_half_up(F.col("sum_w"), 2).alias("weight"),
        F.col("n").alias("n_studies"),
    )


def rate_forest(summary: DataFrame, outcome: str, limit: int) -> DataFrame:
    """The studies with the highest rate and the plain mean over the rates shown."""
    rate, median = F.col(f"{outcome}_rate_percent"), F.col(f"{outcome}_median_months")
    shown = (
        summary.filter(rate.isNotNull() | median.isNotNull())
        .select(
            "study_id",
            F.coalesce("study_name", "document_name", F.lit("Unknown")).alias("label"),
            rate.alias("rate"),
            median.alias("median_months"),
            F.coalesce("number_of_patients", F.lit(0)).alias("n"),
            F.col("normalized_phase").alias("phase"),
            F.coalesce(f"{outcome}_raw", F.lit("")).alias("raw"),
        )
        .orderBy(F.col("rate").desc_nulls_last(), F.asc("study_id"))
        .limit(limit)
    )
    everything = Window.partitionBy()  # over at most ``limit`` rows
    return shown.withColumn("pooled_rate", round_half_up(F.avg("rate").over(everything), 1))


def comparison_pivot(df: DataFrame, row: str, category: str, text: str, categories: Sequence[str]) -> DataFrame:
    """Rows x fixed categories with the highest percentage parsed from the text."""
    return (
        df.select(row, category, extract_percentage_or_proportion(F.col(text)).alias("pct"))
        .groupBy(row)
        .pivot(category, list(categories))
        .agg(F.max("pct"))
    )


def top_k_nulls_last(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """G1: global top-k; planned as TakeOrderedAndProject, never a full sort."""
    return df.orderBy(*order).limit(limit)


def priority_order(column: str, ranked: Sequence[str]) -> Column:
    """Rank of a value in a list of priorities, everything else after it."""
    rank = F.lit(len(ranked))
    for position, value in reversed(list(enumerate(ranked))):
        rank = F.when(F.col(column) == value, F.lit(position)).otherwise(rank)
    return rank


def page(df: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """One page of an ordered list."""
    return df.orderBy(*order).offset(offset).limit(size)


def with_labels(df: DataFrame, metric: str) -> DataFrame:
    """A frame of metric names with their titles and units."""
    known = lambda name: F.create_map(*[F.lit(v) for m in sorted(METRICS) for v in (m, name(m))])
    return df.withColumns({"label": F.try_element_at(known(metric_label), F.col(metric)), "unit": F.try_element_at(known(metric_unit), F.col(metric))})
