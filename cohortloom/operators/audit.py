"""Coverage, consistency and metric reports over stores and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict_census(df: DataFrame, key: str, axes: Sequence[str]) -> DataFrame:
    """Per criterion how often it was judged and how; criteria that never reject are flagged."""
    long = df.select(key, *axes).unpivot([key], list(axes), "criterion", "verdict")
    counts = long.groupBy("criterion").agg(
        F.count_if(F.col("verdict").isNotNull() & (F.col("verdict") != "NA")).alias("evaluated"),
        *[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("MATCH", "matches"), ("MISMATCH", "mismatches"), ("NA", "not_available"))],
    )
    return counts.withColumn("never_rejects", (F.col("evaluated") > 0) & (F.col("mismatches") == 0))


def metric_rollup(events: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """Counters by call, lane and event."""
    return events.groupBy(*keys).agg(F.sum(amount).alias("total"))


def lane_counts(found: DataFrame) -> DataFrame:
    """Documents per combination of lanes that found them."""
    docs = found.groupBy("query_id", "doc_id").agg(F.bool_or(F.col("lane") == "frame").alias("frame"), F.bool_or(F.col("lane") == "structured").alias("structured"))
    lane = F.when(F.col("frame") & F.col("structured"), "both").when(F.col("frame"), "frame").when(F.col("structured"), "structured").otherwise("vector")
    return docs.groupBy(lane.alias("lane")).agg(F.count(F.lit(1)).alias("docs"))


def store_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per field how the values of two stores compare, keys of either side included."""
    a = left.select(*keys, F.col("value").alias("a"))
    b = right.select(*keys, F.col("value").alias("b"))
    joined = a.join(b, list(keys), "full_outer")
    state = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), "both_null").when(F.col("a").isNull(), "left_null").when(F.col("b").isNull(), "right_null")
        .when(F.lower(F.trim("a")) == F.lower(F.trim("b")), "match").otherwise("mismatch")
    )
    return joined.groupBy(keys[-1], state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def retrieval_profile(found: DataFrame, method: str, doc: str, section: str) -> DataFrame:
    """Per method chunks, documents, and chunks and distinct sections per document."""
    per_section = found.groupBy(method, doc, section).agg(F.count(F.lit(1)).alias("n"))
    per_doc = per_section.groupBy(method, doc).agg(F.sum("n").alias("n"), F.count_if(F.coalesce(F.col(section), F.lit("")) != "").alias("sections"))
    return per_doc.groupBy(method).agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("docs"), F.round(F.sum("n") / F.count(F.lit(1)), 4).alias("chunks_per_doc"),
        F.round(F.sum("sections") / F.count(F.lit(1)), 4).alias("sections_per_doc"),
    )


def term_coverage(ranked: DataFrame, terms: Sequence[str], text: str) -> DataFrame:
    """Per query the share of key terms in its pooled texts, and whether the first three hold one."""
    low = F.lower(text)
    found = [F.bool_or(low.contains(t)).cast("int").alias(f"_t{i}") for i, t in enumerate(terms)]
    any_term = F.lit(False)
    for t in terms:
        any_term = any_term | low.contains(t)
    per_query = ranked.groupBy("query_id").agg(*found, F.bool_or((F.col("pos") <= 3) & any_term).alias("top3_hit"))
    total = sum((F.col(f"_t{i}") for i in range(len(terms))), F.lit(0))
    return per_query.select("query_id", (total / len(terms)).alias("coverage"), "top3_hit")


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How many rows fill each field."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f) for f in fields])
    return counts.unpivot(["_rows"], list(fields), "field", "filled").select("field", "filled", F.col("_rows").alias("rows"))
