"""Joins with the tie, NULL and fan-out rules of the study tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sorted distinct non-null values per key.

    Duplicates are removed by a spread-out (key, value) aggregation first, so only distinct
    values reach the task that holds a hot key.
    """
    return (
        df.filter(F.col(value).isNotNull())
        .select(key, value)
        .distinct()
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(value)).alias(name))
    )


def collapse_children(parents: DataFrame, key: str, children: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Parents with one sorted distinct array per child table, empty where there is none."""
    out = parents
    for child, value, name in children:
        out = out.join(distinct_values(child, key, value, name), key, "left").withColumn(
            name, F.coalesce(F.col(name), F.array().cast("array<string>"))
        )
    return out


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many ids both sides, only the left or only the right know."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    side = (
        F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left_only").otherwise("right_only")
    )
    return a.join(b, key, "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def first_per_key(df: DataFrame, key: str, order: Column, columns: Sequence[str]) -> DataFrame:
    """One row per non-null key, the one with the least order value; mergeable, so skew-safe."""
    packed = F.struct(*[F.col(c) for c in columns])
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(packed, order).alias("_b"))
    return best.select(key, *[F.col("_b")[c].alias(c) for c in columns])


# Parts that rows without a key are dealt to.
KEY_PARTS = 1024


def enrich_by_priority(df: DataFrame, facts: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Attach facts by the first key that matches; one equi join per key, no OR join.

    Rows without a key match nothing, and would all go to one task of its join: they are dealt to parts by their other columns.
    """
    out, row = df, F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    for position, key in enumerate(keys):
        side = first_per_key(facts, key, F.col(order), columns)
        part = F.pmod(F.xxhash64(key), F.lit(KEY_PARTS))
        side = side.select(key, part.alias("_part"), F.lit(key).alias(f"_by{position}"), *[F.col(c).alias(f"_{c}{position}") for c in columns])
        dealt = out.withColumn("_part", F.when(F.col(key).isNull(), F.pmod(row, F.lit(KEY_PARTS))).otherwise(part))
        out = dealt.join(side, [key, "_part"], "left").drop("_part")
    hit = [F.col(f"_by{p}") for p in range(len(keys))]
    picked = [
        F.coalesce(*[F.when(hit[p].isNotNull(), F.col(f"_{c}{p}")) for p in range(len(keys))]).alias(c) for c in columns
    ]
    return out.select(*df.columns, F.coalesce(*hit).alias("matched_by"), *picked)


def backfill(target: DataFrame, mapping: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """C20: fill a NULL value from the first mapping of the key; set values stay."""
    source = first_per_key(mapping.filter(F.col(value).isNotNull()), key, F.col(order), [value]).withColumnRenamed(value, "_v")
    return target.join(source, key, "left").withColumn(value, F.coalesce(F.col(value), F.col("_v"))).drop("_v")


def upsert(target: DataFrame, updates: DataFrame, key: str, order: Column, columns: Sequence[str], overwrite: bool = True) -> DataFrame:
    """Insert or update by key; the last write of a key wins, ``overwrite=False`` keeps existing rows."""
    last = updates.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_u"))
    merged = target.withColumn("_t", F.struct(*columns)).select(key, "_t").join(last, key, "full_outer")
    first, second = ("_u", "_t") if overwrite else ("_t", "_u")
    chosen = F.coalesce(F.col(first), F.col(second))
    action = (
        F.when(F.col("_t").isNull(), "inserted")
        .when(F.col("_u").isNull() | F.lit(not overwrite), "kept")
        .otherwise("updated")
    )
    return merged.select(key, *[chosen[c].alias(c) for c in columns], action.alias("action"))


def merge_arrays(target: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Set union of array columns on key match, insert otherwise."""
    empty = F.array().cast("array<string>")
    both = target.select(key, F.col(column).alias("_a")).join(updates.select(key, F.col(column).alias("_b")), key, "full_outer")
    return both.select(
        key, F.array_sort(F.array_union(F.coalesce("_a", empty), F.coalesce("_b", empty))).alias(column)
    )


def upsert_stats(df: DataFrame, vector: str, group: str) -> DataFrame:
    """A5: rows that can be stored against rows skipped for want of an embedding."""
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0)
    return df.groupBy(group).agg(F.count_if(usable).alias("stored"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("failed"))


def embedding_stats(df: DataFrame, vector: str, model: str) -> DataFrame:
    """Rows, embedded rows, coverage, distinct sizes and models."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(vector).alias("embedded"),
        (F.count(vector) / F.count(F.lit(1))).alias("coverage"),
        F.array_join(F.array_sort(F.collect_set(F.size(vector).cast("string"))), ",").alias("dims"),
        F.count_distinct(model).alias("models"),
    )


def canonical_join(df: DataFrame, aliases: DataFrame, term: str) -> DataFrame:
    """Canonical value of a term (exact, then without a generic ending); unknown terms pass through."""
    low = F.lower(F.trim(F.col(term)))
    keyed = df.withColumn("_k", low).withColumn("_k2", F.regexp_replace("_k", r" (cancer|carcinoma|tumors?)$", ""))
    exact = aliases.select(F.col("alias").alias("_k"), F.col("canonical").alias("_c1"))
    stripped = aliases.select(F.col("alias").alias("_k2"), F.col("canonical").alias("_c2"))
    joined = keyed.join(exact, "_k", "left").join(stripped, "_k2", "left")
    return joined.withColumn("canonical", F.coalesce("_c1", "_c2", F.col(term))).select(*df.columns, "canonical")


def tiered_lookup(df: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """Stage group of (t, n, m): exact 1.0, then "any" wildcards 0.8, then without suffixes 0.6.

    Each tier is an equi join on the distinct inputs: a lookup row with wildcards is written
    out over the values that occur, so nothing is compared pairwise.
    """
    low = df.select(id_col, *[F.lower(c).alias(c) for c in ("t", "n", "m")])
    base = {"t": r"[a-d]$", "n": r"[a-c]$|mi$", "m": r"[a-c]$"}
    inputs = low.select("t", "n", "m").distinct()
    keyed = inputs.select("t", "n", "m", *[F.regexp_replace(c, base[c], "").alias(f"{c}b") for c in base])
    rows = table.select("t", "n", "m", "stage", "ord")
    with_base = rows.select("*", *[F.regexp_replace(c, base[c], "").alias(f"{c}b") for c in base])

    def variants(cols: Sequence[str], side: DataFrame) -> DataFrame:
        """Inputs once per choice of "own value" or "any" on every axis."""
        out = side
        for c in cols:
            out = out.withColumn(f"k_{c}", F.explode(F.array(F.col(c), F.lit("any"))))
        return out

    def tier(name: Sequence[str], lookup: DataFrame, score: float) -> DataFrame:
        keys = [f"k_{c}" for c in name]
        right = lookup.select(*[F.col(c).alias(f"k_{c}") for c in name], "stage", "ord")
        return variants(name, keyed).join(right, keys).select("t", "n", "m", "stage", "ord", F.lit(score).alias("confidence"))

    exact = keyed.join(rows, ["t", "n", "m"]).select("t", "n", "m", "stage", "ord", F.lit(1.0).alias("confidence"))
    found = exact.unionByName(tier(["t", "n", "m"], rows, 0.8)).unionByName(tier(["tb", "nb", "mb"], with_base, 0.6))
    best = found.groupBy("t", "n", "m").agg(
        F.max("confidence").alias("confidence"),
        F.min_by("stage", F.struct(-F.col("confidence"), F.col("ord"))).alias("stage"),
    )
    return low.join(best, ["t", "n", "m"], "left").select(
        id_col, "t", "n", "m", "stage", F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


def alert_counts(alerts: DataFrame, studies: DataFrame, now: str) -> DataFrame:
    """C17: per alert the new studies of its type inside its look-back, and the newest of them.

    New studies are counted per (type, look-back) before the join, so alerts never meet
    single studies.
    """
    days = F.when(F.col("frequency") == "daily", 1).when(F.col("frequency") == "monthly", 30).otherwise(7)
    age = F.datediff(F.lit(now).cast("date"), F.col("created_at").cast("date"))
    fresh = studies.withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") <= 30))
    windows = fresh.withColumn("days", F.explode(F.array(F.lit(1), F.lit(7), F.lit(30)))).filter(F.col("age") <= F.col("days"))
    counts = windows.groupBy("type", "days").agg(
        F.count(F.lit(1)).alias("matches"),
        F.max_by("study_id", F.struct("created_at", "study_id")).alias("newest"),
    )
    return (
        alerts.withColumn("days", days)
        .join(counts, ["type", "days"], "left")
        .select("alert_id", "type", "frequency", F.coalesce("matches", F.lit(0)).alias("matches"), "newest")
    )


def manifest_order(df: DataFrame, source: str, importance: str, url: str) -> DataFrame:
    """A manifest by source, falling importance and URL, with the place of each URL in its source.

    The order is one range-partitioned sort. Places come from the counts of the parts a source lies in, so that a
    source with most of the URLs is not numbered in one task.
    """
    # A part holds the URLs of one source and one importance; only the parts are counted through.
    parts = df.groupBy(source, importance).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(source).orderBy(F.desc(importance)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.withColumn("_before", before).drop("_n")
    within = F.row_number().over(Window.partitionBy(source, importance).orderBy(url))
    placed = df.withColumn("_i", within).join(offsets, [source, importance]).withColumn("place", (F.col("_i") + F.col("_before")).cast("int"))
    return placed.select(source, "place", url, importance).orderBy(source, F.desc(importance), url)
