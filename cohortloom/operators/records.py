"""Longitudinal records and versioned documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.ids import stable_id
from cohortloom.functions.parse import round_half_up

# Look-back days of the change figures, and the change that marks a risk.
CHANGE_DAYS = (7, 30, 90)
RISK_CUTS = ((-10.0, "high"), (-5.0, "moderate"))


def _newest(at: str, tie: str) -> Column:
    """Order key for max_by: unknown times lose, ties go to the higher id."""
    return F.struct(F.col(at).isNotNull(), F.col(at), F.col(tie))


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Newest row per key, unknown times last. An aggregate: a hot key is reduced before the shuffle."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), _newest(at, tie)).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in columns])


def latest_previous(df: DataFrame, keys: Sequence[str], at: str, tie: str, value: str) -> DataFrame:
    """Newest and second newest value per key side by side.

    ``rank <= 2`` lets Spark drop all but two rows per key and task ahead of the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    top = df.select(*keys, at, tie, value).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"),
        F.max(F.when(F.col("rn") == 1, F.col(at))).alias("latest_at"),
        F.max(F.when(F.col("rn") == 2, F.col(value))).alias("previous"),
        F.max(F.when(F.col("rn") == 2, F.col(at))).alias("previous_at"),
    )


def trend_last_n(df: DataFrame, keys: Sequence[str], at: str, tie: str, n: int) -> DataFrame:
    """The last ``n`` readings per key, numbered in time order."""
    newest = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    forward = Window.partitionBy(*keys).orderBy(F.desc("rn"))
    top = df.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)
    return top.withColumn("step", F.row_number().over(forward)).drop("rn")


def asof_baseline(df: DataFrame, keys: Sequence[str], at: str, tie: str, value: str, now: str, days: int) -> DataFrame:
    """C11: last reading at or before now - days, else the earliest one."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    order = F.struct(F.col(at), F.col(tie))
    return df.filter(F.col(at).isNotNull()).groupBy(*keys).agg(
        F.coalesce(
            F.max_by(value, F.when(F.col(at) <= cutoff, order)), F.min_by(value, order)
        ).alias("baseline")
    )


def change_windows(df: DataFrame, keys: Sequence[str], at: str, tie: str, value: str, now: str) -> DataFrame:
    """Percent change against 7, 30 and 90 days ago; NULL below two readings or on a zero base."""
    order = F.struct(F.col(at), F.col(tie))
    anchor = F.lit(now).cast("timestamp")
    bases = [
        F.coalesce(
            F.max_by(value, F.when(F.col(at) <= anchor - F.expr(f"interval {d} days"), order)), F.min_by(value, order)
        ).alias(f"base_{d}")
        for d in CHANGE_DAYS
    ]
    stats = df.filter(F.col(at).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(value, order).alias("latest"), *bases
    )

    def change(d: int) -> Column:
        base = F.col(f"base_{d}")
        return F.when((F.col("n") >= 2) & (base != 0), round_half_up((F.col("latest") - base) / base * 100, 1))

    return stats.select(*keys, "n", "latest", *[change(d).alias(f"change_{d}d") for d in CHANGE_DAYS])


def event_summary(df: DataFrame, name: str, at: str, severity: str, note: str, tie: str) -> DataFrame:
    """Per kind the count, first and last day, worst severity and newest note."""
    return df.groupBy(F.lower(F.trim(name)).alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.to_date(at)).alias("first_day"),
        F.max(F.to_date(at)).alias("last_day"),
        F.max(severity).alias("worst"),
        F.max_by(note, _newest(at, tie)).alias("newest_note"),
    )


def interpretation_policy(pairs: DataFrame) -> DataFrame:
    """A trend may be stated only when an earlier reading exists."""
    policy = F.when(F.col("previous").isNotNull(), "value_and_trend").otherwise("value_only")
    direction = F.when(F.col("latest") > F.col("previous"), "up").when(F.col("latest") < F.col("previous"), "down").when(
        F.col("previous").isNotNull(), "flat"
    )
    return pairs.withColumn("policy", policy).withColumn("direction", direction)


def versioned_merge(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """K1: next state of a versioned document table.

    ``current``: document_id, content_hash, is_current, superseded_by; ``incoming``: document_id,
    content_hash, one row per document. Unchanged content is skipped; new content becomes
    current and the former version points to it; content that returns to an older version
    makes that version current again (its old pointer stays).
    """
    new_id = stable_id("version", F.col("document_id"), F.col("new_hash"))
    fresh = incoming.select("document_id", F.col("content_hash").alias("new_hash"))
    joined = current.join(fresh, "document_id", "left")
    is_new = F.col("new_hash").isNotNull()
    same = F.col("content_hash") == F.col("new_hash")
    stays = joined.select(
        "document_id", "content_hash",
        F.when(is_new, same).otherwise(F.col("is_current")).alias("is_current"),
        F.when(is_new & ~same & F.col("is_current"), new_id).otherwise(F.col("superseded_by")).alias("superseded_by"),
        F.when(is_new & same & F.col("is_current"), "skipped").when(is_new & same, "restored")
        .when(is_new & F.col("is_current"), "superseded").otherwise("unchanged").alias("action"),
    )
    known = current.select("document_id", F.col("content_hash").alias("new_hash")).distinct()
    inserts = fresh.join(known, ["document_id", "new_hash"], "left_anti").select(
        "document_id", F.col("new_hash").alias("content_hash"), F.lit(True).alias("is_current"),
        F.lit(None).cast("string").alias("superseded_by"), F.lit("inserted").alias("action"),
    )
    return stays.unionByName(inserts)


def state_snapshot(readings: DataFrame, profiles: DataFrame, now: str) -> DataFrame:
    """K2: one nested row per profile: latest and previous value and change of every kind."""
    keys = ["profile_id", "kind"]
    pairs = interpretation_policy(latest_previous(readings, keys, "collected_at", "event_id", "value"))
    changes = change_windows(readings, keys, "collected_at", "event_id", "value", now).select(*keys, "n", "change_30d")
    per_kind = pairs.join(changes, keys, "left")
    entry = F.struct("kind", "latest", "previous", "direction", "policy", F.coalesce("n", F.lit(0)).alias("n"), "change_30d")
    nested = per_kind.groupBy("profile_id").agg(
        F.array_sort(F.collect_list(entry)).alias("series"), F.min("change_30d").alias("worst_change")
    )
    return profiles.join(nested, "profile_id", "left")


def risk_label(change: Column) -> Column:
    """K3: risk from a percent change when none was assessed."""
    label = F.when(change.isNotNull(), F.lit("low"))
    for cut, name in reversed(RISK_CUTS):
        label = F.when(change <= cut, F.lit(name)).otherwise(label)
    return label


def derived_features(events: DataFrame, key: str, name: str, kind: str) -> DataFrame:
    """K3: sorted distinct names and flags over the kinds of one profile's events."""
    distinct = events.groupBy(key, name, kind).agg(F.count(F.lit(1)).alias("n"))
    per_kind = distinct.groupBy(key, kind).agg(F.sum("n").alias("n"))
    flags = per_kind.groupBy(key).agg(
        F.sum(F.when(F.col(kind).isin("primary", "second_primary"), F.col("n"))).alias("primaries"),
        F.bool_or(F.col(kind).isin("recurrence", "progression")).alias("has_recurrence_or_progression"),
    )
    names = distinct.select(key, name).distinct().groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("names"))
    return names.join(flags, key).withColumn("has_multiple_primaries", F.coalesce(F.col("primaries") > 1, F.lit(False))).drop("primaries")


def stale_keys(snapshots: DataFrame, revisions: DataFrame, key: str) -> DataFrame:
    """K4: profiles whose newest snapshot is missing or of another revision."""
    newest = snapshots.groupBy(key).agg(F.max("revision").alias("snapshot_revision"))
    return revisions.join(newest, key, "left").filter(
        F.col("snapshot_revision").isNull() | (F.col("snapshot_revision") != F.col("revision"))
    )


def timeline(df: DataFrame, key: str, at: str, tie: str, limit: int) -> DataFrame:
    """K5: newest entries per profile, newest first."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def parent_latest_child(parents: DataFrame, children: DataFrame, key: str, at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """K6: every parent with its newest child, in one join."""
    return parents.join(latest_per_key(children, [key], at, tie, columns), key, "left")
