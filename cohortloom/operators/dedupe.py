"""Set operations and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.binding import let
from cohortloom.session import ensure_checkpoint_dir


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the least by ``order``; an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def content_key(text: Column) -> Column:
    """H4: hash of the lower-cased text with white space folded."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def content_dedupe(df: DataFrame, text: str, order: Sequence[Column]) -> DataFrame:
    """H4: best-ranked row per distinct passage, whole texts compared."""
    return keep_first(df.withColumn("content_key", content_key(F.col(text))).drop(text), ["content_key"], order)


def source_priority_dedupe(df: DataFrame, text: str, priority: Column, importance: Column, row_id: str) -> DataFrame:
    """H5: all rows, labelled selected or exact_duplicate by source priority then importance."""
    keyed = df.withColumn("content_key", F.sha2(F.col(text), 256))
    best = keyed.groupBy("content_key").agg(
        F.min_by(row_id, F.struct(priority, -importance, F.col(row_id))).alias("kept_id"), F.count(F.lit(1)).alias("copies")
    )
    reason = F.when(F.col(row_id) == F.col("kept_id"), "selected").otherwise("exact_duplicate")
    return keyed.drop(text).join(best, "content_key").withColumn("reason", reason)


def case_dedupe(df: DataFrame, key: str, term: str, order: str) -> DataFrame:
    """H7: case-insensitive distinct terms per key, the first spelling with a capital preferred."""
    plain = (F.col(term) == F.lower(term)).cast("int")
    return (
        df.withColumn("folded", F.lower(term))
        .groupBy(key, "folded")
        .agg(F.min_by(term, F.struct(plain, F.col(order))).alias("term"))
    )


def first_wins(df: DataFrame, order: str, keys: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """H6: greedy de-duplication over several keys, in ``order``, exact for chained keys.

    A row is dropped only when it shares a key with an earlier row that was kept. Per round,
    rows that come first among the open rows of all their keys are kept and their sharers
    dropped. Every round settles at least one row, so the rounds end, after as many as the longest chain. ``order`` must be unique within ``scope``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    scoped = list(scope)
    open_rows = df.checkpoint()
    kept = None
    while True:
        long = open_rows.select(
            *scoped, order, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys])).alias("e")
        ).select(*scoped, order, "e.k", "e.v").filter(F.col("v").isNotNull())
        leaders = long.groupBy(*scoped, "k", "v").agg(F.min(order).alias("lead"))
        led = long.join(leaders, [*scoped, "k", "v"])
        state = led.groupBy(*scoped, order).agg(F.min((F.col(order) == F.col("lead")).cast("int")).alias("first"))
        winners = state.filter(F.col("first") == 1).select(*scoped, order)
        blocked_keys = long.join(winners, [*scoped, order], "left_semi").select(*scoped, "k", "v").distinct()
        blocked = long.join(blocked_keys, [*scoped, "k", "v"], "left_semi").select(*scoped, order).distinct()
        keyless = open_rows.join(long.select(*scoped, order).distinct(), [*scoped, order], "left_anti")
        won = open_rows.join(winners, [*scoped, order], "left_semi").unionByName(keyless)
        kept = won if kept is None else kept.unionByName(won)
        kept = kept.checkpoint()
        open_rows = open_rows.join(blocked, [*scoped, order], "left_anti").join(keyless.select(*scoped, order), [*scoped, order], "left_anti").checkpoint()
        if open_rows.isEmpty():
            return kept


def union_provenance(parts: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """H2: distinct keys with one flag per origin."""
    names = [n for n, _ in parts]
    rows = None
    for name, df in parts:
        side = df.select(key, F.lit(name).alias("origin"))
        rows = side if rows is None else rows.unionByName(side)
    return rows.groupBy(key).agg(*[F.bool_or(F.col("origin") == n).alias(f"from_{n}") for n in names])


def multi_corpus_merge(parts: Sequence[DataFrame]) -> DataFrame:
    """H3: union of corpora, one row per identity (point, else document place, else whole text); first corpus wins."""
    identity = F.coalesce(
        F.concat(F.lit("point:"), F.col("point_id").cast("string")),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("section", F.lit("")), F.lit("|"),
                 F.coalesce(F.col("chunk_index").cast("string"), F.lit(""))),
        F.concat(F.lit("text:"), F.col("text")),
    )
    rows = None
    for position, df in enumerate(parts):
        side = df.withColumn("corpus", F.lit(position))
        rows = side if rows is None else rows.unionByName(side)
    return keep_first(rows.withColumn("identity", identity), ["identity"], [F.col("corpus"), F.col("pos")])


def reconcile_fields(rule: DataFrame, model: DataFrame, key: str, model_first: Sequence[str]) -> DataFrame:
    """H9: one value per (id, field) from two extractors, with its source and whether they disagree."""
    both = rule.select(key, "field", F.col("value").alias("rule_value")).join(
        model.select(key, "field", F.col("value").alias("model_value")), [key, "field"], "full_outer"
    )
    agreed = F.lower("rule_value") == F.lower("model_value")
    prefer_model = F.col("field").isin(list(model_first))
    value = F.when(prefer_model, F.coalesce("model_value", "rule_value")).otherwise(F.coalesce("rule_value", "model_value"))
    source = (
        F.when(agreed, "agreed")
        .when(F.col("model_value").isNull(), "rule")
        .when(F.col("rule_value").isNull(), "model")
        .otherwise(F.when(prefer_model, "model").otherwise("rule"))
    )
    return both.select(
        key, "field", F.when(agreed, F.col("rule_value")).otherwise(value).alias("value"), source.alias("value_source"),
        F.coalesce(~agreed, F.lit(False)).alias("disagree"),
    )


def array_move(source: Column, target: Column, exempt: Sequence[str]) -> Column:
    """Names of ``source`` that ``target`` does not hold, exempt names always kept."""
    keep = [e.lower() for e in exempt]
    return let(
        F.transform(target, lambda x: F.lower(x)),
        lambda held: F.filter(source, lambda x: ~F.array_contains(held, F.lower(x)) | F.lower(x).isin(keep)),
    )
