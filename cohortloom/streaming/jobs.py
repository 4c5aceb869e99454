"""Structured Streaming jobs: alert counts, idempotent ingest, latest-value state (L1-L3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortloom.operators.records import versioned_merge
from cohortloom.operators.retrieval import top_per
from cohortloom.streaming.log import StateLog

VERSION_SCHEMA = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("is_current", T.BooleanType()),
        T.StructField("superseded_by", T.StringType()),
    ]
)


def read_file_stream(spark: SparkSession, root: str, name: str, files_per_batch: int | None = 1) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream of its files; None: all that are there in one batch."""
    reader = spark.readStream.schema(spark.read.parquet(f"{root}/{name}.parquet").schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A stream takes a single file only by a pattern.
    return reader.parquet(f"{root}/{name}.parque[t]")


def alert_windows(events: DataFrame, alerts: DataFrame, at: str, kind: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """L1: new items per kind and tumbling window, with the saved alerts they concern.

    Items are counted first and joined to the alerts counted per kind, so single items never
    meet single alerts. Rows later than the watermark are dropped by the aggregation.
    """
    per_kind = alerts.groupBy(kind).agg(F.count(F.lit(1)).alias("alerts"))
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    counts = timed.withWatermark(at, delay).groupBy(F.window(at, window), kind).agg(F.count(F.lit(1)).alias("items"), F.max(at).alias("newest"))
    flat = counts.select(F.col("window.start").alias("window_start"), kind, "items", "newest")
    return flat.join(per_kind, kind)


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is available, append closed windows, and stop."""
    query = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped so far."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def ingest_documents(stream: DataFrame, log: StateLog, checkpoint: str, at: str, delay: str = "1 hour") -> StreamingQuery:
    """L2: versioned ingest of (document_id, content_hash); repeats inside the watermark are dropped.

    Per batch only versions of the documents in it are read and only changed rows written.
    """
    unique = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["document_id", "content_hash"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("document_id").agg(F.max_by("content_hash", F.struct(F.col(at), F.col("content_hash"))).alias("content_hash"))
        affected = log.read(before=batch_id).join(newest.select("document_id"), "document_id", "left_semi")
        merged = versioned_merge(affected, newest)
        log.write(merged.filter(~F.col("action").isin("skipped", "unchanged")), batch_id)

    query = unique.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_two_schema(keys: Sequence[T.StructField], value: T.DataType) -> T.StructType:
    """Rows of the latest-value state: keys, rank 1 or 2, time, tie-break id and value."""
    return T.StructType(
        [*keys, T.StructField("rank", T.IntegerType()), T.StructField("at", T.TimestampType()), T.StructField("id", T.LongType()), T.StructField("value", value)]
    )


def maintain_latest(stream: DataFrame, log: StateLog, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """L3: the two newest values per key, merged batch by batch.

    The batch is cut to two rows per key before it meets the stored rows of the same keys, so
    a hot key costs two rows per task.
    """
    order = [F.desc("at"), F.desc("id")]

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = top_per(batch.select(*keys, "at", "id", "value"), keys, order, 2)
        stored = log.read(before=batch_id).join(fresh.select(*keys).distinct(), list(keys), "left_semi")
        both = fresh.drop("rank").unionByName(stored.drop("rank")).distinct()
        log.write(top_per(both, keys, order, 2).withColumn("rank", F.col("rank").cast("int")), batch_id)

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
