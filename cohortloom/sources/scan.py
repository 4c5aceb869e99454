"""Table scans, spread over the cores when the files give too few partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


# Rows of a table that a task sorts or counts at a time.
ROWS_A_PART = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to parts for about ROWS_A_PART of ``rows`` rows of its table, so that a task's share does not grow with the table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // ROWS_A_PART)), *keys)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that has fewer partitions than the cluster has cores.

    A small file with one row group would put all text parsing on one core. Real inputs have
    more splits than cores, and for them this returns the scan unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
