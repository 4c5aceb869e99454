"""Keyed state kept as an append-only log of changed rows, one folder per micro-batch.

A batch writes only the rows it changes, into a folder named after the batch, and replaces
that folder when it is replayed; readers take the newest row per key. Executors may be lost
at any point: the folder is complete or it is written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StateLog:
    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], schema: T.StructType):
        self.spark, self.root, self.keys, self.schema = spark, root, list(keys), schema

    def write(self, rows: DataFrame, batch: int) -> None:
        """Replace the folder of one batch; batch -1 is the seed."""
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def read(self, before: int | None = None) -> DataFrame:
        """Newest row per key, optionally as it was before a batch."""
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        rows = self.spark.read.option("basePath", self.root).schema(full).parquet(self.root)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        rest = [c for c in self.schema.fieldNames() if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_b"))
        return best.select(*self.keys, *[F.col("_b")[c].alias(c) for c in rest])

    def compact(self, batch: int) -> None:
        """Write the whole current state as one batch folder; older folders may be removed after it."""
        self.write(self.read(), batch)
