"""File sources and sinks (A1-A4, A8): processed document folders, JSONL, manifests and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_processed_docs(spark: SparkSession, root: str, schema: T.StructType | str, suffix: str = "_document_index.json") -> DataFrame:
    """A1: index files under category/document folders; category and document come from the path.

    Documents without an index file give no row, and a file that cannot be parsed loses only itself.
    """
    raw = (
        spark.read.option("recursiveFileLookup", True).option("wholetext", True).option("pathGlobFilter", f"*{suffix}").text(root)
    )
    path = F.input_file_name()
    parsed = raw.filter(F.get_json_object("value", "$").isNotNull()).select(
        F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1), "^category=", "").alias("category"),
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("doc_dir"),
        F.from_json("value", schema).alias("doc"),
    )
    return parsed


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A2: JSON lines; blank and broken lines are dropped, not fatal."""
    bad = "_bad_line"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).schema(full).json(path)
    return rows.filter(F.col(bad).isNull()).drop(bad)


def write_manifest(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A3: the same rows as JSON lines or CSV, columns in sorted order."""
    rows = df.select(*sorted(df.columns))
    writer = rows.write.mode("errorifexists")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path))


def write_tables(tables: DataFrame, path: str, key: str, cells: str) -> None:
    """A4: one folder of CSV lines per table key, cells joined and quoted by the CSV writer."""
    width = F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), "\u001f")
    tables.select(key, width.alias("row")).write.mode("errorifexists").partitionBy(key).csv(path)


def read_tables(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Tables written by :func:`write_tables`, cells as an array again."""
    rows = spark.read.schema(f"row string, {key} string").csv(path)
    return rows.select(key, F.split("row", "\u001f").alias("cells"))


def explode_profile(df: DataFrame, key: str, text: str, schema: str, children: list[str]) -> DataFrame:
    """Child rows (child, 0-based order, JSON of the entry) of an extraction document."""
    doc = df.select(key, F.from_json(text, schema).alias("d"))

    def entries(child: str):
        return F.transform(
            F.coalesce(F.col(f"d.{child}"), F.array()),
            lambda e, i: F.struct(F.lit(child).alias("child"), i.alias("child_order"), F.to_json(e).alias("entry")),
        )

    return doc.select(key, F.explode(F.concat(*[entries(c) for c in children])).alias("e")).select(key, "e.child", "e.child_order", "e.entry")
