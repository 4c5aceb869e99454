"""Session settings, rule tables, and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "cohortloom", cores: str | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the session you are given."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Larger methods are never JIT-compiled by the JVM: let Spark split such stages instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed rules as a broadcast DataFrame (the rows are in the program, so the size is known)."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the tables, for joins by shuffle only.

    Spark guesses exploded rows and few columns of a table far too small, and would collect them in the driver to broadcast them.
    """
    return df.hint("merge")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset (local tests) a folder of the
    warehouse is used, which driver and executors share as well; never a machine-local temp folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    target = configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(target)
    return target
