"""Registry that pairs every query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortloom.plans import roles
from cohortloom.sources.scan import read_table, spread

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


class Bed:
    """The given tables and the role tables derived from them, for one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        df = read_table(self.spark, self.sf_dir, name)
        return spread(df) if name in roles.TEXT_TABLES else df

    def rows(self, name: str) -> int:
        """Rows of a given table, read from the footers of its files."""
        return read_table(self.spark, self.sf_dir, name).count()

    def role(self, name: str) -> DataFrame:
        sql, tables = roles.ROLES[name]
        inputs = {t: read_table(self.spark, self.sf_dir, t) for t in tables}
        if name in roles.TEXT_ROLES:
            inputs[tables[0]] = spread(inputs[tables[0]])
        return self.spark.sql(sql.format(**{t: f"{{{t}}}" for t in tables}), **inputs)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.role(name) if name in roles.ROLES else self.table(name)


def query(name: str, oracle: str | None = None, uses: str = ""):
    """Register ``fn(bed)`` under ``name``; ``uses`` lists the role tables the oracle SQL reads."""

    def wrap(fn: Callable[[Bed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Bed(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = roles.with_roles(oracle, uses.split())
        return fn

    return wrap
