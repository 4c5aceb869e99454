"""Bind an expression once, so that lambdas and repeated uses do not evaluate it again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated one time per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
