"""Model hooks: text to vector and (query, text) to score, with defaults that need no model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """Default embedder: unit-length hashed bag of words.

    Words are cut and hashed by Spark expressions; only the counting per slot runs on Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def count_slots(slots: pd.Series) -> pd.Series:
        counts = np.stack([np.bincount(np.asarray(s, dtype=np.int64), minlength=dims) for s in slots]).astype(np.float64)
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        unit = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
        return pd.Series(list(unit.astype(np.float32)))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    return count_slots(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int")))


def embedder(fn: Callable[[list[str]], list[list[float]]]):
    """Wrap a batch model ``texts -> vectors`` as a column function running on Arrow batches in the workers."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(fn(texts.fillna("").tolist()))

    return embed


def scorer(fn: Callable[[list[tuple[str, str]]], list[float]]):
    """Wrap a batch model ``(query, text) pairs -> scores`` the same way."""

    @F.pandas_udf(T.DoubleType())
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(fn(list(zip(queries.fillna(""), texts.fillna(""), strict=True))), dtype="float64")

    return score
