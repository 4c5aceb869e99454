"""What the operators share: scans, row keys, written intermediate tables, word hashing, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import ensure_checkpoint_dir

# Words of the contracts: maximal runs of anything but ASCII white space.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = "[^\\x20\\x09-\\x0D]+"
# Text is handled in pieces of about this many bytes, whatever the size of an Arrow batch.
PIECE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """64-bit key of a row's content; never null, equal for repeated rows."""
    return F.xxhash64(*columns)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here, and a lost
    executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- bit tables: which rows surely have no partner in a join

TABLE_BITS = 23


def bit_table(keys: DataFrame) -> Column:
    """Bits of the column ``key`` as an array of 2 ** (TABLE_BITS - 6) longs, a scalar subquery."""
    place = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - TABLE_BITS}) & 63 as int))")
    words = keys.groupBy(F.shiftright(place, 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    dense = keys.sparkSession.range(1 << (TABLE_BITS - 6)).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("t")).scalar()


def in_table(table: Column, key: Column) -> Column:
    place = F.shiftrightunsigned(key, 64 - TABLE_BITS)
    word = F.get(table, F.shiftright(place, 6).cast("int"))
    return F.call_function("getbit", word, place.bitwiseAND(F.lit(63)).cast("int")) == 1


# --- words as numbers ------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) | 1 for x in _RNG.integers(2**62, 2**63, 2, dtype=np.uint64)]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on 64-bit words (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]), dtype=np.uint64)
        inv = pow(base, -1, 2**64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inv, np.uint64)]), dtype=np.uint64)
        have = _POWERS[base] = (up, down)
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span, from one prefix sum over the ring of 64-bit numbers."""
    up, down = _powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of several texts as arrays: byte spans, 64-bit hashes, and the text each is from."""

    def __init__(self, texts: list[str | bytes | None]):
        parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buffer = b"\n".join(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        first_byte = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(parts) else np.zeros(0, np.int64)
        raw = np.frombuffer(self.buffer, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_IS_SPACE[raw]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.text = np.searchsorted(first_byte, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=len(parts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]) if len(parts) else np.zeros(0, np.int64)
        self.hash = span_hashes(_BYTE_VALUE[raw], self.start, self.end, _BASES[0])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``length`` words that lies in one text."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.text[:n] == self.text[length - 1 :])
        return first, span_hashes(self.hash, first, first + length, _BASES[1])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the words first to last, the last one excluded."""
        return span_hashes(self.hash, first, last, _BASES[1])

    def whole(self) -> np.ndarray:
        """Hash of each text's whole word sequence."""
        return span_hashes(self.hash, self.first, self.first + self.count, _BASES[1])


def pieces(frames: Iterator[pd.DataFrame], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pd.DataFrame]:
    """Frames cut so that each holds about ``limit`` characters of ``column`` (one row at least)."""
    for frame in frames:
        size = frame[column].map(lambda t: len(t) if t is not None else 0).to_numpy().cumsum()
        block = size // limit
        for _, part in frame.groupby(block, sort=False):
            yield part.reset_index(drop=True)


# --- connected components --------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of the edges (a, b); the label is the least id of the component.

    Alternates large-star and small-star steps, each an aggregate and a join, until nothing moves;
    each round is written to the shared folder. Nothing but two figures per round reaches the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        stamp = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if stamp == seen:
            break
        seen = stamp
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return leaves.union(now.select(F.col("b").alias("id"), F.col("b").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
