"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark items: 13 consecutive words, or a whole shorter item. For
each pattern length a table says how far the search may shift when it looks at two neighbouring words; two
words that end a pattern shift by nothing, and the patterns filed under them are compared directly.

Defined cases: a null or empty text has no words and no hits. An item without words, or with a null id, is
no item. Items with the same id count once. Overlapping and equal occurrences count each word once. Repeated rows are
judged alike, each on its own row. An empty benchmark leaves every document clean, an empty table gives an empty
table. Texts of any length are searched whole. Other columns are not read by the report and kept by the stage, whose
own column is named ``_contamination``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.base import written

WINDOW = 13
# One shard of the benchmark, whose search tables are broadcast, holds about so many words.
SHARD_WORDS = 1_000_000
_BREAKS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _BREAKS, bytes(range(97, 123)) + b" " * len(_BREAKS))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; maximal runs of letters a-z, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Search:
    """Shift tables and suffix buckets for the windows of some items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        patterns: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, words in items:
            length = min(window, len(words))
            own = patterns.setdefault(length, {})
            for k in range(len(words) - length + 1):
                own.setdefault(tuple(words[k : k + length]), set()).add(item)
        self.tables = [(length, *self._tables(length, own)) for length, own in sorted(patterns.items())]

    @staticmethod
    def _tables(length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        """Shift by last word and the word before it, and the patterns under each ending block."""
        shift: dict[bytes, dict[bytes, int]] = {}
        bucket: dict[tuple[bytes, bytes], dict[tuple[bytes, ...], frozenset[str]]] = {}
        for pattern, items in patterns.items():
            for end in range(1, length):
                row = shift.setdefault(pattern[end], {})
                row[pattern[end - 1]] = min(row.get(pattern[end - 1], length), length - 1 - end)
            if length > 1:
                bucket.setdefault(pattern[-2:], {})[pattern] = frozenset(items)
            else:
                bucket[(pattern[0], b"")] = {pattern: frozenset(items)}
        return shift, bucket

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) of every occurrence, and the items that have one."""
        spans, items, n = [], set(), len(words)
        for length, shift, bucket in self.tables:
            if length == 1:
                for i, word in enumerate(words):
                    if found := bucket.get((word, b"")):
                        spans.append((i, i + 1))
                        items |= found[(word,)]
                continue
            i, most = length - 1, length - 1
            while i < n:
                row = shift.get(words[i])
                step = most if row is None else row.get(words[i - 1], most)
                if step:
                    i += step
                    continue
                # The block ends some pattern: compare those filed under it.
                window = tuple(words[i - most : i + 1])
                if found := bucket[window[-2:]].get(window):
                    spans.append((i - most, i + 1))
                    items |= found
                i += 1
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Words that lie in any of the spans."""
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def shards(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in shards of about SHARD_WORDS words; one partition at a time comes to the driver."""
    shard, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null").toLocalIterator():
        words = words_of(row["text"])
        if words:
            shard.append((row["item"], words))
            size += len(words)
        if size >= SHARD_WORDS:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


_FOUND_TYPE = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """All columns of ``docs`` and ``out``: the number of words, spans and items of all occurrences.

    Each shard of the benchmark is searched in turn; a span or item of one shard is added to those of the
    shards before. Documents are not shuffled. Between two shards the rows are written, so that the driver, a
    broadcast and a worker hold the tables of one shard at a time, about SHARD_WORDS words, however large the benchmark is.
    """
    spark = docs.sparkSession
    rows, found, search = docs.withColumn(out, F.lit(None).cast(_FOUND_TYPE)), False, None
    for shard in shards(benchmark):
        if search:
            rows = written(rows)
            search.unpersist()
        search = spark.sparkContext.broadcast(Search(shard))
        rows, found = rows.withColumn(out, F.pandas_udf(_searcher(search), _FOUND_TYPE)(F.col(text), F.col(out))), True
    if not found:
        rows = rows.withColumn(out, F.pandas_udf(_searcher(spark.sparkContext.broadcast(Search([]))), _FOUND_TYPE)(F.col(text), F.col(out)))
    return rows


def _searcher(tables):
    def run(frames: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        search = tables.value
        for texts, before in frames:
            rows = []
            for k, text in enumerate(texts):
                words = words_of(text)
                spans, items = search.find(words)
                if before["spans"].iloc[k] is not None:
                    spans += [(x["start"], x["end"]) for x in before["spans"].iloc[k]]
                    items |= set(before["items"].iloc[k])
                rows.append((len(words), [{"start": a, "end": b} for a, b in spans], sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return run


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words and items of every row of (doc_id, text), and whether it is contaminated: 5 % of its words or more."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            hits = [covered([(x["start"], x["end"]) for x in spans]) for spans in part["spans"]]
            yield pd.DataFrame({"n_hit": hits, "items_sha256": [sha256(",".join(sorted(x)).encode()).hexdigest() for x in part["items"]]})

    found = occurrences(docs.select("doc_id", "text"), benchmark).select("doc_id", "found", F.pandas_udf(digest, "n_hit long, items_sha256 string")("found").alias("sums"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("sums.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.col("sums.items_sha256").alias("items_sha256"),
        ((F.col("sums.n_hit") > 0) & (20 * F.col("sums.n_hit") >= F.col("found.n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    rows = occurrences(docs, benchmark, out="_contamination")
    rows = rows.withColumn("_hit_words", F.pandas_udf(_hit_words, "long")("_contamination"))
    return rows.where(~((F.col("_hit_words") > 0) & (20 * F.col("_hit_words") >= F.col("_contamination.n_words")))).select(*docs.columns)


def _hit_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for part in frames:
        yield pd.Series([covered([(x["start"], x["end"]) for x in spans]) for spans in part["spans"]], dtype="int64")
