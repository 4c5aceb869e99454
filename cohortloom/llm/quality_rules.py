"""Quality rules: document statistics, and cross-document line frequency per host.

Normalised lines are hashed; for each host and line the distinct documents are counted; lines above the
limit are removed, and documents that keep too few of their words are rejected.

Defined cases: a null or empty text has no words, fails the base rule and is not kept. A null host is the
host of the empty name. Documents are told apart by doc_id, so the lines of many exact copies are frequent; rows of one
doc_id count as one document, and rows without one as a document for each different text. Texts of any length are
measured whole. Repeated rows are judged alike, each on its own row; an empty table gives an empty table. Other
columns are not read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.base import SPACES, Words, mix, pieces, written

SYMBOLS = "#*$%&|<>"  # fixed value
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A line in more distinct documents of one host than this is removed.
MAX_DOCS_PER_HOST = 20
# A document that keeps less than this share of its words is depleted.
MIN_SHARE_LEFT = 0.5

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_STATS = "row_key long, doc_key long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<hash:long,words:int>>"


def normal_line(line: str) -> bytes:
    """A-Z lower-cased, digits as 0, white space as single spaces, trimmed; UTF-8."""
    return b" ".join(line.encode("utf-8", "surrogatepass").translate(_FOLD).split())


def repeated_words(words: Words, length: int = 3) -> np.ndarray:
    """Per text, the words that lie in a window of ``length`` words found at least twice in the text."""
    first, value = words.windows(length)
    if not len(first):
        return np.zeros(len(words.count), np.int64)
    key = mix(value + words.text[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    again = first[times[where] > 1]
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + length, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.text[covered], minlength=len(words.count))


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    is_symbol = np.zeros(256, bool)
    is_symbol[[ord(c) for c in SYMBOLS]] = True
    for part in pieces(frames):
        texts = part["text"].tolist()
        words = Words(texts)
        raw = np.frombuffer(words.buffer, np.uint8)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        of_text = np.bincount(words.text, weights=chars[words.end] - chars[words.start], minlength=len(texts))
        symbols, dups, lines = [], [], []
        for text in texts:
            own = [x for x in (text or "").split("\n") if x.strip(SPACES)]
            symbols.append(sum((text or "").count(c) for c in SYMBOLS))
            dups.append(len(own) - len(set(own)))
            normal = [(x, x.count(b" ") + 1) for x in map(normal_line, own)]
            lines.append([{"hash": int.from_bytes(blake2b(x, digest_size=8).digest(), "big", signed=True), "words": n} for x, n in normal])
        yield part[["row_key", "doc_key", "doc_id", "host"]].assign(
            n_words=words.count, word_chars=of_text.astype(np.int64), n_symbols=symbols, n_dup_lines=dups, n_repeat_words=repeated_words(words), lines=lines
        )


def document_stats(docs: DataFrame) -> DataFrame:
    """The statistics of every row of (doc_id, text, source), with its normalised lines, as a written table."""
    rows = docs.select("doc_id", "text", F.col("source").alias("host"))
    keyed = rows.select("*", F.xxhash64("doc_id", "host", "text").alias("row_key"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit(""))))).alias("doc_key"))
    return written(keyed.mapInPandas(_measure, _STATS))


def quality_report(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, min_share: float = MIN_SHARE_LEFT) -> DataFrame:
    """Base statistics, base verdict, words left after the removal of frequent lines, and the verdict."""
    stats = document_stats(docs)
    # Repeated rows have the same key: their lines count once.
    lines = stats.groupBy("row_key").agg(F.first("doc_key").alias("doc_key"), F.first(F.coalesce("host", F.lit(""))).alias("host"), F.first("lines").alias("lines"))
    lines = lines.select("row_key", "doc_key", "host", F.explode("lines").alias("line")).select("row_key", "doc_key", "host", "line.*")
    frequent = lines.select("host", "hash", "doc_key").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)
    removed = lines.join(frequent, ["host", "hash"]).groupBy("row_key").agg(F.sum("words").alias("n_removed"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = stats.drop("lines").join(removed, "row_key", "left").withColumn("n_left", F.col("n_words") - F.coalesce("n_removed", F.lit(0)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & (F.col("n_left") >= min_share * F.col("n_words"))).alias("kept"), "n_left",
    )
