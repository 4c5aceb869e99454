"""Substring de-duplication: words covered by a 50-word window that starts in an earlier document go.

Reference passages are indexed by suffix automata, shard by shard, and the other passages are streamed
over them for their matching statistics. Which passages can match at all, and which shard they belong to,
is told by anchors, so that no automaton of the whole corpus has to be broadcast:

1. The anchor of a window is the least hash among its ANCHOR-word runs. Equal windows have equal anchors,
   so a window that occurs twice has an anchor that occurs twice. Windows that follow each other mostly
   share an anchor; such a run of windows, with all its words, is a passage.
2. Anchors are counted over the whole corpus (with pre-aggregation). Those in more than one document enter
   a bit table of fixed size, which is broadcast; it lets all of them through, and few others.
3. Passages whose anchor passes are written out as hashes and places. Equal ones are folded into one,
   whose least document is their head; in every later document they go whole.
4. Only heads of anchors with different passages need their words: a second bit table picks them in
   another scan. Dealt out by anchor, sorted by anchor and document, they stream through one automaton
   per anchor.
5. Spans return to the documents by row key.

Defined cases: a null or empty text has no words. Rows with a null doc_id are never reduced and reduce no
other. Documents with the same doc_id do not reduce each other, so repeated rows keep what the first of
them keeps. Of equal windows the one in the least doc_id stays. Texts of fewer than 50 words stay whole; longer ones
are read whole, whatever their length. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.automaton import SuffixAutomaton
from cohortloom.llm.base import Words, mix, pieces, written

WINDOW = 50
ANCHOR = 14
# Bits of the table of repeated anchors: 4 MB, whatever the input. A full table only lets more passages through.
TABLE_BITS = 25


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of values[i : i + width] (the last of equal ones) for every i, by doubling."""
    best = np.arange(len(values))
    have = 1
    while have < width:
        more = min(have, width - have)
        left, right = best[: len(best) - more], best[more:]
        best = np.where(values[left] < values[right], left, right)
        have += more
    return best


def passages(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, last window start) of every run of windows that share an anchor."""
    first, value = words.windows(anchor)
    width = window - anchor + 1
    if len(first) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = _least_in_window(value, width)
    start = first[: len(best)]
    inside = words.text[start] == words.text[np.minimum(start + window - 1, len(words.text) - 1)]
    inside &= start + window <= len(words.text)
    start, at = start[inside], best[inside]
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    return value[at[head]], start[head], start[tail]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").select("*", F.xxhash64("doc_id", "text").alias("row_key"))


def repeated_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Anchors that occur in documents of different ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames):
            words = Words(part["text"].tolist())
            key, start, _ = passages(words, window, anchor)
            found = pd.DataFrame({"key": key.view(np.int64), "doc_id": part["doc_id"].to_numpy(np.int64)[words.text[start]]})
            yield found.drop_duplicates()

    rows = _rows(docs).where("doc_id is not null").mapInPandas(run, "key long, doc_id long")
    return rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key``, 64 a word: at most 2 ** (TABLE_BITS - 6) rows come to the driver."""
    place = F.shiftrightunsigned(F.col("key"), 64 - TABLE_BITS)
    bits = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - TABLE_BITS}) & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    frame = bits.toPandas()
    table[frame["word"].to_numpy(np.int64)] = frame["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def in_table(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key >> np.uint64(64 - TABLE_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def head_key(anchor: np.ndarray, body: np.ndarray, row_key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit key of one passage at its place."""
    return mix(mix(anchor ^ mix(body)) ^ mix(row_key + start.astype(np.uint64)))


def candidate_passages(docs: DataFrame, anchors, heads, window: int, anchor: int) -> DataFrame:
    """Passages whose anchor is in the table ``anchors``: hashes, and where in which document they start.

    With a table ``heads`` only those in it, with their words.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames):
            words = Words(part["text"].tolist())
            key, low, high = passages(words, window, anchor)
            hit = in_table(anchors.value, key)
            key, low, high = key[hit], low[hit], high[hit]
            body = words.hashes(low, high + window)
            text = words.text[low]
            rows = part["row_key"].to_numpy(np.int64)[text]
            start = low - words.first[text]
            place = head_key(key, body, rows.view(np.uint64), start)
            out = {"anchor": key.view(np.int64), "body": body.view(np.int64), "n_starts": (high - low + 1).astype(np.int32), "doc_id": part["doc_id"].to_numpy(np.int64)[text],
                   "row_key": rows, "start": start.astype(np.int32), "key": place.view(np.int64)}
            if heads is None:
                yield pd.DataFrame(out)
                continue
            keep = np.flatnonzero(in_table(heads.value, place))
            first, last = words.start[low[keep]].tolist(), words.end[high[keep] + window - 1].tolist()
            text = [b" ".join(words.buffer[a:b].split()) for a, b in zip(first, last, strict=True)]
            yield pd.DataFrame({"anchor": out["anchor"][keep], "body": out["body"][keep], "first_doc": out["doc_id"][keep], "words": text})

    schema = "anchor long, body long, n_starts int, doc_id long, row_key long, start int, key long" if heads is None else "anchor long, body long, first_doc long, words binary"
    return _rows(docs).where("doc_id is not null").mapInPandas(run, schema)


def _match(window: int):
    """Streams passages sorted by anchor and document; (anchor, body, doc, starts) for those with known windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, waiting, automaton = None, [], None

        def add(item) -> None:
            nonlocal automaton
            if automaton is None:
                automaton = SuffixAutomaton()
            automaton.add(*item)

        for frame in frames:
            out = []
            for key, body, words, doc in zip(frame["anchor"].tolist(), frame["body"].tolist(), frame["words"], frame["first_doc"].tolist(), strict=True):
                if key != anchor:
                    anchor, waiting, automaton = key, [], None
                if waiting and waiting[0][1] < doc:
                    # Only now is it known that the anchor has a second document.
                    for item in waiting:
                        add(item)
                    waiting = []
                passage = words.split(b" ")
                if automaton is not None:
                    starts = [end - window for end, first in automaton.matching(passage, window) if first < doc]
                    if starts:
                        out.append((key, body, doc, starts))
                waiting.append((passage, doc))
            yield pd.DataFrame(out, columns=["anchor", "body", "doc", "starts"])

    return run


def removed_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(row_key, spans): the word spans of each row that repeat a smaller document; one row a key."""
    share = docs.sparkSession.sparkContext.broadcast
    anchors = share(bit_table(repeated_anchors(docs, window, anchor)))
    found = written(candidate_passages(docs, anchors, None, window, anchor))
    heads = written(found.groupBy("anchor", "body").agg(F.min(F.struct("doc_id", "key")).alias("head")).select("anchor", "body", F.col("head.doc_id").alias("first_doc"), F.col("head.key").alias("key")))
    several = heads.groupBy("anchor").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low < high").select("anchor")
    wanted = share(bit_table(heads.join(several, "anchor").select("key")))
    streamed = candidate_passages(docs, anchors, wanted, window, anchor).repartition("anchor").sortWithinPartitions("anchor", "first_doc")
    own = streamed.mapInPandas(_match(window), "anchor long, body long, doc long, starts array<int>")
    # A place that the table lets through though it is no head may be of a later document.
    first = heads.select("anchor", "body", "first_doc").join(own.withColumnRenamed("doc", "first_doc").dropDuplicates(["anchor", "body", "first_doc"]), ["anchor", "body", "first_doc"], "left")
    # A passage of a later document than the first one with the same words goes whole.
    places = found.select("anchor", "body", "doc_id", "row_key", "start", "n_starts").join(first, ["anchor", "body"])
    whole = places.where("doc_id > first_doc").select("row_key", F.struct(F.col("start"), (F.col("start") + F.col("n_starts") - 1 + window).alias("end")).alias("span"))
    part = places.where("doc_id = first_doc and starts is not null").select("row_key", "start", F.explode("starts").alias("s"))
    part = part.select("row_key", F.struct((F.col("start") + F.col("s")).alias("start"), (F.col("start") + F.col("s") + window).alias("end")).alias("span"))
    return whole.union(part).groupBy("row_key").agg(F.collect_set("span").alias("spans"))


def reduced(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of (doc_id, text); ``kept``: kept words joined by spaces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part["text"], part["spans"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                out, reach = [], 0
                for start, end in sorted((x["start"], x["end"]) for x in spans) if spans is not None else ():
                    out += words[reach:start]
                    reach = max(reach, end)
                out += words[reach:]
                n_removed.append(len(words) - len(out))
                kept.append(b" ".join(out).decode("utf-8", "surrogatepass"))
            yield part[["doc_id"]].assign(n_words=n_words, n_removed=n_removed, kept=kept)

    rows = _rows(docs).join(removed_spans(docs, window, anchor), "row_key", "left").select("doc_id", "text", "spans")
    return rows.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string")


def substring_report(docs: DataFrame) -> DataFrame:
    return reduced(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
