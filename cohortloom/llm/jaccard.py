"""N-gram Jaccard join with Bayesian pruning of candidate pairs.

Texts are sets of 5-word shingles (A-Z lower-cased; a shorter text is one shingle of all its words); two
texts are linked where the Jaccard similarity of their sets is 0.8 or more.

1. Each text gets K MinHash values and a 128-bit digest of its words. Texts with one digest are copies and
   are represented once.
2. Texts that agree in a band of ROWS values are candidates. At similarity 0.8 a pair is in none of the
   bands with a chance of 3 in a million.
3. Candidates are compared STEP values at a time; a pair goes as soon as the posterior probability, given
   the matches so far, that its similarity reaches the threshold is below TOLERANCE. What is left connects
   texts into neighbourhoods.
4. Within each neighbourhood the pairs that survive the same comparison are verified on their whole
   shingle sets. Verified links are counted for each text and connect the classes.

Groups are never written out as pairs: a task holds at most two blocks of a group, compares them as arrays,
and returns counts and one edge per text. Large groups are cut into blocks of bounded size, and each pair
of blocks is a task's work of its own.

Defined cases: a text without words (null, empty, white space) is a class of its own and has no links.
Repeated rows are copies of each other; so are rows that differ in doc_id only. A null doc_id is a row
like any other; a class is named by the least doc_id in it that is not null. A similarity of exactly the bound
is a link. Texts of any length give all their shingles. An empty table gives an empty table. Other columns are not
read by the report and kept by the stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.base import Words, bit_table, components, in_table, pieces, written

SHINGLE = 5
THRESHOLD = 0.8
K = 96
ROWS = 4
STEP = 16
TOLERANCE = 1e-6
# A block of a group: so many texts at most on average, and so many shingles.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1_000_000

_FACTOR = (np.random.default_rng(5).integers(0, 2**31, K, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
_SHIFT = np.random.default_rng(6).integers(0, 2**32, K, dtype=np.uint32)


# --- sketches


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; texts with fewer words have one shingle, those without none."""
    first, value = words.windows(SHINGLE)
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    text = np.concatenate([words.text[first], short])
    value = np.concatenate([value, words.whole()[short]])
    order = np.argsort(text, kind="stable")
    return text[order], value[order]


def minhashes(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """K least values of each text's shingles under K permutations of 32-bit hashes."""
    out = np.full((n, K), np.uint32(2**32 - 1))
    if len(text):
        head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        low = (value >> np.uint64(32)).astype(np.uint32)
        for k in range(K):
            out[text[head], k] = np.minimum.reduceat((low ^ _SHIFT[k]) * _FACTOR[k], head)
    return out


def _folded(texts: list[str | None]) -> list[bytes]:
    """A-Z lower-cased, as UTF-8."""
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def _sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in pieces(frames):
        texts = _folded(part["text"].tolist())
        words = Words(texts)
        signature = minhashes(*shingles(words), len(part))
        digest = [blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
        yield part[["row_key", "doc_id"]].assign(digest=digest, n_words=words.count, signature=[s.tobytes() for s in signature])


def _bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            keys = _band_keys(np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(-1, K))
            yield pd.DataFrame({"id": np.repeat(frame["id"].to_numpy(), keys.shape[1]), "key": keys.ravel().view(np.int64)})


def _band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), K // ROWS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(K // ROWS, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        key = (key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


# --- pruning and verification of pairs, on arrays


@lru_cache(maxsize=4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """Fewest matches in the first STEP, 2 STEP ... values that keep a pair.

    Posterior of similarity s given m matches of n, from a uniform prior: the chance that a Beta(m + 1,
    n - m + 1) variable is ``threshold`` or more, which is a sum of binomial terms.
    """
    out = []
    for n in range(STEP, K + 1, STEP):
        for m in range(n + 1):
            chance = sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
            if chance >= tolerance:
                out.append(m)
                break
    return tuple(out)


def surviving_pairs(group: np.ndarray, side: np.ndarray, cross: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that outlive the comparison. Rows of a group stand together; where
    ``cross`` is set only rows of different sides are compared."""
    least = least_matches()
    size = int(np.bincount(group).max()) if len(group) else 0
    left, right = [], []
    for gap in range(1, size):
        i = np.flatnonzero(group[gap:] == group[:-gap])
        i = i[~cross[i] | (side[i] != side[i + gap])]
        matches = np.zeros(len(i), np.int64)
        for step, need in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            matches += (signature[i, part] == signature[i + gap, part]).sum(1)
            keep = matches >= need
            i, matches = i[keep], matches[keep]
            if not len(i):
                break
        left.append(i)
        right.append(i + gap)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def verified(i: np.ndarray, j: np.ndarray, sets: dict[int, np.ndarray]) -> np.ndarray:
    """Whether the Jaccard similarity of sets i and j reaches THRESHOLD, by bit rows over the shared shingles."""
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(int(used.max()) + 1, np.int64)
    place[used] = np.arange(len(used))
    sizes = np.array([len(sets[k]) for k in used], np.int64)
    owner = np.repeat(np.arange(len(used)), sizes)
    _, where, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[where]
    keep = shared[where]
    owner, column, width = owner[keep], column[keep], int(shared.sum())
    both = np.zeros(len(i), np.int64)
    a, b = place[i], place[j]
    for at in range(0, width, 1 << 16):
        inside = (column >= at) & (column < at + (1 << 16))
        bits = np.zeros((len(used), min(width - at, 1 << 16)), bool)
        bits[owner[inside], column[inside] - at] = True
        rows = np.packbits(bits, axis=1)
        rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view(np.uint64)
        span = max(1, (1 << 21) // rows.shape[1])
        for k in range(0, len(i), span):
            both[k : k + span] += np.bitwise_count(rows[a[k : k + span]] & rows[b[k : k + span]]).sum(1).astype(np.int64)
    return both >= THRESHOLD * (sizes[a] + sizes[b] - both) - 1e-9


def join_up(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row that each of n rows is connected to by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups (key, i, j), from rows that come sorted by them."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        new = (frame["key"].ne(frame["key"].shift()) | frame["bi"].ne(frame["bi"].shift()) | frame["bj"].ne(frame["bj"].shift())).to_numpy()
        last = int(np.flatnonzero(new)[-1])
        rest = frame.iloc[last:]
        if last:
            yield frame.iloc[:last].assign(group=np.cumsum(new[:last]) - 1).reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.assign(group=0).reset_index(drop=True)


def _pairs_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    signature = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(-1, K)
    cross = (frame["bi"] != frame["bj"]).to_numpy()
    return surviving_pairs(frame["group"].to_numpy(), frame["block"].to_numpy(), cross, signature)


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges from texts to the first text of their group that they are connected to."""
    for frame in _whole_groups(frames):
        label = join_up(len(frame), *_pairs_of(frame))
        tied = np.flatnonzero(label != np.arange(len(frame)))
        ids = frame["id"].to_numpy()
        yield pd.DataFrame({"a": ids[tied], "b": ids[label[tied]]})


def _sets(frame: pd.DataFrame, used: np.ndarray) -> dict[int, np.ndarray]:
    """Shingle sets of the rows in use, made from a bounded stretch of text at a time."""
    sets: dict[int, np.ndarray] = {}
    for part in pieces(iter([frame.iloc[used][["text"]].assign(row=used)])):
        text, value = shingles(Words(_folded(part["text"].tolist())))
        cuts = np.searchsorted(text, np.arange(len(part) + 1))
        sets |= {row: np.unique(value[a:b]) for row, a, b in zip(part["row"].tolist(), cuts, cuts[1:], strict=False)}
    return sets


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each text of a pair of blocks: linked documents (copies counted), and an edge to its class."""
    for frame in _whole_groups(frames):
        i, j = _pairs_of(frame)
        sets = _sets(frame, np.unique(np.concatenate([i, j])))
        good = np.zeros(len(i), bool)
        group = frame["group"].to_numpy()
        for g in np.unique(group[i]):
            own = np.flatnonzero(group[i] == g)
            good[own] = verified(i[own], j[own], sets)
        i, j = i[good], j[good]
        copies = frame["n_copies"].to_numpy()
        n = np.bincount(i, weights=copies[j], minlength=len(frame)) + np.bincount(j, weights=copies[i], minlength=len(frame))
        seen = np.flatnonzero(n > 0)
        ids = frame["id"].to_numpy()
        yield pd.DataFrame({"a": ids[seen], "b": ids[join_up(len(frame), i, j)[seen]], "n": n[seen].astype(np.int64)})


def _in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of (key, id, ...) once for each pair of blocks of their group that holds their own block."""
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))))
    dealt = dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "n_blocks")
    return dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id")


# --- the join


def classes(docs: DataFrame) -> DataFrame:
    """(row_key, id, copy_id, n_copies, class_id, n_links): one row for each different (doc_id, text).

    ``id`` is the least row key among the copies of a text, ``copy_id`` the least doc_id among them,
    ``class_id`` the least doc_id of the connected class, ``n_links`` the documents linked to it.
    """
    rows = docs.select("doc_id", "text").select("*", F.xxhash64("doc_id", "text").alias("row_key"))
    sketch = written(rows.mapInPandas(_sketch, "row_key long, doc_id long, digest binary, n_words long, signature binary"))
    # A text without words is a class of its own: its row key tells it from the others.
    alone = F.concat(F.lit("row ").cast("binary"), F.col("row_key").cast("string").cast("binary"))
    keyed = sketch.select("doc_id", "row_key", F.when(F.col("n_words") > 0, F.col("digest")).otherwise(alone).alias("digest"))
    copies = written(keyed.groupBy("digest").agg(F.min("row_key").alias("id"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies")))
    heads = copies.select(F.col("id").alias("row_key"), "n_copies")
    texts = sketch.where("n_words > 0").drop("doc_id", "digest").join(heads, "row_key").dropDuplicates(["row_key"])
    sketch = written(texts.withColumnRenamed("row_key", "id"))

    banded = sketch.select("id", "signature").mapInPandas(_bands, "id long, key long")
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = crowded.select("key", F.ceil(F.col("n") / BLOCK_TEXTS).alias("n_blocks"))
    near = written(banded.join(crowded, "key"))
    near_rows = near.select("key", "id").join(sketch.select("id", "signature"), "id")
    near_sizes = near.select("key", "n_blocks").distinct()
    edges = _in_blocks(near_rows, near_sizes).mapInPandas(_neighbours, "a long, b long")
    hoods = written(components(edges))

    members = hoods.select("id", F.col("label").alias("key")).join(sketch.select("id", "signature", "n_words", "n_copies"), "id")
    members = written(members)
    sizes = members.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_words") / BLOCK_SHINGLES)).alias("n_blocks"))
    # Most documents have no neighbour: a bit table of fixed size keeps their texts out of the shuffle.
    wanted = members.select(F.col("id").alias("row_key"))
    maybe = rows.where(in_table(bit_table(wanted.select(F.col("row_key").alias("key"))), F.col("row_key")))
    texts = maybe.join(wanted, "row_key", "left_semi").dropDuplicates(["row_key"]).select(F.col("row_key").alias("id"), "text")
    found = _in_blocks(members.select("key", "id", "signature", "n_copies").join(texts, "id"), sizes).mapInPandas(_links, "a long, b long, n long")
    found = written(found)
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    labels = components(found.select("a", "b"))

    named = copies.join(labels, "id", "left").join(links, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = written(named.select("digest", "id", "label", "copy_id", "n_copies", (F.coalesce("n", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")))
    heads = named.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    return keyed.join(named.join(heads, "label"), "digest").select("row_key", "doc_id", "id", "label", "copy_id", "n_copies", "class_id", "n_links")


def jaccard_report(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_id, n_copies, n_links), one row for every row of (doc_id, text).

    ``n_links`` counts the other documents whose similarity is 0.8 or more, copies among them.
    """
    return classes(docs).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each class: the one of the least (doc_id, row key)."""
    kept = classes(docs).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    kept = kept.select(F.col("first.row_key").alias("_key"))
    cols = docs.columns
    rows = docs.select(F.struct(*cols).alias("_row"), F.xxhash64("doc_id", "text").alias("_key"))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
