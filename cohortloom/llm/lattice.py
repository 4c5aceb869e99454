"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text's segmentations form a lattice: nodes are the places between characters, edges are pieces. Forward
filtering sums the weights of all paths up to each node; backward sampling walks from the end and draws
each last piece in proportion. The draws come from a counter-based hash of the row's key, so a row gives
the same segmentation wherever and however often it is computed.

Pieces hold the space mark only at their start and no line feed, so a text is cut into units (marks and
the word after them, or one line feed) and the lattice of a text is the chain of its units' lattices.
Unlike units of a batch are filtered once, together.

Text form: a leading mark is put before every text that has characters (as the model expects) and taken
away by decoding; a space is the mark; the mark itself, and any character without a piece, is written as
the pieces of its UTF-8 bytes. Decoding therefore gives every text back exactly.

Defined cases: a null text has null pieces and decodes to null; an empty one has no pieces. Repeated rows
have the same key and so the same pieces. Draws never tie: a path is chosen by intervals of the unit line. Texts
of any length are cut into pieces that join without loss. An empty table gives an empty table. Other columns are kept,
but for those that the caller names for the results: a column of the input of such a name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.base import mix, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Weight of a piece of merge rank r (the model's scores are -r): (1 + r) ** -SHARPNESS. 0 makes all
# segmentations equal; large values approach the segmentation into the most frequent pieces.
SHARPNESS = 1.0
SLOT_BITS = 20
# Characters whose lattices are filtered together; edges take some 140 bytes a character of new units.
BATCH_CHARS = 300_000
# A byte piece stands for a character that has none; its weight does not matter, as no path avoids it.
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Model:
    """The piece table of a SentencePiece model file, as arrays and one dictionary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = [b""] * n
        weights = np.zeros(n)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(MARK, " ").encode()
                # The mark on its own is a piece; elsewhere a piece holds it at its start only.
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    continue
                self.ids[piece] = i
                weights[i] = -SHARPNESS * np.log1p(max(0.0, -model.get_score(i)) if model.get_score(i) > -1e8 else n)
        self.weight = weights
        self.longest = max(map(len, self.ids), default=1)
        # Substrings are looked up by a 64-bit hash in a table of two entries a slot; the seed is the first
        # that leaves no slot with more.
        own = list(self.ids)
        ids = np.array([self.ids[p] for p in own], np.int32)
        for seed in range(1, 1000):
            key = np.array([_hash(p, seed) for p in own], np.uint64)
            slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(np.diff(slot[order], prepend=-1) != 0, np.arange(len(order)), 0))
            if len(order) == 0 or (nth.max() < 2 and len(np.unique(key)) == len(key)):
                break
        self.seed = seed
        self.slots = np.full((2, 1 << SLOT_BITS), -1, np.int32)
        self.slots[nth, slot[order]] = ids[order]
        self.key = np.zeros(n, np.uint64)
        self.key[ids] = key


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str, seed: int) -> np.uint64:
    """The hash of a piece, as the lattices make it: letter by letter."""
    value = seed
    for c in text:
        value = ((value ^ (value >> 29)) * int(_STEP) + ord(c) + 1) % 2**64
    return np.uint64(value * int(_STEP) % 2**64)


@lru_cache(maxsize=2)
def model(path: str = MODEL) -> Model:
    """The model of this process; workers load it once each."""
    return Model(path)


class Lattices:
    """Filtered lattices of many units: for each node its incoming edges with cumulative probabilities.

    Node ``first[u] + k`` is the place after k characters of unit u. Edges are sorted by their end node;
    ``edge_cum`` is the cumulative probability within the node, where edges start at ``first_edge``.
    """

    def __init__(self, units: list[str], m: Model):
        sizes = np.array([len(u) for u in units], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(units) else np.zeros(0, np.int64)
        self.sizes = sizes
        letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(units)), sizes)
        left = ends[owner] - np.arange(len(letters))  # characters from here to the unit's end
        # Edges are the most of what a batch holds: nodes and pieces are 32-bit numbers, and what is done with is dropped.
        node = (np.arange(len(letters)) + owner).astype(np.int32)  # node before this character
        starts, stops, ids = [], [], []
        single = np.zeros(len(letters), bool)
        at, value = np.arange(len(letters)), np.full(len(letters), m.seed, np.uint64)
        wide = letters.astype(np.uint64) + np.uint64(1)
        for length in range(1, m.longest + 1):
            inside = left[at] >= length
            at, value = at[inside], value[inside]
            value = (value ^ (value >> np.uint64(29))) * _STEP + wide[at + (length - 1)]
            key = value * _STEP
            slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            for table in m.slots:
                got = table[slot]
                hit = np.flatnonzero(got >= 0)
                hit = hit[m.key[got[hit]] == key[hit]]
                if len(hit):
                    if length == 1:
                        single[at[hit]] = True
                    starts.append(node[at[hit]])
                    stops.append(node[at[hit]] + length)
                    ids.append(got[hit])
        # Characters without a piece: one edge, id -1, written as bytes.
        bare = np.flatnonzero(~single)
        starts.append(node[bare])
        stops.append(node[bare] + 1)
        ids.append(np.full(len(bare), -1, np.int32))
        del at, value, wide, owner, left, node, single
        self.stop = np.concatenate(stops)
        order = np.argsort(self.stop, kind="stable")
        self.stop = self.stop[order]
        self.start = np.concatenate(starts)[order]
        self.piece = np.concatenate(ids)[order]
        del starts, stops, ids, order
        self.letters = letters
        self._filter(m, len(letters) + len(units))

    def _filter(self, m: Model, n_nodes: int) -> None:
        """Forward sums, scaled by unit: all nodes at the same place of their units go together."""
        weight = np.where(self.piece >= 0, m.weight[np.maximum(self.piece, 0)], 0.0)
        forward = np.full(n_nodes, -np.inf)
        forward[self.first] = 0.0
        place = np.zeros(n_nodes, np.int64)
        place[self.first] = 1
        place = np.arange(n_nodes) - np.maximum.accumulate(np.where(place == 1, np.arange(n_nodes), 0))
        of_edge = place[self.stop]
        of_edge = of_edge.astype(np.uint16) if place.max(initial=0) < 1 << 16 else of_edge
        by_place = np.argsort(of_edge, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(of_edge)[1:])]) if len(of_edge) else np.zeros(1, np.int64)
        edge_value = np.empty(len(self.start))
        for k in range(len(bounds) - 1):
            edges = by_place[bounds[k] : bounds[k + 1]]
            if not len(edges):
                continue
            value = forward[self.start[edges]] + weight[edges]
            stop = self.stop[edges]  # ascending, as the sort is stable
            head = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]]))
            high = np.maximum.reduceat(value, head)
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(edges))))
            share = np.exp(value - high[group])
            total = np.add.reduceat(share, head)
            forward[stop[head]] = high + np.log(total)
            edge_value[edges] = share / total[group]
        del weight, of_edge, by_place
        running = np.cumsum(edge_value)
        head = np.concatenate([[True], self.stop[1:] != self.stop[:-1]]) if len(self.stop) else np.zeros(0, bool)
        base = np.subtract(running, edge_value, out=edge_value)
        base[~head] = 0.0
        np.maximum.accumulate(base, out=base)
        running -= base
        cum = np.minimum(running, 1.0, out=running)
        last = np.concatenate([head[1:], [True]]) if len(head) else head
        cum[last] = 1.0
        # A node draws its first edge whose cumulative probability exceeds the draw; the last one's is 1.
        cum[last] = 2.0
        self.edge_cum = cum
        self.first_edge = np.zeros(n_nodes, np.int64)
        self.first_edge[self.stop[head]] = np.flatnonzero(head)

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A drawn path for each occurrence (unit, key): (occurrence, edge, step), last pieces first."""
        live = np.arange(len(unit))
        node = self.first[unit] + self.sizes[unit]
        out_live, out_edge, out_step, step = [], [], [], 0
        while len(live):
            draw = (mix(key[live] + np.uint64(step * 0xD1B54A32D192ED03 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first_edge[node]
            on = np.flatnonzero(self.edge_cum[edge] <= draw)
            while len(on):
                edge[on] += 1
                on = on[self.edge_cum[edge[on]] <= draw[on]]
            out_live.append(live)
            out_edge.append(edge)
            out_step.append(np.full(len(live), step))
            node = self.start[edge]
            rest = node != self.first[unit[live]]
            live, node, step = live[rest], node[rest], step + 1
        if not out_live:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(out_live), np.concatenate(out_edge), np.concatenate(out_step)


def _form(text: str) -> str:
    """The text with a leading mark; spaces become marks, and marks a character that has no piece."""
    return MARK + text.replace(MARK, "\x00").replace(" ", MARK) if text else ""


def encode_batch(texts: list[str | None], keys: np.ndarray, m: Model) -> list[np.ndarray | None]:
    """Sampled piece ids of each text. ``\\x00`` and the mark have no piece of their own, so both are
    written as bytes; which of them it was is read from the text."""
    kinds: dict[str, int] = {}
    units, counts = [], []
    for text in texts:
        own = _UNIT.findall(_form(text)) if text else []
        counts.append(len(own))
        units += [kinds.setdefault(u, len(kinds)) for u in own]
    unit, count = np.array(units, np.int64), np.array(counts, np.int64)
    lattices = Lattices(list(kinds), m)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(texts) else count
    within = np.arange(len(unit)) - first[owner]
    key = mix(keys[owner] ^ mix(within.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))) if len(unit) else np.zeros(0, np.uint64)
    occurrence, edge, step = lattices.sample(unit, key)
    # Step 0 drew the last piece of an occurrence, step 1 the one before, and so on.
    spot = np.cumsum(np.bincount(occurrence, minlength=len(unit)))[occurrence] - 1 - step if len(occurrence) else occurrence
    placed = np.empty_like(edge)
    placed[spot] = edge
    occurrence, edge = np.repeat(np.arange(len(unit)), np.bincount(occurrence, minlength=len(unit))), placed
    ids = lattices.piece[edge]
    bare = np.flatnonzero(ids < 0)
    text_of = owner[occurrence] if len(occurrence) else occurrence
    per_text = np.bincount(text_of, minlength=len(texts))
    if len(bare):
        ids, per_text = _with_bytes(lattices, ids, edge, bare, text_of, texts, m)
    stops = np.cumsum(per_text)
    ids = ids.astype(np.int32)
    return [None if t is None else ids[stop - n : stop] for t, stop, n in zip(texts, stops, per_text, strict=True)]


def _with_bytes(lattices: Lattices, ids, edge, bare, text_of, texts, m: Model):
    """Puts byte pieces in the place of characters that have none."""
    letter = lattices.letters[lattices.start[edge[bare]] - np.searchsorted(lattices.first, lattices.start[edge[bare]], "right") + 1]
    forms = {c: m.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] for c in np.unique(letter).tolist()}
    mark = m.byte_id[list(MARK.encode())]
    # For \x00 the text says whether it was one, or the mark: both in the order of their places.
    zeros = {}
    replaced = []
    for at, c in zip(bare.tolist(), letter.tolist(), strict=True):
        if c == 0:
            owner = int(text_of[at])
            if owner not in zeros:
                zeros[owner] = iter([x for x in texts[owner] if x in ("\x00", MARK)])
            replaced.append(mark if next(zeros[owner]) == MARK else forms[c])
        else:
            replaced.append(forms[c])
    width = np.ones(len(ids), np.int64)
    width[bare] = [len(x) for x in replaced]
    out = np.repeat(ids, width)
    out[np.repeat(ids, width) < 0] = np.concatenate(replaced)
    return out, np.bincount(text_of, weights=width, minlength=len(texts)).astype(np.int64)


def decode_ids(ids: np.ndarray, m: Model) -> str:
    """The text of piece ids: their bytes in a row, without the leading space."""
    return b"".join(map(m.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:] if len(ids) else ""


_ENCODED = "struct<ids:array<int>,n_pieces:bigint,lossless:boolean>"


def encode(docs: DataFrame, key: str, text: str = "text", path: str = MODEL) -> DataFrame:
    """The columns of ``docs`` and the sampled piece ids, their number, and whether they decode to the text.

    ``key`` names the 64-bit row key that seeds the draws. Columns of these names in ``docs`` are replaced.
    """

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = model(path)
        # Results leave piece by piece, so that a batch's ids never stand in memory together.
        for part in pieces((pd.DataFrame({"key": keys, "text": texts}) for keys, texts in frames), limit=BATCH_CHARS):
            own = part["text"].tolist()
            ids = encode_batch(own, mix(part["key"].to_numpy(np.int64).view(np.uint64)), m)
            same = [x is None if t is None else decode_ids(x.tolist(), m) == t for t, x in zip(own, ids, strict=True)]
            yield pd.DataFrame({"ids": ids, "n_pieces": [0 if x is None else len(x) for x in ids], "lossless": same})

    keep = [c for c in docs.columns if c not in ("ids", "n_pieces", "lossless")]
    return docs.withColumn("_encoded", F.pandas_udf(run, _ENCODED)(F.col(key), F.col(text))).select(*keep, "_encoded.*")


def decode(encoded: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """All columns of ``encoded`` and the decoded text as ``decoded``."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for series in frames:
            yield pd.Series([None if x is None else decode_ids(np.asarray(x).tolist(), m) for x in series], dtype=object)

    return encoded.withColumn("decoded", F.pandas_udf(run, "string")(F.col(ids)))


def sampled_report(docs: DataFrame) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless) for every row of (doc_id, text); the key is the id and the text."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_seed"))
    return encode(rows, "_seed").select("doc_id", "ids", "n_pieces", "lossless")


def tokenised(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the sampled pieces of ``text``."""
    return encode(docs.withColumn("_seed", F.xxhash64("doc_id", "text")), "_seed").drop("_seed")
