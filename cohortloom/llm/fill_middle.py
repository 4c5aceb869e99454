"""Fill-in-the-middle transformation: two cuts at token boundaries, found on a wavelet matrix over character classes.

Every character gets a symbol: its class (CLASSES) and whether it ends a run, that is, whether the next
character lies on the other side of the border between white space and the rest. A wavelet matrix over
the symbols of a batch of texts answers rank(symbol, position) in one step a level. A unit's boundaries
are the places of a few symbols (BOUNDARIES), so their count before a position is a sum of ranks, and
the place of the u-th boundary is found by bisection on that count, for all texts of a batch at once.
The texts lie one behind the other in the matrix; the ranks at a text's start are taken off.

All of a document's work is in its row: no shuffle, and a lost task repeats its rows only. Memory is that of
one Arrow batch and of one piece of about PIECE_CHARS characters (one text at least, whatever its length).

Defined cases: a null text counts as empty: no units, form plain, empty output. A text of white space only
is one unit. Texts that contain a marker stay plain, so that every output can be taken apart again. A null
id is drawn as an empty one. Repeated rows, or other rows of the same id, have the same draws. An empty
table gives an empty table. Other columns are kept; the result is one struct column, named by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values
SEED = 42
# Of 100 texts so many are transformed, and of 100 of these so many put the suffix first.
FIM_PERCENT, SPM_PERCENT = 50, 80
PIECE_CHARS = 2_000_000

# Character classes, in the order of their codes.
CLASSES = ("newline", "space", "lower", "upper", "digit", "mark", "control", "other")
WORD_CLASSES = ("lower", "upper", "digit", "mark", "control", "other")
ENDS = len(CLASSES)  # added to the class of a character that ends a run
LEVELS = 4
# Symbols whose places bound a unit: the last characters of words, or of lines.
BOUNDARIES = {
    "word": tuple(CLASSES.index(c) + ENDS for c in WORD_CLASSES),
    "line": (CLASSES.index("newline"), CLASSES.index("newline") + ENDS),
}
_CLASS_OF = np.full(129, CLASSES.index("control"), np.uint8)
for _low, _high, _class in (("\x21", "\x7e", "mark"), ("a", "z", "lower"), ("A", "Z", "upper"), ("0", "9", "digit"), ("\x09", "\x0d", "space"), ("\x20", "\x20", "space"), ("\n", "\n", "newline"), ("\x80", "\x80", "other")):
    _CLASS_OF[ord(_low) : ord(_high) + 1] = CLASSES.index(_class)


class WaveletMatrix:
    """Rank of any of 2 ** LEVELS symbols before any position, in one bit vector a level."""

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(LEVELS)):
            bit = (symbols >> level) & 1
            packed = np.zeros(len(symbols) // 64 + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``."""
        low, high = np.zeros_like(at), at
        for level in range(LEVELS):
            a, b = self._ones(level, low), self._ones(level, high)
            if symbol >> (LEVELS - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum((self.rank(s, at) for s in symbols), np.zeros_like(at))

    def place(self, symbols: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least position in low..high before which ``wanted`` boundaries stand; ``high`` if there are fewer."""
        low, high = low.copy(), high.copy()
        while np.any(low < high):
            mid = (low + high) // 2
            enough = self.count(symbols, mid) >= wanted
            open_ = low < high
            low, high = np.where(open_ & ~enough, mid + 1, low), np.where(open_ & enough, mid, high)
        return low


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all characters, one text behind the other, and where each text starts (with the end of all)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    classes = _CLASS_OF[np.minimum(points, 128)]
    blank = classes <= CLASSES.index("space")
    ends = np.ones(len(points), bool)
    ends[:-1] = blank[1:] != blank[:-1]
    ends[starts[1:][np.diff(starts) > 0] - 1] = True
    return classes + ENDS * ends.astype(np.uint8), starts


def boundaries(texts: list[str], unit: str = "word") -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The number of units of each text, and a function from a number of units of each text to the place, in its
    own characters, where they end. What stands behind the last boundary is a unit too."""
    symbols, starts = symbols_of(texts)
    matrix, marks = WaveletMatrix(symbols), BOUNDARIES[unit]
    first, end = starts[:-1], starts[1:]
    before = matrix.count(marks, first)
    inside = matrix.count(marks, end) - before
    # The last character bounds the last unit, or else there is a rest.
    rest = (end > first) & (matrix.count(marks, end) == matrix.count(marks, np.maximum(end - 1, first)))

    def places(units: np.ndarray) -> np.ndarray:
        return matrix.place(marks, before + units, first, end) - first

    return inside + rest, places


def _transformed(texts: list[str], draws: np.ndarray, unit: str, fim_percent: int, spm_percent: int) -> dict[str, list]:
    n, places = boundaries(texts, unit)
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    low, high = places(np.minimum(one, two)), places(np.maximum(one, two))
    out = {"n": n.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    for text, a, b, h3, h4 in zip(texts, low.tolist(), high.tolist(), draws[:, 2].tolist(), draws[:, 3].tolist()):
        plain = not text or h3 % 100 >= fim_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if plain:
            form, output = "plain", text
        elif h4 % 100 < spm_percent:
            form, output = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
        else:
            form, output = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
        out["form"].append(form)
        out["prefix_chars"].append(None if plain else a)
        out["middle_chars"].append(None if plain else b - a)
        out["output"].append(output)
    return out


RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws_of(row_id: Column, seed: int = SEED) -> Column:
    """Four numbers of 32 bits drawn for a row from the digest of the seed and its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, text: str = "text", row_id: str = "doc_id", name: str = "fim", unit: str = "word", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with a struct column ``name``: units, form, characters of prefix and middle, output text."""

    @F.pandas_udf(RESULT)
    def transform(texts: pd.Series, draws: pd.Series) -> pd.DataFrame:
        whole = [t if t is not None else "" for t in texts]
        piece = np.cumsum([len(t) for t in whole]) // PIECE_CHARS
        parts = []
        for at in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(piece)) + 1):
            if len(at):
                drawn = np.array([draws.iat[i] for i in at], np.int64)
                parts.append(pd.DataFrame(_transformed([whole[i] for i in at], drawn, unit, fim_percent, spm_percent)))
        frame = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(_transformed([], np.zeros((0, 4), np.int64), unit, fim_percent, spm_percent))
        return frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.withColumn(name, transform(F.col(text), draws_of(F.col(row_id), seed)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of. No text holds a marker, so each marker is where it was put."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    front = F.call_function("substring_index", head, second, F.lit(1))
    back = F.call_function("substring_index", head, second, F.lit(-1))
    front = F.substring(front, len(PREFIX) + 1, 2**31 - 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(front, middle, back)).otherwise(F.concat(back, middle, front))


def fim_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of (doc_id, text), with digests of the outputs and of the texts rebuilt."""
    out = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
