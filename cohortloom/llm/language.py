"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample: from each language
the SAMPLE_DOCS documents of least key hash, and SEGMENTS byte runs spread over each whole text. It then
labels every byte position of every text; the mean of the positions' probabilities is the document's.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if there is
nothing to learn from. Rows whose held-out remainder is unknown (null doc_id) are never learned from.
Repeated rows are labelled alike, each on its own row. Equal probabilities go to the label that sorts first. Every
position of a text counts, whatever its length. An empty table gives an empty table. Only doc_id, text and, for
learning, lang are read; the stage keeps all other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
FOLDS = 5
SAMPLE_DOCS = 120
SEGMENTS = 8
LENGTH = 64  # characters of a training segment, and its byte positions
HIDDEN = 8
STEPS = 260
BATCH = 192
RATE = 0.02
CHUNK = 128  # bytes of one lane when labelling; texts are cut into lanes, whole
LANES = 8192


class Network:
    """Two gated recurrent passes over bytes and a linear read-out; arrays only, so it can be shipped."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, n = labels, len(labels)
        self.weights = {}
        for way in ("f", "b"):
            self.weights[f"x{way}"] = (rng.standard_normal((256, 3 * HIDDEN)) * 0.3).astype(np.float32)
            self.weights[f"u{way}"] = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / HIDDEN**0.5).astype(np.float32)
            self.weights[f"o{way}"] = (rng.standard_normal((HIDDEN, n)) * 0.3).astype(np.float32)
        self.weights["c"] = np.zeros(n, np.float32)

    # --- learning: rows are segments

    def _run(self, codes: np.ndarray, way: str):
        w, u = self.weights[f"x{way}"], self.weights[f"u{way}"]
        state, trace = np.zeros((len(codes), HIDDEN), np.float32), []
        order = range(codes.shape[1]) if way == "f" else range(codes.shape[1] - 1, -1, -1)
        for t in order:
            x, a = w[codes[:, t]], state @ u
            gate = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]))
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            before, state = state, new + z * (state - new)
            trace.append((t, before, z, r, new, a[:, 2 * HIDDEN :], state))
        return trace

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over all positions of the segments, by backpropagation through time."""
        w, (rows, length) = self.weights, codes.shape
        traces = {way: self._run(codes, way) for way in "fb"}
        score = np.tile(w["c"], (length, rows, 1))
        for way in "fb":
            for t, *_, state in traces[way]:
                score[t] += state @ w[f"o{way}"]
        score -= score.max(2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(2, keepdims=True)
        loss = -float(np.log(p[:, np.arange(rows), target] + 1e-9).mean())
        p[:, np.arange(rows), target] -= 1
        p /= rows * length
        grads = {"c": p.sum((0, 1))}
        for way in "fb":
            u, out = w[f"u{way}"], w[f"o{way}"]
            gx, gu, go = np.zeros_like(w[f"x{way}"]), np.zeros_like(u), np.zeros_like(out)
            carry = np.zeros((rows, HIDDEN), np.float32)
            for t, before, z, r, new, an, state in reversed(traces[way]):
                go += state.T @ p[t]
                d = carry + p[t] @ out.T
                dn = d * (1 - z) * (1 - new * new)
                dz = d * (before - new) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(gx, codes[:, t], np.concatenate([dz, dr, dn], 1))
                gu += before.T @ da
                carry = d * z + da @ u.T
            grads |= {f"x{way}": gx, f"u{way}": gu, f"o{way}": go}
        return loss, grads

    def fit(self, codes: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), min(BATCH, len(codes)))
            _, grads = self.gradients(codes[pick], target[pick])
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    # --- labelling: columns are lanes of CHUNK bytes

    def _scores(self, codes: np.ndarray, way: str, score: np.ndarray) -> None:
        w, u, out = (np.ascontiguousarray(self.weights[f"{k}{way}"].T) for k in "xuo")
        lanes, h2 = codes.shape[1], 2 * HIDDEN
        state = np.zeros((HIDDEN, lanes), np.float32)
        for t in range(len(codes)) if way == "f" else range(len(codes) - 1, -1, -1):
            x = np.take(w, codes[t], axis=1)
            a = u @ state
            gate = x[:h2]
            gate += a[:h2]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            new = a[h2:]
            new *= gate[HIDDEN:]
            new += x[h2:]
            np.tanh(new, out=new)
            state -= new
            state *= gate[:HIDDEN]
            state += new
            score[t] += out @ state

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities [position, label, lane] for codes [position, lane]."""
        score = np.empty((codes.shape[0], len(self.labels), codes.shape[1]), np.float32)
        score[:] = self.weights["c"][:, None]
        for way in "fb":
            self._scores(codes, way, score)
        score -= score.max(1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(1, keepdims=True)
        return score


def _codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def pooled(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities [text, label] over all byte positions of each text.

    Texts are laid into lanes of CHUNK bytes, the last one padded by spaces that do not count; lanes of
    several texts run side by side, LANES at a time.
    """
    total = np.zeros((len(texts), len(network.labels)))
    sizes = np.array([len(t) for t in texts], np.int64)
    n_lanes = -(-sizes // CHUNK)
    padded = b"".join(t + b" " * (int(n) * CHUNK - len(t)) for t, n in zip(texts, n_lanes, strict=True))
    codes = _codes(padded).reshape(-1, CHUNK)
    owner = np.repeat(np.arange(len(texts)), n_lanes)
    last = np.concatenate([[0], np.cumsum(n_lanes)[:-1]])
    real = np.minimum(CHUNK, sizes[owner] - (np.arange(len(owner)) - last[owner]) * CHUNK) if len(owner) else owner
    for at in range(0, len(codes), LANES):
        lanes = slice(at, at + LANES)
        p = network.positions(np.ascontiguousarray(codes[lanes].T))
        for i in np.flatnonzero(real[lanes] < CHUNK):
            p[real[lanes][i] :, :, i] = 0
        np.add.at(total, owner[lanes], p.sum(0).T)
    return total / np.maximum(sizes, 1)[:, None]


def held_out():
    """Whether a document is held out of learning: crc32 of its id as text, modulo FOLDS, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame) -> Network | None:
    """The network of a corpus, from the bounded sample; None where there is nothing to learn from."""
    rule = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0
    known = docs.select("doc_id", "text", "lang").where(rule & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    runs = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda i: F.substring(F.col("text"), (i * F.length("text") / SEGMENTS + 1).cast("int"), F.lit(LENGTH)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("runs"))
    sample = known.select("doc_id", "lang", runs.alias("runs")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_DOCS)
    rows = sorted((r["lang"], r["rank"], tuple(r["runs"])) for r in sample.select("lang", "rank", "runs").collect())
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    codes, target = [], []
    for lang, _, texts in rows:
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")[:LENGTH]
            if len(raw) >= LENGTH // 4:
                codes.append(_codes(raw.ljust(LENGTH)))
                target.append(labels.index(lang))
    if not codes:
        codes, target = [_codes(r[2][0].encode("utf-8", "surrogatepass")[:LENGTH].ljust(LENGTH)) for r in rows], [labels.index(r[0]) for r in rows]
    # Each language has the same weight, however many documents it has in the sample.
    by = [np.flatnonzero(np.array(target) == k) for k in range(len(labels))]
    most = max(len(x) for x in by)
    even = np.concatenate([np.resize(x, most) for x in by if len(x)])
    network = Network(labels)
    network.fit(np.array(codes)[even], np.array(target)[even])
    return network


def _labeller(network: Network):
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in frames:
            texts = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in series]
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            at = 0
            while at < len(texts):  # about one megabyte at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= LANES * CHUNK):
                    size += len(texts[to])
                    to += 1
                p = pooled(network, texts[at:to])
                best[at:to], score[at:to] = p.argmax(1), p.max(1)
                at = to
            yield pd.DataFrame({"lang": [network.labels[k] for k in best], "score": np.clip(score, 0, 1)})

    return run


def predict(docs: DataFrame, network: Network | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs``, and as ``lang`` and ``score`` the predicted language with its pooled probability."""
    if network is None:
        return docs.select("*", F.lit(UNKNOWN).alias(lang), F.lit(0.0).alias(score))
    label = F.pandas_udf(_labeller(network), "lang string, score double")
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.select("*", label(F.when(has_letter, F.col("text"))).alias("_label"), has_letter.alias("_letter"))
    return out.select(
        *docs.columns,
        F.when(F.col("_letter"), F.col("_label.lang")).otherwise(F.lit(UNKNOWN)).alias(lang),
        F.when(F.col("_letter"), F.col("_label.score")).otherwise(F.lit(0.0)).alias(score),
    )


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of (doc_id, text, lang)."""
    network = learn(docs)
    return predict(docs.select("doc_id", "text"), network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, min_score: float = 0.4) -> DataFrame:
    """The rows whose language is known: not ``und``, and with a pooled probability of ``min_score`` at least."""
    judged = predict(docs, learn(docs), "_lang_pred", "_score")
    return judged.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= min_score)).select(*docs.columns)
