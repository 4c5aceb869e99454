"""Centroids, personal data and fill-in-the-middle against plain re-implementations, random models and held-out lines."""

import itertools
import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import centroids, fill_middle, personal

SF = "/root/testdata/sf0.001"
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")

# --- fill-in-the-middle


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["", " ", " a", "a ", "a b", "\n\n", "<P> a <M>", *("".join(rng.choices("ab1Z.é\U0001f600\x00\x85　  \n\t\x0b\x1f", k=rng.randrange(200))) for _ in range(n))]


def test_wavelet_ranks():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 16, n).astype(np.uint8)
        matrix, at = fill_middle.WaveletMatrix(symbols), np.arange(n + 1)
        for s in range(16):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]


def test_units_and_their_ends():
    texts, rng = odd_texts(200), random.Random(2)
    for unit, cut in (("word", TOKEN.findall), ("line", lambda t: re.findall(r"(?s)[^\n]*\n|[^\n]+\Z", t))):
        n, places = fill_middle.boundaries(texts, unit)
        assert n.tolist() == [len(cut(t)) for t in texts]
        for _ in range(5):
            wanted = np.array([rng.randrange(k + 1) for k in n.tolist()])
            assert places(wanted).tolist() == [len("".join(cut(t)[:k])) for t, k in zip(texts, wanted.tolist(), strict=True)]


@pytest.mark.parametrize("piece", [50, 2_000_000])
def test_cuts(spark, monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "PIECE_CHARS", piece)
    texts = odd_texts(150, 3)
    rows = [(None, None), *enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("kept"))
    out = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("fim.output"), F.col("fim.form")))
    forms = set()
    for r in out.collect():
        text, key = r["text"] or "", "" if r["doc_id"] is None else str(r["doc_id"])
        cut, digest = TOKEN.findall(text), sha256(f"42:{key}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        one, two = sorted((h[0] % (len(cut) + 1), h[1] % (len(cut) + 1)))
        p, m, s = "".join(cut[:one]), "".join(cut[one:two]), "".join(cut[two:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["fim"]["n"], r["fim"]["form"], r["fim"]["output"], r["back"], r["n"]) == (len(cut), form, want, text, "kept")
        assert (r["fim"]["prefix_chars"], r["fim"]["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


# --- centroids


def plain_nearest(x, c):
    distance = np.square(x[:, None, :].astype(object) - c[None].astype(object)).sum(axis=2)
    return [int(min(range(len(c)), key=lambda k: (row[k], k))) for row in distance], [int(min(row)) for row in distance]


@pytest.mark.parametrize("lead", [1, 5, 12])
def test_filter_keeps_the_nearest(lead):
    rng = np.random.default_rng(lead)
    base = rng.integers(-40, 40, (6, 12))
    x = np.concatenate([base[rng.integers(0, 6, 300)] + rng.integers(-3, 4, (300, 12)), base, np.zeros((5, 12), int), np.full((2, 12), 2**27), np.full((1, 12), -(2**27))])
    c = np.concatenate([base, base[:2], x[:4], x[-2:]])  # ties: equal centroids
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T))
    rotation = centroids.Rotation(mean, axes[:, ::-1], lead)
    cluster, distance, compared = centroids.nearest(x, *rotation.apply(x.astype(float)), c, rotation)
    want, far = plain_nearest(x, c)
    assert (cluster.tolist(), distance.tolist()) == (want, far)
    assert compared <= len(x) * len(c)


def test_rotation_and_filter(spark):
    """Axes of falling variance from sums of all vectors; of vectors in groups most centroids are dropped unseen."""
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = np.array([r["x"] for r in centroids.integer_vectors(frame, "vec_id", "embedding").collect()])
    rotation = centroids.rotation_of(centroids.integer_vectors(frame, "vec_id", "embedding"))
    want = np.cov(x.T, bias=True)
    assert np.allclose(rotation.axes.T @ rotation.axes, np.eye(64), atol=1e-9) and np.allclose(rotation.mean, x.mean(axis=0))
    spread = np.diag(rotation.axes.T @ want @ rotation.axes)
    assert np.all(np.diff(spread) <= 1e-6)
    rng = np.random.default_rng(2)
    centers = rng.integers(-60, 60, (16, 64))
    own = rng.integers(0, 16, 400)
    near = centers[own] + rng.integers(-3, 4, (400, 64))
    _, axes = np.linalg.eigh(np.cov(near.T))
    turned = centroids.Rotation(near.mean(axis=0), axes[:, ::-1], centroids.LEAD)
    cluster, _, compared = centroids.nearest(near, *turned.apply(near.astype(float)), centers, turned)
    assert cluster.tolist() == own.tolist() and compared < 1.1 * len(near)


def test_clusters(spark):
    """All rounds against plain ones: few vectors, repeated rows, negative means, an empty cluster."""
    rng = np.random.default_rng(9)
    for n, k in ((3, 16), (40, 4), (200, 16)):
        vectors = (rng.integers(-5, 6, (n, 8)) / 16).tolist()
        rows = [*enumerate(vectors), (0, vectors[0]), (n, vectors[0])]
        frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
        labels, got = centroids.centroid_clusters(frame, "id", "v", dims=8, k=k, lead=3)
        x = np.array([[int(np.floor(64 * e)) for e in v] for _, v in rows])
        order = sorted(range(len(rows)), key=lambda i: (sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x[i].tolist()))
        c = x[order[:k]]
        for _ in range(3):
            own, _ = plain_nearest(x, c)
            c = np.array([[sum(x[i][j] for i in range(len(x)) if own[i] == q) // own.count(q) for j in range(8)] if q in own else c[q] for q in range(len(c))])
        own, far = plain_nearest(x, c)
        assert got.tolist() == c.tolist()
        assert sorted(map(tuple, labels.collect())) == sorted((rows[i][0], own[i], far[i]) for i in range(len(rows)))


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))] if kind == "card" else []
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), list(BASE).index(kind), m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans():
    rng = random.Random(6)
    seen = set()
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b.c", "@", "@x.y", ".", "_", "%", "-", " ", "1.2", "3.4.", "255.", "256.", "00", "4111 1111 1111 1111", "4111-1111", "7", "12", "+1 ", "+", "(984) 555", "-5227", "é", "\n"]) for _ in range(rng.randrange(1, 14)))
        got = personal.base_spans(text)
        assert got == plain_base(text), text
        seen |= {k for _, _, k in got}
    assert seen == set(BASE)


def random_field(seed):
    rng = np.random.default_rng(seed)
    words = ["\n", *"abcdefgh"]
    weights = {f"{o} shape {personal.shape(w)}": rng.normal(0, 1, len(personal.LABELS)).astype(np.float32) for o in personal.OFFSETS for w in words if w != "\n"}
    weights |= {f"{o} word {w}": rng.normal(0, 1, len(personal.LABELS)).astype(np.float32) - np.eye(len(personal.LABELS))[1:].sum(axis=0).astype(np.float32) * 0.4 for o in personal.OFFSETS for w in words}
    moves = np.where(personal.allowed_transitions(), rng.normal(0, 1, (len(personal.LABELS),) * 2), personal.NEVER).astype(np.float32)
    return personal.Field(frozenset(words), weights, moves)


def path_score(model, emission, path):
    both = [0, *path, 0]
    return sum(model.moves[a, b] for a, b in itertools.pairwise(both)) + sum(emission[t, y] for t, y in enumerate(path))


def test_viterbi_is_the_best_path():
    """Against all label paths of short lines, and stretches against whole lines."""
    rng = random.Random(4)
    for seed in range(12):
        model = random_field(seed)
        found = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))] for _ in range(12)]
        words = [w for line in found for w in [*line, "\n"]]
        labels = model.decode(words)
        at = 0
        for line in found:
            emission = np.zeros((len(line), len(personal.LABELS)))
            for t in range(len(line)):
                for i, o in enumerate(personal.OFFSETS):
                    if 0 <= t + o < len(line):
                        emission[t] += model.scores(line[t + o])[i]
            got = path_score(model, emission, labels[at : at + len(line)].tolist())
            best = max(path_score(model, emission, p) for p in itertools.product(range(len(personal.LABELS)), repeat=len(line)))
            assert got == pytest.approx(best, abs=1e-3)
            assert labels[at + len(line)] == 0
            at += len(line) + 1
        # Longer lines: the proven stretches give what decoding every line whole gives.
        words = [rng.choice(["a", "b", "c", "d", "e", "f", "g", "h", "\n"]) for _ in range(400)]
        emission, end = model.emissions(words)
        edge = np.concatenate([[-1], np.flatnonzero(end), [len(words)]])
        first, last = edge[:-1] + 1, edge[1:]
        whole = model.viterbi(emission, first[last > first], last[last > first])
        cut = model.decode(words)
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            assert path_score(model, emission[a:b], cut[a:b].tolist()) == pytest.approx(path_score(model, emission[a:b], whole[a:b].tolist()), abs=1e-3)


def test_likelihood_and_gradients():
    rng = np.random.default_rng(3)
    k, sizes = len(personal.LABELS), np.array([4, 1, 3])
    emission, gold = rng.normal(size=(3, 4, k)), np.zeros((3, 4), int)
    gold[0], gold[2, :3] = [1, 2, 0, 3], [0, 5, 6]
    moves = np.where(personal.allowed_transitions(), rng.normal(size=(k, k)), personal.NEVER)
    score, d_emission, d_moves = personal.likelihood(emission, sizes, moves, gold)

    class Plain:
        pass

    model = Plain()
    model.moves = moves
    want = 0.0
    for i, n in enumerate(sizes.tolist()):
        every = [path_score(model, emission[i], p) for p in itertools.product(range(k), repeat=n)]
        want += path_score(model, emission[i], gold[i, :n].tolist()) - np.logaddexp.reduce(every)
    assert score == pytest.approx(want, abs=1e-6)
    for _ in range(40):
        which, step = rng.random() < 0.5, 1e-5
        at = (int(rng.integers(3)), int(rng.integers(4)), int(rng.integers(k))) if which else (int(rng.integers(k)), int(rng.integers(k)))
        if not which and moves[at] == personal.NEVER:
            continue
        up, down = (emission if which else moves).copy(), (emission if which else moves).copy()
        up[at] += step
        down[at] -= step
        a, b = (personal.likelihood(x, sizes, moves, gold)[0] if which else personal.likelihood(emission, sizes, x, gold)[0] for x in (up, down))
        assert (d_emission if which else d_moves)[at] == pytest.approx((a - b) / (2 * step), abs=1e-4)


# Lines that are not in the table; most of their values and some of their wordings are new.
HELD_OUT = """My name is [person Walter Schmidt] and I live at [street 17 Elm Street].
Dear Mrs. [person Helen Fox], thanks.
Patient: [person Omar Aziz], born [birth 03.04.1966]
Passport number: [number N7734512]
Mein Name ist [person Heidi Klamm].
Wohnhaft: [street Parkstraße 12]
Please contact [person John Smith] at once
SSN [number 321-45-9876]
Je m'appelle [person Jean Valier]
Me llamo [person Pablo Ruiz] y vivo en [street Calle Larga 4].
He was born on [birth 5 May 1955].
IBAN: [number DE44500105175407324931]
Date of birth: [birth 1977-02-03]
Sehr geehrte Frau [person Ursula Behrens],
Nombre: [person Lucía Ferrer]
Adresse: [street 21 Rue Basse]
numéro de passeport [number K5561209]
Signed by Dr. [person Amir Khan] on behalf of us
Fecha de nacimiento: [birth 11/02/1969]
The name of the game is Chess.
On 12 May 2020 the Old Committee met.
The ship left at 12 and New Harbour was empty.
Tionth An Erelhe 44 of the Thand.
DE LA THAND!! ERE!! NAME OF THE THAND
Am 3. Mai 2020 ging das Schiff ab.""".split("\n")


def test_field_on_held_out_lines():
    model = personal.default_field()
    texts, want = [], []
    for line in HELD_OUT:
        spans, text = [], ""
        for part in re.split(r"(\[[^\]]*\])", line):
            if part.startswith("["):
                kind, value = part[1:-1].split(" ", 1)
                spans.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += part
        texts.append(text)
        want.append(spans)
    got = personal.field_spans(model, texts)
    right = sum(len(set(a) & set(b)) for a, b in zip(got, want, strict=True))
    assert right >= 0.9 * sum(map(len, want)) and sum(map(len, got)) - right <= 1
    # One text a line or all lines in one text: the same.
    whole = "\n".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)]).tolist()
    assert personal.field_spans(model, [whole])[0] == [(a + s, b + s, k) for s, own in zip(starts, got) for a, b, k in own]
    documents = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    assert sum(map(len, personal.field_spans(model, documents))) == 0


def test_personal_spans(spark, monkeypatch):
    """Base spans stay, spans of the field that overlap them go; chunks of long texts change nothing."""
    model = personal.default_field()
    texts = [None, "", "é 1.2.3.4 and a.b@c.de\nMy name is Walter Schmidt.\n" * 30, "Passport number: 4111111111111111", "My name is Walter Schmidt, call +1 (984) 555-5227"]
    wholes = list(personal.spans_of(model, [t or "" for t in texts]))
    monkeypatch.setattr(personal, "CHUNK_CHARS", 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("x")).repartition(2)
    rows = {r["doc_id"]: r for r in personal.personal_spans(docs, model=model).collect()}
    for i, (base, spans) in enumerate(wholes):
        assert [tuple(x) for x in rows[i]["personal"]["base"]] == base == plain_base(texts[i] or "")
        assert [tuple(x) for x in rows[i]["personal"]["spans"]] == spans and set(base) <= set(spans)
        assert rows[i]["spans"] == "x"
    assert [k for _, _, k in wholes[2][1]] == ["ip", "email", "person"] * 30
    assert [k for _, _, k in wholes[3][1]] == ["card"] and [k for _, _, k in wholes[4][1]] == ["person", "phone"]
