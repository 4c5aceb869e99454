"""Vocabulary tagging and scale ranges against plain loops."""

import random
import re

from pyspark.sql import functions as F

from cohortloom.operators import scales, vocabulary


def plain_tags(text, terms):
    """{(canonical, slot): (mentions, negated)} by trying every term at every place."""
    cut = lambda t: re.findall(r"[^\W\d_]+|\d+|\S", t.lower())
    ts, found, at = cut(text), {}, 0
    while at < len(ts):
        hits = [(len(cut(t)), c, s) for t, c, s in terms if cut(t) and ts[at : at + len(cut(t))] == cut(t)]
        if not hits:
            at += 1
            continue
        size = max(h[0] for h in hits)
        before = ts[max(0, at - 8) : at]
        for k in range(len(before), 0, -1):
            if before[k - 1] in ".;!?":
                before = before[k:]
                break
        negated = bool({"no", "not", "without", "denies", "denied", "excluded", "absent", "never"} & set(before))
        for n, c, s in {h for h in hits if h[0] == size}:
            old = found.get((c, s), (0, True))
            found[c, s] = (old[0] + 1, old[1] and negated)
        at += size
    return found


def test_tags_by_token_joins(spark):
    rng = random.Random(3)
    words = ["ductal", "carcinoma", "invasive", "pd-l1", "no", "without", "lung", "bone", "met", ".", ";", "her2", "her2+", "x9"]
    terms = [("ductal carcinoma", "Ductal", "h"), ("invasive ductal carcinoma", "Invasive", "h"), ("PD-L1", "PD-L1", "m"), ("carcinoma", "Carcinoma", "h"), ("bone met", "Bone", "s"),
             ("Bone  met", "Bone", "s"), ("bone met", "Metastatic", "d"), ("HER2", "HER2", "m"), ("lung", "Lung", "s"), ("carcinoma invasive ductal", "Odd", "h"), ("", "Empty", "h"), (" ", "Blank", "h")]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(80)] + ["", None, "carcinoma " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    vocab = spark.createDataFrame(terms, "term string, canonical string, slot string")
    got = {}
    for r in vocabulary.tag_vocabulary(df, "id", "text", vocab).collect():
        got.setdefault(r["id"], {})[r["canonical"], r["slot"]] = (r["mentions"], r["negated"])
    assert got == {i: tags for i, t in enumerate(texts) if (tags := plain_tags(t or "", terms))}


def test_empty_vocabulary(spark):
    df = spark.createDataFrame([(1, "a b c")], "id long, text string")
    assert vocabulary.tag_vocabulary(df, "id", "text", spark.createDataFrame([], "term string, canonical string, slot string")).collect() == []


def test_cover_is_exact(spark):
    n = 1 << scales.LEVELS
    rows = [(a, b) for a in range(n) for b in range(a, n)]
    df = spark.createDataFrame(rows, "lo int, hi int").select("lo", "hi", scales.cover(F.col("lo"), F.col("hi")).alias("nodes"))
    above = {r["rank"]: set(r["up"]) for r in spark.range(n).select(F.col("id").cast("int").alias("rank")).select("rank", scales.ancestors(F.col("rank")).alias("up")).collect()}
    for r in df.collect():
        inside = {x: sum(node in above[x] for node in r["nodes"]) for x in range(n)}
        assert inside == {x: int(r["lo"] <= x <= r["hi"]) for x in range(n)}
        assert len(r["nodes"]) <= 2 * scales.LEVELS


def test_written_ranges(spark):
    cases = {
        "stage": {"IIIA": ("IIIA", "IIIA"), "Stage III": ("III", "IIIC"), "stage IB-IIIA": ("IB", "IIIA"), "I to II": ("I", "IIC"), "II or higher": ("II", "IVC"), "≤ IIA": ("0", "IIA"), "stage 0": ("0", "0"), "V": None, "": None, "III-I": None},
        "t": {"T2-4": ("T2", "T4B"), "T1a – T2": ("T1A", "T2C"), "≥T3": ("T3", "T4B"), "pT2b": ("T2B", "T2B"), "Tis": ("TIS", "TIS"), "T5": None},
        "n": {"N1-2": ("N1", "N2C"), "N0": ("N0", "N0"), "N2 or less": ("NX", "N2C")},
        "ecog": {"ECOG 0-2": ("0", "2"), "PS 1": ("1", "1"), "≤2": ("0", "2"), "performance status 2 or more": ("2", "5")},
    }
    for scale, texts in cases.items():
        df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", scales.rank_range(scale, F.col("text")).alias("r"))
        labels = scales.SCALES[scale]
        assert {r["text"]: r["r"] and (labels[r["r"]["lo"]], labels[r["r"]["hi"]]) for r in df.collect()} == texts


def test_containment_and_overlap(spark):
    rng = random.Random(7)
    pair = lambda: tuple(sorted((rng.randrange(17), rng.randrange(17))))
    left, right = [("t", i, *pair()) for i in range(60)], [("t", i, *pair()) for i in range(60)] + [("n", 99, 0, 13)]
    a, b = spark.createDataFrame(left, "scale string, x int, lo int, hi int"), spark.createDataFrame(right, "scale string, y int, low int, high int")
    got = sorted((r["x"], r["y"], r["lo"], r["hi"], r["low"], r["high"]) for r in scales.overlapping(a, b).collect())
    assert got == sorted((x, y, lo, hi, low, high) for s, x, lo, hi in left for t, y, low, high in right if s == t and lo <= high and low <= hi)
    points = [("t", i, rng.randrange(17)) for i in range(50)] + [("t", 77, None)]
    held = scales.contained(spark.createDataFrame(points, "scale string, p int, rank int"), a)
    assert sorted((r["p"], r["x"]) for r in held.collect()) == sorted((p, x) for _, p, rank in points for _, x, lo, hi in left if rank is not None and lo <= rank <= hi)
