"""Hand-written cases for fixed patterns: every alternative restored or at risk has one that fails without it."""

import re

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import rules
from cohortloom.operators import matching, quality, retrieval, tagging

BEFORE = [
    "no ", "not ", "without ", "excluded ", "excluding ", "negative for ", "absence of ", "lack of ", "lacking of ", "no history of ", "no evidence of ", "denies ", "never had ", "free of ",
    "ruled out ", "rule out ", "prior scans ruled out ", "prior biopsy had excluded ",
]
AFTER = {
    " amplified": "amplified", "-amp": "amplified", " mutation": "mutated", " methylated": "mutated", " wild-type": "wild-type", "-wt": "wild-type", " loss": "loss", " deletion": "loss", " positive": "positive",
    "+ ": "positive", " strongly positive": "positive", " overexpressed": "positive", " intact": "positive", " negative": "negative", "- ": "negative", " not detected": "negative", " high": "high", " ultra-low": "low",
}


@pytest.mark.parametrize("cue", BEFORE)
def test_negation_cues_before_a_term(cue):
    assert re.search(tagging.NEG_BEFORE, cue)


@pytest.mark.parametrize(("text", "status"), AFTER.items())
def test_status_words_after_a_marker(text, status):
    assert next(s for p, s in tagging.STATUS_AFTER if re.search(p, text)) == status


def test_author_pattern_names_every_journal():
    pattern = next(p for n, p, _ in retrieval.LANDMARKS if n == "author_named_trials")
    assert all(re.search(pattern, f"Stupp et al, {j} 2005") for j in ("trial", "study", "NEJM", "Lancet", "JCO", "JAMA", "N Engl J Med"))


def test_axis_words():
    words = dict(matching.AXIS_WORDS)
    for axis, samples in {
        "cancer_type": "colorectal bladder kidney renal liver pancreatic stomach gastric oesophageal ovarian cervical uterine endometrial throat tongue larynx thyroid skin leukaemia myeloma sarcoma testicular",
        "treatment": "chemotherapy operation pembrolizumab pembro nivolumab nivo infusion pill tablet trial transplant",
        "stage": "early advanced metastatic spread localised localized",
    }.items():
        assert all(re.search(words[axis], w) for w in samples.split())


def test_marker_expressions(spark):
    cases = {
        "CPS<100": ("CPS", "<", "100"), "PD-L1 ≥ 50%": ("PD-L1", ">=", "50"), "TMB 10": ("TMB", "=", "10"), "HER2+": ("HER2", "+", ""), "ER-": ("ER", "-", ""), "ER- tumour": ("ER", "-", ""), "KRAS wild-type": ("KRAS", "wt", ""),
        "BRAF mutant": ("BRAF", "mutant", ""), "MSI-H positive": ("MSI-H", "+", ""), "BRCA1 positive": ("BRCA1", "+", ""), "ROS1 negative.": ("ROS1", "-", ""), "AR <= 5": ("AR", "<=", "5"),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "text string").withColumn("id", F.col("text"))
    got = {r["id"]: (r["name"], r["op"], r["value"]) for r in tagging.expression_parse(rows, "id", "text").collect()}
    want = dict(cases)
    assert got == want


def test_marker_status_patterns(spark):
    cases = {"ER + disease": ("ER", "positive"), "PR- ": ("PR", "negative"), "HER-2 non-amplified": ("HER2", "negative"), "egfr+": ("EGFR", "mutant"), "alk-": ("ALK", "negative"), "p16 +": ("HPV", "positive"), "hpv-": ("HPV", "negative"), "kras wt": ("KRAS", "wild-type")}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", rules.marker_status(F.col("t")).alias("m"))
    assert {r["t"]: r["m"].get(cases[r["t"]][0]) for r in rows.collect()} == {t: s for t, (_, s) in cases.items()}


def test_every_study_is_compared(spark):
    rows = [(1, f"d{i}", i, f"total dose {20 + 10 * i} Gy was given") for i in range(1, 12)]
    found = quality.contradictions(spark.createDataFrame(rows, "query_id int, doc_id string, pos int, text string"), "text")
    pairs = {(r["doc_a"], r["doc_b"]) for r in found.collect()}
    want = {(f"d{i}", f"d{j}") for i in range(1, 12) for j in range(i + 1, 12) if (10 * (j - i)) / (20 + 10 * j) > 0.10}
    assert pairs == want


def test_diversity_ranks_every_row(spark):
    rows = [(1, i, f"w{i % 7} w{i % 5} common", 1.0 - i / 100) for i in range(60)]
    got = [r["doc_id"] for r in retrieval.diversity_rerank(spark.createDataFrame(rows, "query_id int, doc_id int, text string, score double"), "text", "score").orderBy("rank").collect()]
    words = {i: set(t.split()) for _, i, t, _ in rows}
    taken, left = [0], list(range(1, 60))
    penalty = dict.fromkeys(left, 0.0)
    while left:
        for i in left:
            penalty[i] += len(words[i] & words[taken[-1]]) / len(words[i] | words[taken[-1]])
        best = max(left, key=lambda i: (rows[i][3] - 0.2 * penalty[i], -i)) if max(rows[i][3] - 0.2 * penalty[i] for i in left) > -1 else left[0]
        taken.append(best)
        left.remove(best)
    assert got == taken


def test_equal_left_rows_of_a_band_join_stay(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 9.0)], "k string, v double")
    right = spark.createDataFrame([("a", 1.4), ("a", 0.2)], "k string, v double")
    assert sorted((r["k"], r["found"]) for r in quality.band_join(left, right, ["k"], "v", 1.0).collect() if r["found"]) == [("a", 1.4)] * 2


def test_ecog_ranges_end_with_the_scale(spark):
    rows = spark.createDataFrame([("ECOG 0-1",), ("≤2",), (">= 3",), ("0-9",)], "v string").select("v", matching.range_expand("ecog", F.col("v")).alias("t"))
    got = {r["v"]: sorted({x[-1] for x in r["t"]}) for r in rows.collect()}
    assert got == {"ECOG 0-1": ["0", "1"], "≤2": ["0", "1", "2"], ">= 3": ["3", "4", "5"], "0-9": ["0", "1", "2", "3", "4", "5"]}
