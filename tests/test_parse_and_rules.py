from pyspark.sql import functions as F

from cohortloom.functions import ids, parse, rules
from cohortloom.operators import matching, tagging


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_years_count_as_months_even_beside_a_percentage(spark):
    text = F.lit("91.3% at 3 years")
    assert one(spark, parse.extract_percent(text)) == 91.3
    assert one(spark, parse.extract_months(text)) == 36.0
    assert one(spark, parse.extract_gy(F.lit("66-Gy in 33 fractions"))) == 66.0
    assert one(spark, parse.extract_fractions(F.lit("66 Gy in 33 fractions"))) == 33
    assert one(spark, parse.extract_percent(F.lit("no number"))) is None


def test_longer_names_win_and_blank_is_null(spark):
    assert one(spark, rules.normalize_category(F.lit("Non-Hodgkin lymphoma"))) == "Non-Hodgkin Lymphoma"
    assert one(spark, rules.normalize_category(F.lit("colorectal cancer"))) == "Colorectal Cancer"
    assert one(spark, rules.normalize_phase(F.lit("  "))) is None
    assert one(spark, rules.normalize_phase(F.lit("pilot study"))) == "Pilot Study"


def test_stable_id_is_a_name_based_uuid(spark):
    import hashlib
    import uuid

    digest = hashlib.sha256(b"document|nci|42").hexdigest()
    assert one(spark, ids.stable_id("document", "nci", "42")) == str(uuid.uuid5(uuid.NAMESPACE_URL, digest))


def test_stage_verdicts(spark):
    cases = {("III", "iii"): "MATCH", ("IIIA", "Stage III"): "COMPATIBLE", ("II", "I-III"): "COMPATIBLE", ("IV", "II-III"): "MISMATCH", (None, "II"): "MISMATCH"}
    for (p, s), want in cases.items():
        assert one(spark, matching.stage_subsumption(F.lit(p).cast("string"), F.lit(s))) == want


def test_silence_is_not_a_mismatch(spark):
    empty = F.array().cast("array<string>")
    text = F.lit("plain words")
    assert one(spark, matching.set_match(empty, F.array(F.lit("x")), text)) == 0.5
    assert one(spark, matching.set_match(F.array(F.lit("breast")), empty, text)) == 0.5
    assert one(spark, matching.set_match(F.array(F.lit("breast")), F.array(F.lit("lung")), text)) == 0.0
    assert one(spark, matching.contra_exclusion(F.lit(None).cast("boolean"))) is True


def test_negation_stays_in_its_sentence(spark):
    rows = [(1, "No evidence of brain metastases. Lung cancer."), (2, "Denies surgery. Brain lesion seen."), (3, "Brain was excluded.")]
    df = spark.createDataFrame(rows, "id int, text string")
    occ = tagging.occurrences(df, "id", "text").select("id", "variant", tagging.negated().alias("neg"))
    got = {(r["id"], r["variant"]): r["neg"] for r in occ.collect()}
    assert got[(1, "brain")] and not got[(1, "lung")]
    assert not got[(2, "brain")] and got[(3, "brain")]


def test_marker_status(spark):
    df = spark.createDataFrame([(1, "HER2 negative, ER+ and PD-L1: 50%. EGFR mutated, no ALK")], "id int, text string")
    rows = tagging.occurrences(df, "id", "text").select("variant", tagging.status().alias("s")).collect()
    assert {r["variant"]: r["s"] for r in rows} == {"her2": "negative", "er": "positive", "pd-l1": "value:50%", "egfr": "mutated", "alk": "negative"}
