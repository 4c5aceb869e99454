"""Operators over long texts and long lists: what stands far back counts as what stands in front."""

import random

from pyspark.sql import functions as F

from cohortloom.functions import rules
from cohortloom.operators import analytics, chunking, filters, matching, retrieval, tagging

FILLER = "plain words of no weight here. " * 1500  # 46,500 characters


def values(spark, schema, row, **columns):
    return spark.createDataFrame([row], schema).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_judged_texts_are_whole(spark):
    late = FILLER + " Department of medicine, University hospital, Institute. In conclusion, a randomized trial."
    r = values(
        spark, "name string, text string", ("Other", late),
        level=tagging.evidence_level([(F.lit("none at all"), 1.0), (F.col("text"), 0.7)]), kind=rules.section_type(F.col("name"), F.col("text")),
        head=rules.section_type(F.col("name"), F.col("text"), head_chars=300), skipped=filters.skip_section(F.col("name"), F.col("text")),
        kept=filters.skip_section(F.col("name"), F.col("text"), head_chars=500),
    )
    assert r["level"]["type"] == "Randomized Controlled Trial"
    assert (r["kind"] != "other", r["head"]) == (True, "other")
    assert (r["skipped"], r["kept"]) == (True, False)


def test_overview_is_whole(spark):
    docs = spark.createDataFrame([(1, [("Results", FILLER), ("Discussion", "the very end of it all")])], "doc long, sections array<struct<name:string,content:string>>")
    assert chunking.overview_chunk(docs, "doc", "sections").first()["overview"].endswith("the very end of it all")
    assert len(chunking.overview_chunk(docs, "doc", "sections", max_chars=1000).first()["overview"]) <= 1000


def test_alignment_by_text_far_back(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    bodies = [" ".join(word() for _ in range(2000)) for _ in range(3)]
    chunk = " ".join(bodies[2].split(" ")[1900:1940])
    docs = spark.createDataFrame([(1, [chunk, "nothing of this is found anywhere else"], list(zip(["One", "Two", "Six"], bodies, strict=True)))], "doc long, chunks array<string>, sections array<struct<name:string,content:string>>")
    rows = chunking.section_align(docs, "doc", "chunks", "sections").collect()
    assert [(r["chunk_idx"], r["section"], r["score"]) for r in rows] == [(0, "Six", 50 + 36 * 10)]


def test_expansions_are_whole(spark):
    extra = F.array(*[F.lit(f"term {i} " + "x" * 300) for i in range(100)])
    r = values(
        spark, "text string", ("a query",), all=matching.query_expand(F.col("text"), extra), few=matching.query_expand(F.col("text"), extra, max_terms=2),
        lay=matching.vocab_expand(F.lit(FILLER + "spread to the brain, tired after chemo")),
    )
    assert r["all"].count("term ") == 100 and r["few"].count("term ") == 2
    assert r["lay"] == ["metastatic", "stage IV", "fatigue", "asthenia", "chemotherapy", "systemic therapy", "CNS", "intracranial"]


def test_labels_are_whole(spark):
    summary = spark.createDataFrame([(1, "n" * 200, None, 5.0, None, 3, "II", "raw " * 100)], "study_id long, study_name string, document_name string, os_rate_percent double, os_median_months double, number_of_patients int, normalized_phase string, os_raw string")
    r = analytics.rate_forest(summary, "os", 5).first()
    assert (r["label"], r["raw"]) == ("n" * 200, "raw " * 100)


def plain_merge(rows, most, reserved=2):
    lanes = ["frame", "both", "structured", "vector"]
    picked = [x for lane in lanes for x in sorted((r for r in rows if r[2] == lane), key=lambda r: r[1])[: None if lane == "vector" else reserved]]
    seen, kept = set(), []
    for _, _, lane, doc, title, year, trial in picked:
        keys = {("d", doc), ("f", title.strip().lower(), year or 0)} | ({("n", trial.upper())} if trial else set())
        if not keys & seen:
            seen |= keys
            kept.append((doc, lane))
    return [(i + 1, *x) for i, x in enumerate(kept[:most])]


def test_lanes_of_long_lists(spark, monkeypatch):
    """Lanes whose rows rank far below 100, and queries of which most rows repeat a title, against a plain fold."""
    monkeypatch.setattr(retrieval, "FOLD_ROWS", 20)
    rng, rows = random.Random(5), []
    for q in range(6):
        for pos in range(1, 401):
            lane = "vector" if pos < 300 or rng.random() < 0.5 else rng.choice(["frame", "both", "structured"])
            title = f"Trial {rng.randrange(3 if q % 2 and pos < 380 else 200)}"
            rows.append((q, pos, lane, rng.randrange(300), title, rng.choice([None, 2001]) if q == 4 else 2001, rng.choice([None, None, f"nct{rng.randrange(50)}"])))
    pool = spark.createDataFrame(rows, "query_id long, pos int, lane string, doc_id long, title string, year int, trial_no string").repartition(4)
    got = retrieval.lane_merge(pool, 10).collect()
    for q in range(6):
        own = sorted((r["rank"], r["doc_id"], r["lane"]) for r in got if r["query_id"] == q)
        assert own == plain_merge([r for r in rows if r[0] == q], 10), q
