"""Every dealt query and stage on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm.queries import QUERIES

LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
EXTRA = ["n_words", "kept", "ids", "key", "row_key", "label", "_row", "found", "spans", "score", "host", "n_links", "line", "digest"]


def documents(rows):
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


ROWS = documents([
    (None, None, None, None), (None, "a null id with some words", "en", None), (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", "a"),
    (4, LONG, "en", "a"), (5, "x" * 70_000, "en", "b"), (6, "same text in two rows", "en", "b"), (6, "same text in two rows", "en", "b"),
    (6, "another text under the same id", "de", "b"), (7, "same text in two rows", "en", None), (8, "∅ ▁ \x00 é\r\n\u2028 ▁▁  end ", "fr", "c"), (-9, "!!! ... \n\n", "en", "c"),
])
PAGES = [(None, None, None), (1, None, ""), (2, "", "<p>"), (3, "no scheme", None), (3, "no scheme", None), (4, "http://", "</p></div><p>a<b>c"), (5, "HTTP://Ä.COM:80/En?x#y", "<" * 5000), (6, "a://example.com", "<p>" * 3000 + "z")]
VECTORS = [
    (None, [0.5] * 64), (1, None), (2, []), (3, [0.25] * 63), (4, [None] + [0.0] * 63), (5, [float("nan")] * 64), (6, [float("inf")] + [0.0] * 63), (7, [2.0**22] + [0.0] * 63),
    (8, [0.5] * 64), (8, [0.5] * 64), (9, [-0.01] + [0.0] * 63), (10, [2.0**20] + [-(2.0**20)] * 63),
]
ITEMS = [(None, "an item without an id is no item"), (1, None), (2, ""), (3, "same text"), (3, "same text"), (4, "words " * 40)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """sf folders: odd rows, and empty tables, each with extra columns of clashing names."""
    out = {}
    for name, rows, pages, items, vectors in (("odd", ROWS, PAGES, ITEMS, VECTORS), ("none", [], [], [], [])):
        at = str(tmp_path_factory.mktemp(name))
        tables = {
            "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
            "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
            "benchmark": spark.createDataFrame(items, "item_id long, text string"),
            "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
        }
        for table, df in tables.items():
            for c in EXTRA:
                df = df.withColumn(c, F.lit("x").cast("string"))
            df.write.parquet(f"{at}/{table}.parquet")
        out[name] = at
    return out


@pytest.fixture(scope="module")
def odd(spark, folders):
    """Rows of each query over the odd tables, run once."""
    return {name: QUERIES[name](spark, folders["odd"]).collect() for name in QUERIES}


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_rows(odd, name):
    rows = odd[name]
    assert len(rows) == {"op1_html_extraction": len(PAGES), "op6_url_filters": len(PAGES), "op11_centroid_clustering": 5}.get(name, len(ROWS))


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders["none"]).collect() == []


def test_pipeline_on_odd_rows(spark, folders):
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folders["odd"])
        assert out.columns == docs.columns, name
        assert out.count() <= len(ROWS)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folders["odd"])
    assert all(r["lossless"] for r in last.collect())
    assert corpus_pipeline.run(spark, folders["none"]).count() == 0


def test_defined_results(odd):
    def of(name):
        return [r.asDict() for r in odd[name]]

    joins = of("op2_jaccard_join")
    assert [(r["class_id"], r["n_links"]) for r in joins if r["doc_id"] in (2, 3)] == [(2, 0), (3, 0)]
    assert sorted((r["n_copies"], r["n_links"]) for r in joins if r["doc_id"] == 6) == [(1, 0), (3, 2), (3, 2)]
    labels = {r["doc_id"]: r for r in of("op7_language_id") if r["doc_id"] is not None}
    assert all(labels[i]["lang_pred"] == "und" and labels[i]["score"] == 0 for i in (1, 2, 3, -9))
    assert all(r["lossless"] for r in of("op10_sentencepiece"))
    quality = {r["doc_id"]: r for r in of("op9_quality_rules") if r["doc_id"] is not None}
    assert quality[4]["kept"] and not quality[1]["kept"] and quality[1]["n_words"] == 0
    found = {r["doc_id"]: r for r in of("op3_benchmark_decontamination") if r["doc_id"] is not None}
    assert (found[7]["n_hit"], found[7]["n_items"], found[7]["contaminated"]) == (2, 1, True)
    urls = {r["page_id"]: r for r in of("op6_url_filters") if r["page_id"] is not None}
    assert (urls[5]["host"], urls[5]["path"], urls[5]["verdict"]) == ("Ä.com:80", "/En", "allow")
    assert (urls[6]["host"], urls[6]["path"], urls[6]["rule"]) == ("example.com", "", None)
    pages = {r["page_id"]: r["text"] for r in of("op1_html_extraction") if r["page_id"] is not None}
    assert pages[1] == "" and pages[2] == ""
    kept = {r["doc_id"]: r for r in of("op4_line_dedup") if r["doc_id"] is not None}
    assert kept[1]["text"] is None and kept[2]["text"] == "" and kept[7]["text"] == "" and kept[7]["n_removed"] == 1


def test_defined_values(odd):
    """Values of the rows whose cases the docstrings define."""
    empty = sha256(b"").hexdigest()

    def by_id(name, key="doc_id"):
        return {r[key]: r.asDict() for r in odd[name] if r[key] is not None}

    fim = by_id("op13_fill_in_middle")
    for i in (1, 2):
        assert (fim[i]["n"], fim[i]["form"], fim[i]["prefix_chars"], fim[i]["output_sha256"], fim[i]["restored_sha256"]) == (0, "plain", None, empty, empty)
    assert fim[3]["n"] == 1 and fim[4]["n"] == 30_000 and fim[5]["n"] == 1
    assert fim[4]["restored_sha256"] == sha256(LONG.encode()).hexdigest()
    same = [(r["n"], r["form"], r["output_sha256"]) for r in odd["op13_fill_in_middle"] if r["doc_id"] == 6]
    assert len(same) == 3 and len(set(same)) == 2
    personal = by_id("op12_personal_data")
    assert all((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) == (0, 0, 0, 0, empty, "") for r in personal.values())
    clusters = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["distance"]) for r in odd["op11_centroid_clustering"]))
    # Fewer vectors than clusters: each is a centroid of its own, or shares one with its equals.
    assert clusters == [(False, 8, 0), (False, 8, 0), (False, 9, 0), (False, 10, 0), (True, 0, 0)]
    assert {r["inertia"] for r in odd["op11_centroid_clustering"]} == {0}
    cut = by_id("op5_substring_dedup")
    assert (cut[1]["n_words"], cut[1]["n_removed"], cut[1]["kept_sha256"]) == (0, 0, empty) and cut[4]["n_removed"] == 0
    secrets = by_id("op8_secret_scans")
    assert (secrets[1]["base_sha256"], secrets[1]["spans"], secrets[2]["base_sha256"]) == (empty, "", empty)
    lines = by_id("op4_line_dedup")
    assert lines[4]["text"] == LONG and lines[5]["text"] == "x" * 70_000 and lines[3]["n_removed"] == 0 and lines[-9]["text"] == "!!! ... \n\n"
    pages = by_id("op1_html_extraction", "page_id")
    assert (pages[5]["n_chars"], pages[4]["text"]) == (len(pages[5]["text"]), pages[4]["text"]) and pages[6]["text"] in ("", "z")
