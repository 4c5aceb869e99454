"""Windows of terms grow in the row of their text, and only hits leave it."""

from cohortloom.operators import vocabulary as v


def test_hits_are_all_places_and_only_they_leave_the_row(spark):
    texts = {1: "No fever. A b c d, and a b", 2: "denied x y a b c; c d", 3: "", 4: None, 5: "fever without " + "w " * 9 + "fever a"}
    terms = ["a b c", "a b", "c d", "fever", "b", "a b c d e f g", "x y a b c"]
    table = v.term_table(spark.createDataFrame([(t,) for t in terms], "term string"))
    frame = spark.createDataFrame(list(texts.items()), "k int, t string")
    hits = v.term_hits(frame, "k", "t", table)
    want = set()
    for k, text in texts.items():
        ts = (text or "").lower().replace(".", " .").replace(",", " ,").replace(";", " ;").split()
        for i in range(len(ts)):
            before = ts[max(0, i - v.NEGATION_TOKENS) : i]
            end = max((j for j, t in enumerate(before) if t in v.SENTENCE_ENDS), default=-1)
            for n in range(1, len(ts) - i + 1):
                if " ".join(ts[i : i + n]) in terms:
                    want.add((k, i, n, bool(set(before[end + 1 :]) & set(v.NEGATIONS)), " ".join(ts[i : i + n])))
    assert sorted(tuple(r) for r in hits.collect()) == sorted(want) and len(want) > 12
    windows = v.term_windows(frame, "k", "t", table)._jdf.queryExecution().optimizedPlan()
    assert str(windows).split("\n")[1].strip(" +-").startswith("Generate explode(hits") and windows.toString().count("window") == 0
