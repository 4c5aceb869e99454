"""Pages go to Python a few at a time; an Arrow batch of thousands grows with the pages."""

from cohortloom.sources import html


def test_no_batches_of_pages(spark):
    page = "<body><h2>One</h2><p>" + "w " * 150 + "</p><h2>Two</h2><p>x</p></body>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, page)], "page_id long, html string")
    out = html.html_sections(pages)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan and "Pandas" not in plan
    assert out.columns == ["page_id", "title", "section_idx", "level", "heading", "text", "usable"]
    assert sorted((r.page_id, r.section_idx, r.heading, r.text, r.usable) for r in out.collect()) == [
        (p, i, h, t, True) for p in (1, 4) for i, h, t in ((0, "One", ("w " * 150).strip()), (1, "Two", "x"))
    ]
