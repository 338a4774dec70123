"""Consensus over all paths of a host, and raw elements that close themselves."""

from walkframe.llm import html


def test_a_path_of_any_rank_counts(spark, monkeypatch):
    # 30 templates; each has long pages, and a short one whose own best container is its list of teasers
    names = [f"{a}{b}" for a in "abcdef" for b in "vwxyz"]
    body = lambda n, main, teasers: f"<html><body><div class='story-{n}'><p>{main}</p></div><div class='teasers'><p>{teasers}</p></div></body></html>"
    rows = []
    for k, n in enumerate(names):
        rows += [(k * 10 + i, "http://h.org/x", body(n, f"{n} {i} has many words of the article " * 20, "read this too")) for i in range(3)]
        rows.append((k * 10 + 9, "http://h.org/x", body(n, f"only a few words of {n}", "read these, and all those, and some other things too")))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for small in (html.SMALL, -1):
        monkeypatch.setattr(html, "SMALL", small)
        got = {r.page_id: r.text for r in html.main_text(pages).collect()}
        assert [got[k * 10 + 9] for k in range(len(names))] == [f"only a few words of {n}" for n in names]


def test_svg_that_closes_itself():
    page = "<article><p>one two three</p><svg class='i' width='5'/><p>four five six</p><svg><title>x</title></svg><p>seven</p></article>"
    assert html.extract(page, []) == "one two three\nfour five six\nseven"
