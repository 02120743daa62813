"""Host-wide boilerplate counts and copied pages of op9."""

import pytest

from talentgrid.llm import op09_html


def texts(spark, rows):
    out = op09_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r["page_id"]: r["text"] for r in out.collect()}


def story(i):
    return f"Story {i}: item{i} went to place{i} on day{i} with friend{i} and dog{i}"


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("n", [3, 20])
def test_equal_pages_keep_their_text(spark, tag, n):
    rows = [(i, f"http://h.x/{i}", f"<body><{tag}><p>{story(0)}</p></{tag}></body>") for i in range(n)]
    assert texts(spark, rows) == {i: story(0) for i in range(n)}


def test_chunks_do_not_change_results(spark, monkeypatch):
    side, closing = "See what our readers liked most in the past week", "This story was first printed by the daily paper of our town"
    rows = []
    for i in range(40):
        rows.append((i, f"http://h.x/{i}", f"<body><div>{story(i)}</div>" + (f"<div>{side}</div>" if i < 4 else "") + "</body>"))
        rows.append((100 + i, f"http://m.x/{i}", f"<body><article><p>{story(i)}</p><p>{closing}</p></article></body>"))
    want = {i + k: story(i) for i in range(40) for k in (0, 100)}
    assert texts(spark, rows) == want
    monkeypatch.setattr(op09_html, "CHUNK_PAGES", 5)
    assert texts(spark, rows) == want
