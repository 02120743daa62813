"""Edges of chat formatting, HTML extraction and the pipeline's stages."""

import hashlib
import json

import corpus_pipeline as c
from talentgrid.llm import op07_chat, op09_html
from talentgrid.llm.common import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_chat_nulls_and_empty(spark):
    rows = [(1, json.dumps({"messages": [{"role": None, "content": None}, {"role": "assistant", "content": ""}]})), (2, json.dumps({"prompt": None, "completion": "b"}))]
    turns = op07_chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, payload string"))
    back = {r["conv_id"]: r for r in op07_chat.read_back(op07_chat.format_turns(turns)).collect()}
    assert back[1]["n_turns"] == 2 and back[1]["loss_chars"] == 0
    assert back[2]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert op07_chat.read_back(op07_chat.format_turns(turns.limit(0))).count() == 0


def test_html_empty_long_and_clashing(spark):
    kind = "page_id long, url string, html string, text string, _host string"
    assert op09_html.extract(spark.createDataFrame([], kind)).count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, "http://h.x/1", f"<article><p>{long}</p></article>", "x", "y"), (None, None, None, "x", "y")]
    got = {r["page_id"]: r["text"] for r in op09_html.extract(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: long, None: ""}


def test_html_counts_against_brute_force(spark, monkeypatch):
    """Substrings on a share of the host's pages, whatever the chunks, as plain counting finds them."""
    import random

    rng = random.Random(8)
    common = [" ".join(f"c{k}x{i}" for i in range(12)) for k in range(4)]
    pages = []
    for i in range(60):
        blocks = [f"story {i} " + " ".join(f"u{i}x{j}" for j in range(9))] + [x for k, x in enumerate(common) if rng.random() < (0.02, 0.05, 0.3, 0.9)[k]]
        rng.shuffle(blocks)
        pages.append(blocks)

    def tokens(blocks):
        return [t for b in blocks for t in [*b.split(), "\n"]]

    seen = {}
    for i, blocks in enumerate(pages):
        t = tokens(blocks)
        for a in range(len(t) - 7):
            seen.setdefault(tuple(t[a : a + 8]), set()).add(i)
    want = {}
    for i, blocks in enumerate(pages):
        t, on = tokens(blocks), set()
        for a in range(len(t) - 7):
            if len(seen[tuple(t[a : a + 8])]) >= 3:
                on.update(range(a, a + 8))
        at, kept = 0, []
        for b in blocks:
            n = len(b.split()) + 1
            if sum(x in on for x in range(at, at + n)) / n < op09_html.COVERED:
                kept.append(b)
            at += n
        want[i] = "\n".join(kept)
    rows = [(i, f"http://h.x/{i}", "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>") for i, blocks in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in op09_html.extract(df).collect()} == want
    monkeypatch.setattr(op09_html, "CHUNK_PAGES", 7)
    assert {r["page_id"]: r["text"] for r in op09_html.extract(df).collect()} == want


def test_stages_on_nulls_repeats_and_nothing(spark, sf):
    text = " ".join(f"word{i % 50} and the other{i} is of it" for i in range(40)) + "."
    rows = [(1, None, "en", "s", 0), (None, text, "en", "s", 9), (2, text, "en", "s", 9), (2, text, "en", "s", 9), (3, "", "en", "s", 0)]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for name, stage in c.STAGES[:-1]:
            docs = written(spark, stage(spark, docs, sf), name)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        c.STAGES[-1][1](spark, docs, sf).collect()
