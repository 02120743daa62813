"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest

from talentgrid.llm import op01_quality, op02_substring, op03_toxicity, op04_packing, op05_simhash, op06_decontaminate, op07_chat, op08_tokenfile, op09_html, op10_sharding
from talentgrid.llm.common import scratch_path

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, kept boolean, n_words string, component string"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(120_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, LONG), (7, "ünï cödé " * 30)]
    return spark.createDataFrame([(i, t, None, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def count(df):
    return len(df.collect())


def test_quality(docs, empty):
    got = [r for r in op01_quality.quality(docs).collect()]
    assert len(got) == 8 and count(op01_quality.quality(empty)) == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[6]["n_words"] == 120_000 and by[6]["n_repeat_words"] == 0
    assert by[7]["n_words"] == 60 and by[7]["n_repeat_words"] == 60 and by[7]["base_failed"]
    assert op01_quality.keep_passing(docs).columns == docs.columns


def test_substring(docs, empty):
    got = op02_substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and (by[6]["n_words"], by[6]["n_removed"]) == (120_000, 0)
    assert by[7]["n_removed"] == 60 and by[7]["kept_text"] == ""
    assert by[1]["n_words"] == 0 and by[1]["kept_text"] == ""
    assert count(op02_substring.remove_repeats(empty)) == 0


def test_substring_against_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [f"t{rng.randrange(40)}" for _ in range(400)]
    texts = []
    for i in range(30):
        a, n = rng.randrange(300), rng.randrange(20, 90)
        texts.append(" ".join([f"u{i}x{j}" for j in range(rng.randrange(40))] + base[a : a + n] + [f"v{i}x{j}" for j in range(rng.randrange(30))]))
    texts += [texts[0], "z " * 80]
    words = [t.split() for t in texts]
    seen: dict = {}
    for d, ws in enumerate(words):
        for i in range(len(ws) - 34):
            seen.setdefault(tuple(ws[i : i + 35]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + 35))
    want = {d: " ".join(w for i, w in enumerate(ws) if i not in gone[d]) for d, ws in enumerate(words)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["kept_text"] for r in op02_substring.remove_repeats(df).collect()}
    assert got == want and any(gone)


def test_packing(docs, empty):
    path = P.path("byte_bpe_50k.json")
    got = op04_packing.pack_documents(docs, path).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["doc_id"] == 5 for r in got) == 2
    assert [r["length"] for r in got if r["doc_id"] == 1] == [1]
    assert count(op04_packing.pack_documents(empty, path)) == 0


def test_simhash(docs, empty):
    got = {r["doc_id"]: r for r in op05_simhash.near_duplicates(docs).collect()}
    assert got[1]["fp"] == got[2]["fp"] == got[3]["fp"] == 0 and got[3]["component"] == 1
    assert got[5]["component"] == 4
    assert count(op05_simhash.near_duplicates(docs)) == 8 and count(op05_simhash.near_duplicates(empty)) == 0


@pytest.mark.parametrize("radius", [2, 4, 6, 7])
def test_masks_cover_every_pair(radius):
    import random

    masks, rng = op05_simhash.covering_masks(radius), random.Random(radius)
    assert min(bin(m).count("1") for m in masks) >= 28
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(diff & m == 0 for m in masks)


def test_simhash_hot_bucket(spark, monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(op05_simhash, "HOT_BUCKET", 16)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(120):
        fps.add(base ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(1, 7))))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(op05_simhash._signed(x),) for x in fps], "fp long")
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4):
            parent[root(fps[i + 1 + int(j)])] = root(fps[i])
    want = {frozenset(x for x in fps if root(x) == r) for r in set(map(root, fps))}
    for x in fps:
        parent[x] = x
    for r in op05_simhash.near_links(df).collect():
        parent[root(r["u"] % (1 << 64))] = root(r["v"] % (1 << 64))
    assert {frozenset(x for x in fps if root(x) == r) for r in set(map(root, fps))} == want


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([(1, "Two THREE"), (2, None), (3, "..."), (10, "two three"), (4, "w5x0 w6x0 w7x0 w8x0 w9x0 w10x0 w11x0 w12x0 w13x0 w14x0 w15x0")], "item_id long, text string")
    got = {r["doc_id"]: r for r in op06_decontaminate.decontaminate(docs, bench).collect()}
    assert (got[4]["n_hit"], got[4]["n_items"], got[4]["items_sha256"]) == (2, 2, hashlib.sha256(b"1,10").hexdigest())
    assert (got[6]["n_hit"], got[6]["n_items"]) == (11, 1) and not got[1]["contaminated"]
    assert count(op06_decontaminate.decontaminate(empty, bench)) == 0
    assert not any(r["contaminated"] for r in op06_decontaminate.decontaminate(docs, bench.limit(0)).collect())
    assert sorted(r["doc_id"] for r in op06_decontaminate.drop_contaminated(docs, bench).collect()) == [1, 2, 3, 7]


def test_decontaminate_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(op06_decontaminate, "BLOCK_BYTES", 8)
    bench = spark.createDataFrame([(1, "two three"), (2, "one two"), (3, "nothing here")], "item_id long, text string")
    unique = docs.dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in op06_decontaminate.decontaminate(unique, bench).collect()}
    assert (got[4]["n_hit"], got[4]["n_items"]) == (3, 2) and got[6]["n_hit"] == 0


def test_chat_layouts(spark):
    odd = 'a\\b </s>[INST] <|im_end|>\n<|im_start|>user\n"x"'
    import json

    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": odd}, {"role": "assistant", "content": odd}]})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]})),
        (3, json.dumps({"instruction": "do", "input": "this", "output": None})),
        (4, json.dumps({"prompt": "p", "completion": "c"})),
    ]
    turns = op07_chat.canonical_turns(spark.createDataFrame(records, "conv_id long, payload string"))
    got = sorted(tuple(r) for r in turns.collect())
    assert got[2:] == [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "do\nthis"), (3, 1, "assistant", ""), (4, 0, "user", "p"), (4, 1, "assistant", "c")]
    back = {r["conv_id"]: r for r in op07_chat.read_back(op07_chat.format_turns(turns)).collect()}
    assert back[1]["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest() and back[1]["loss_chars"] == len(odd)
    assert back[1]["turns_sha256"] == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert list(op07_chat.parse(op07_chat.segment("we\nird\\", odd)[0])) == [("we\nird\\", odd)]


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    manifest = op08_tokenfile.write_token_files(docs, scratch_path(spark, "t"), P.path("word_bpe_49k.json"))
    got = sorted(tuple(r)[:3] for r in op08_tokenfile.read_token_files(manifest).collect())
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    at, want = 0, []
    for i, t in rows:
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        want.append((i, at, n))
        at += n
    assert got == want
    shard = op08_tokenfile.TokenShard(manifest.first()["path"] + ".arrows")
    ids, mask = shard[0]
    assert len(ids) == len(mask) == 1024 and not ids.flags.owndata
    none = op08_tokenfile.write_token_files(empty, scratch_path(spark, "t"), P.path("word_bpe_49k.json"))
    assert count(op08_tokenfile.read_token_files(none)) == 0


def test_sharding(docs, empty):
    got = op10_sharding.shard(docs).collect()
    slots: dict = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(got) == 8
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert count(op10_sharding.shard(empty)) == 0


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = op03_toxicity.train(docs, labels)
    assert len({r["score"] for r in op03_toxicity.score(docs, model).collect()}) == 1
    assert count(op03_toxicity.score(empty, op03_toxicity.train(empty, labels.limit(0)))) == 0


def test_toxicity_held_out(spark):
    from sklearn_free import auc

    sf = "/root/testdata/sf0.01"
    got = op03_toxicity.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", "toxic", "predicted").collect()
    assert auc([r["score"] for r in got], [r["toxic"] for r in got]) > 0.8
    assert sum(r["predicted"] for r in got if not r["toxic"]) <= 3


def test_marginals_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    e, t = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 3, 3, 7])
    p, pair = op03_toxicity.marginals(e, first, t)
    for a, b in ((0, 3), (3, 7)):
        z, one, both = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e[a + i] * y[i] for i in range(b - a)) + sum(t[y[i - 1], y[i]] for i in range(1, b - a)))
            z += w
            one += w * np.array(y)
            for i in range(1, b - a):
                both[i, y[i - 1], y[i]] += w
        assert np.allclose(p[a:b], one / z) and np.allclose(pair[a + 1 : b], both[1:] / z)


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</ul></nav><article><h1>A &amp; B</h1><p>one\n two<p>three<br></article><div class='comments'>no</div><footer>f</footer></body></html>"


def test_html(spark):
    rows = [(1, "http://a.b/1", PAGE), (2, "http://a.b/2", None), (3, None, ""), (4, "http://a.b/4", "<p>just &lt;text"), (4, "http://a.b/4", "<p>just &lt;text")]
    got = sorted((r["page_id"], r["text"]) for r in op09_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "A & B\none two\nthree"), (2, ""), (3, ""), (4, "just <text"), (4, "just <text")]


def test_html_host_boilerplate(spark):
    frame = "<body><div>Welcome to the daily paper with news for all of you</div><div>Story {i}: item{i} went to place{i} on day{i} with friend{i} and dog{i}</div><div>All rights are reserved by the daily paper and its owners</div></body>"
    rows = [(i, f"http://h.x/{i}", frame.format(i=i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in op09_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}: item{i} went to place{i} on day{i} with friend{i} and dog{i}" for i in range(8)}


def test_html_closing_line_in_articles_and_copied_articles(spark):
    closing = "This story was first printed by the daily paper of our town"
    copied = "A long passage that several pages of this host quote from one another word for word"
    body = "<body><article><p>Story {i} is about item{i} and place{i} and day{i}</p>{c}<p>" + closing + "</p></article></body>"
    rows = [(i or None, f"http://h.x/{i}", body.format(i=i, c=f"<p>{copied}</p>" if i < 5 else "")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in op09_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = {i or None: f"Story {i} is about item{i} and place{i} and day{i}" for i in range(12)}
    assert got == {k: t + f"\n{copied}" if (k or 0) < 5 else t for k, t in own.items()}
