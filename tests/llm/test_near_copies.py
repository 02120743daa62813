"""Near copies against brute force over shingle sets."""

import random

import numpy as np

import corpus_pipeline as c
from talentgrid.llm import near_copies as N


def shingles(text, k=5):
    w = text.lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(texts, least):
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    return near, low


def test_pipeline_links_pairs_from_jaccard_080(spark, sf):
    rng = random.Random(3)
    word = [f"w{i}" for i in range(5000)]
    texts = []
    for g in range(60):  # one replaced stretch: similarities on both sides of 0.8
        base = rng.choices(word, k=rng.randint(60, 300))
        at, n = rng.randint(5, 40), max(1, round(len(base) * (0.03 + 0.10 * g / 60)) - 4)
        texts += [" ".join(base), " ".join(base[:at] + rng.choices(word, k=n) + base[at + n :])]
    near, low = groups(texts, 0.8)
    assert 20 < len(near) < 60 and sum(len(shingles(texts[i]) & shingles(texts[j])) < 0.85 * len(shingles(texts[i]) | shingles(texts[j])) for i, j in near) > 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in N.near_copies(docs).collect()}
    assert all(got[i] == i or (i, got[i]) in near for i in got)  # no pair below 0.8
    assert sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near)
    kept = {r["doc_id"] for r in c.simhash_dedup(spark, docs, sf).collect()}
    assert kept == {i for i in got if got[i] == i}


def test_large_groups_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(120):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["component"] for r in N.near_copies(docs).collect()} == {0}
    monkeypatch.setattr(N, "HOT_BUCKET", 16)
    assert {r["component"] for r in N.near_copies(docs).collect()} == {0}


def test_no_link_of_a_full_bucket_is_left_out(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(400)]
    texts = []
    for i in range(70):  # all are near each other in bits, few pairs have a similarity of 0.8
        own = list(base)
        for p in rng.sample(range(0, 400, 5), rng.randint(5, 6)):
            own[p] = f"x{i}p{p}"
        texts.append(" ".join(own))
    near, low = groups(texts, 0.8)
    assert len(near) == 30 and len(set(low)) == 42
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(N, "masks", lambda: [0] * 15)  # one bucket
    assert {r["doc_id"]: r["component"] for r in N.near_copies(docs).collect()} == dict(enumerate(low))


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    texts = [" ".join([f"b{j}" for j in range(100)] + [f"x{i}"]) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(N, "HEAVY", 500)
    assert {r["component"] for r in N.near_copies(docs).collect()} == {0}


def test_edges(spark):
    rows = [(0, None), (1, ""), (2, "   "), (3, "one two"), (4, "One  two"), (5, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component"] for r in N.near_copies(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert N.near_copies(docs.limit(0)).count() == 0


def test_majority_over_many_hashes():
    rng = np.random.default_rng(1)
    per = np.array([0, 1, 254, 255, 256, 0, 2000])
    h = rng.integers(0, 1 << 63, per.sum()).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, per.sum()).astype(np.uint64)
    got, at = N._majority(h, per), 0
    for n, fp in zip(per, got, strict=True):
        own = h[at : at + n]
        at += n
        assert int(fp) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in own) > n)


def test_a_round_without_links_writes_no_labels(spark, monkeypatch):
    rng = random.Random(17)
    word = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(40):  # near enough to be compared, below 0.8
        base = rng.choices(word, k=200)
        texts += [" ".join(base), " ".join(base[:50] + rng.choices(word, k=21) + base[71:])]
    assert not groups(texts, 0.8)[0]
    tags, plain = [], N.written
    monkeypatch.setattr(N, "written", lambda s, df, tag: tags.append(tag) or plain(s, df, tag))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert all(r["doc_id"] == r["component"] for r in N.near_copies(docs).collect())
    assert tags.count("links") >= 2  # groups were compared in several rounds, each once
    assert len(tags) == 2 + len(N.rounds()) * 2 + 2 * tags.count("links")
