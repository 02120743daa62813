"""The corpus pipeline, stage by stage, on the smallest folder and against brute force."""

import re
from collections import Counter

import corpus_pipeline as c
from talentgrid.llm.common import table, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_dedup(rows):
    """Rows (doc_id, text, place) left of each group linked by a Jaccard similarity of 0.8."""
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (both / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, at) in enumerate(rows):
        least.setdefault(find(i), []).append((d is None, d or 0, at))
    return {min(v)[2] for v in least.values()}


def brute_windows(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w, t in zip(words, texts, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone) if gone else t)
    return out


def brute_clean(text, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(word, (t or "").translate({i: i + 32 for i in range(65, 91)}))
    w = low(text)
    for item in items:
        x = low(item)
        n = min(10, len(x))
        if n and {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}:
            return False
    return True


def test_stages(spark, sf):
    assert [n for n, _ in c.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "decontaminate", "best_fit_packing"]
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, []
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    for name, stage in c.STAGES[:-1]:
        before = docs.orderBy("doc_id").collect()
        docs = written(spark, stage(spark, docs, sf), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "simhash_dedup":
            assert set(after) == brute_dedup([(r["doc_id"], r["text"], r["doc_id"]) for r in before])
        if name == "substring_dedup":
            assert after == dict(zip([r["doc_id"] for r in before], brute_windows([r["text"] for r in before]), strict=True))
        if name == "decontaminate":
            assert set(after) == {r["doc_id"] for r in before if brute_clean(r["text"], items)}
        kept.append(len(after))
    packed = c.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(after) and kept == sorted(kept, reverse=True) and kept[-1] > 50


def test_dedup_is_of_rows_not_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "ABCDE"}
    rows = [(1, "A"), (2, "A"), (2, "B"), (5, "C"), (5, "C"), (None, "D"), (None, "D"), (7, "D"), (9, "E")]
    docs = spark.createDataFrame([(i, text[t], "en", "s", 1) for i, t in rows], DOCS)
    left = sorted((r["doc_id"], r["text"][0]) for r in c.simhash_dedup(spark, docs, "").collect())
    assert left == [(1, "A"), (2, "B"), (5, "C"), (7, "D"), (9, "E")]
