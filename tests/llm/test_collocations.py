"""Collocations: brute force on small tables, chunks of any size, edges."""

import random
import re
from collections import Counter, defaultdict

from talentgrid.llm import op11_collocations as C

DOCS = "doc_id long, text string, lang string, g string, chunk long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support=10, longest=3, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        gone = {p[i:j] for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 50 * cands.get(p[i:j], 10**9)}
        kept = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, l, rest, n[lang], -s) for r, (s, a, p, l, rest) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def mined(df, **more):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in C.mine(df, **more).collect())


def texts(rng, n):
    words = ["a", "B", "cé", "dd", "\u00a0x", "e-f", "ZZ", "q\u2028r"]
    seps = [" ", "\t", "  ", ". ", ",", "\n", " ", " ", " "]
    return [(i, "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60))), rng.choice(["en", "x y", None]), "g", 1) for i in range(n)]


def test_brute_force_whatever_the_chunks(spark, monkeypatch):
    rows = texts(random.Random(2), 300)
    df = spark.createDataFrame(rows, DOCS)
    want = brute(rows)
    assert mined(df) == want and len(want) > 100
    monkeypatch.setattr(C, "CHUNK_BYTES", 400)
    monkeypatch.setattr(C, "SLICE_BYTES", 150)
    monkeypatch.setattr(C, "ENTRIES", 50)
    monkeypatch.setattr(C, "SALTS", 3)
    assert mined(df) == want
    assert mined(df, top=7) == brute(rows, top=7)
    assert mined(df, support=4, longest=5) == brute(rows, support=4, longest=5)
    assert mined(df, longest=2) == brute(rows, longest=2)


def test_nulls_ties_long_text_and_nothing(spark):
    assert mined(spark.createDataFrame([], DOCS)) == []
    assert mined(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "", 1), (None, " . ;\n", "en", "", 1)], DOCS)) == []
    long = "one two three " * 200_000 + "x"
    rows = [(1, long, "en", "g", 1), (2, "p q. r s. " * 12, None, "g", 1), (2, "p q. r s. " * 12, None, "g", 1), (3, "P Q", "und", "g", 1)]
    assert mined(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_exact_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits: the expression of the query on such counts."""
    a, left, r = 3_000_000_007, 3_000_000_011, 3_100_000_019
    x = spark.createDataFrame([(a, left, r)], "a long, l long, r long")
    number = "cast({} as decimal(16,0))".format
    got = x.selectExpr(f"{number('a')} * {number('a')} * 1000000 div ({number('l')} * {number('r')}) as s").first()[0]
    assert got == 1000000 * a * a // (left * r)
