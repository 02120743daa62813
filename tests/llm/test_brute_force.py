"""Operators without SQL against plain Python."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from talentgrid.llm import encode, op04_packing, op05_simhash, op08_tokenfile, op10_sharding
from talentgrid.llm import words as W
from talentgrid.llm.common import scratch_path

P = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", "a", " a", "a ", "a  b", "\n", "\n\nx", "x\n\ny", "x\ty", "<|endoftext|>", "foo<|endoftext|>bar baz", "a <|endoftext|> b <|startoftext|>",
    "don't stop, won't.", "a b", "naïve Éa İstanbul ΣΑΣ", "éa b́", "中文 字符, 好", "12 3.5 x1", "a\r\nb", "\x1cfoo \x85bar",
    "tail, word, tail! word", "  ", "emoji \U0001f600 x", "ß ẞ STRASSE", "The word\nThe word, the word", "w " * 3000,
]


def plain_ids(path, text, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(path))
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("control", [True, False])
def test_encoder_gives_the_ids_of_a_plain_call(path, spaced, control):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(path))
    tok.encode_special_tokens = not control
    enc = encode.Encoder(P.path(path), spaced, control)
    for texts in (TEXTS, TEXTS[::-1], ["x"], [None], []):
        raw, off = W.buffer_of(pa.array(texts, pa.string()))
        ids, bound = enc.encode(raw, off, 7)
        got = [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:], strict=True)]
        assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_packing_pieces(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = op04_packing.pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    want = []
    for i, t in enumerate(TEXTS):
        ids = plain_ids("byte_bpe_50k.json", t, 2)
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)


def test_search_empties_a_bin_that_best_fit_decreasing_leaves():
    sizes = np.array([6, 4, 4, 3, 3])  # best fit decreasing: 6+4, 4+3+3; and worse starts below
    assert len(op04_packing.best_fit(sizes, 10)) == 2
    bins = op04_packing._Search(sizes.tolist(), [[0, 3], [1, 4], [2]], 10).run(6)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4]
    assert all(sum(int(sizes[i]) for i in b) <= 10 for b in bins)


def test_token_files_ids(spark):
    rows = [(i - 3, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = op08_tokenfile.write_token_files(docs, scratch_path(spark, "t"), P.path("word_bpe_49k.json"))
    got = sorted(tuple(r) for r in op08_tokenfile.read_token_files(manifest).collect())
    at, want = 0, []
    for i, t in rows:
        ids = plain_ids("word_bpe_49k.json", t, 1)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "One two", "one  TWO", "Été ß x y z w"]
    for _ in range(25):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 200))]
        for _ in range(3):
            own = list(base)
            own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(own))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, component string, fp int")
    got = {r["doc_id"]: r for r in op05_simhash.near_duplicates(df.select("doc_id", "text")).collect()}
    fps = [fingerprint(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    low = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    low[i] = low[j] = min(low[i], low[j])
    assert [got[i]["component"] for i in range(len(texts))] == low
    clash = {r["doc_id"]: r["component"] for r in op05_simhash.near_duplicates(df).collect()}
    assert clash == {i: c for i, c in enumerate(low)}


def test_many_links_at_one_fingerprint(spark):
    base = 0x123456789ABCDEF0
    fps = sorted({base} | {base ^ (1 << a) for a in range(64)} | {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)})
    df = spark.createDataFrame([(op05_simhash._signed(x),) for x in fps], "fp long")
    links = op05_simhash.near_links(df).collect()
    parent = {op05_simhash._signed(x): op05_simhash._signed(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[root(r["u"])] = root(r["v"])
    assert len({root(x) for x in parent}) == 1


def sharded(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, shard string, size int").repartition(3)
    return {r["doc_id"]: r for r in op10_sharding.shard(df, **options).collect()}


def test_sharding_balance_groups_and_slots(spark):
    rng = random.Random(4)
    texts = [None, ""] + [f"g{i} " + "t " * rng.randrange(1, 60) for i in range(500) for _ in range(rng.choice((1, 1, 1, 2, 9)))]
    texts += ["a third of all rows"] * (len(texts) // 2)  # above an even share: the only group that is split
    got = sharded(spark, texts)
    assert len(got) == len(texts)
    load, slots, of = [0] * 8, {}, {}
    for i, t in enumerate(texts):
        r = got[i]
        raw = (t or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault(t or "", set()).add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load) - min(load) <= 0.02 * sum(load) / 8
    assert [t for t, s in of.items() if len(s) > 1] == ["a third of all rows"]


def test_sharding_ties_and_one_group(spark):
    got = sharded(spark, ["same"] * 40)
    count = np.bincount([r["shard"] for r in got.values()], minlength=8)
    assert count.sum() == 40 and max(count) - min(count) <= 8
