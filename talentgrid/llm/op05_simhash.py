"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints: 64 bits by majority over the XXH64 of word shingles.  Tables: with radius r,
bit i of a fingerprint has a code vector c(i) of r+1 bits, and the mask of table v (every
nonzero vector of r+1 bits) holds the bits whose code vector has an odd product with v.  Two
fingerprints that differ in at most r bits agree under at least one mask: the r code vectors
of the differing bits leave a vector v orthogonal to them all.  No pair is missed.

Work is done on distinct fingerprints, so a group of exact copies is one row.  Inside a
bucket only a spanning forest of the links is emitted, never its pairs.  Buckets over
``HOT_BUCKET`` rows are dealt again by the segments of their free bits (pigeonhole: a pair
within r bits agrees on one of r+1 segments).

Defined results: a text without words (null, empty) has fingerprint zero and is linked like
any other; repeated rows share their class; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import words as W
from .common import ship, table, written
from .components import components

BITS = 64
SEED = 42
HOT_BUCKET = 4096


def code_vectors(radius: int) -> list[int]:
    """One nonzero vector of radius+1 bits for each of the 64 bits, so that masks stay wide.

    Up to radius 5 the nonzero vectors are dealt in turn.  At radius 6 they are (1, i), the
    first-order Reed-Muller code, whose masks hold 32 bits or all 64; at radius 7 a bent
    function of i joins them, and masks hold 28 bits or more.  Beyond, a fixed multiplicative
    sequence spreads them.
    """
    n = (1 << (radius + 1)) - 1
    if radius == 6:
        return [64 + i for i in range(BITS)]
    if radius == 7:
        bent = [(i & 1) & (i >> 1) ^ (i >> 2 & 1) & (i >> 3) ^ (i >> 4 & 1) & (i >> 5) for i in range(BITS)]
        return [64 + i + 128 * (b & 1) for i, b in enumerate(bent)]
    if n < BITS:
        return [1 + i % n for i in range(BITS)]
    step = next(s for s in range(int(n * 0.618), n) if np.gcd(s, n) == 1)
    return [1 + (i * step) % n for i in range(BITS)]


def covering_masks(radius: int) -> list[int]:
    """The 2**(radius+1) - 1 masks, as unsigned integers."""
    codes = code_vectors(radius)
    return [sum(1 << i for i in range(BITS) if bin(codes[i] & v).count("1") & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts of one chunk, in order, and their number in each text."""
    low = W.LOWER[raw]
    starts, ends, first = W.spans(low, off, W.NON_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    keep = W.NON_SPACE[low]  # words and one separator after each
    sep = ends[ends < len(low)]
    sep = sep[~keep[sep]]
    low[sep] = 0x20
    keep[sep] = True
    place = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    flat = memoryview(low[keep].tobytes())
    s, e = place[starts], place[ends - 1] + 1
    sizes = np.diff(first)
    per = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    base = np.cumsum(per) - per
    at = np.repeat(first[:-1] - base, per) + np.arange(per.sum())
    last = at + np.repeat(np.minimum(sizes, k), per) - 1
    h = np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in zip(s[at].tolist(), e[last].tolist(), strict=True)), np.uint64, len(at))
    return h, per


def _fingerprints(raw: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the texts of one chunk."""
    h, per = shingle_hashes(raw, off, k)
    out = np.zeros(len(per), np.uint64)
    if not len(h):
        return out
    full = np.flatnonzero(per)
    ones = np.empty((len(full), BITS), np.int64)
    bytes_ = h.view(np.uint8).reshape(-1, 8)
    step = 1 << 15
    ones[:] = 0
    owner = np.repeat(np.arange(len(full)), per[full])
    for i in range(0, len(h), step):  # bounded blocks of unpacked bits
        bits = np.unpackbits(bytes_[i : i + step], axis=1, bitorder="little")
        own = owner[i : i + step]
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        np.add.at(ones, own[cut], np.add.reduceat(bits, cut, axis=0, dtype=np.int32))
    set_ = (2 * ones > per[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc, fp) per row; fp is the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in W.chunks(batches, "_text"):
            fp = _fingerprints(raw, off, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["_doc", "fp"])

    return slim.mapInArrow(run, f"_doc {slim.schema['_doc'].dataType.simpleString()}, fp long").withColumnRenamed("_doc", doc)


def _links(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Index pairs whose closure links all fingerprints within the radius of each other.

    Each group is walked breadth first against the rows that no group has yet, so neither its
    pairs nor a matrix of all rows is held.
    """
    n = len(fp)
    if n <= HOT_BUCKET:
        left = np.arange(n)
        while len(left) > 1:
            root, rest = left[0], left[1:]
            front = left[:1]
            while len(front) and len(rest):
                hit = np.zeros(len(rest), bool)
                for i in range(0, len(front), 256):
                    hit |= (np.bitwise_count(fp[front[i : i + 256], None] ^ fp[rest][None, :]) <= radius).any(axis=0)
                front, rest = rest[hit], rest[~hit]
                yield from ((int(root), int(x)) for x in front)
            left = rest
        return
    free = np.bitwise_or.reduce(fp ^ fp[0])  # bits in which the bucket differs
    pos = [i for i in range(BITS) if int(free) >> i & 1]
    for j in range(radius + 1):
        seg = np.uint64(sum(1 << i for i in pos[j :: radius + 1]))
        key = fp & seg
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0, [True])))
        for s, t in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if t - s > 1:
                part = order[s:t]
                for x, y in _links(fp[part], radius):
                    yield int(part[x]), int(part[y])


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket; a bucket may go on in the next batch."""
    rest_key = np.zeros((0, 2), np.int64)
    rest_fp = np.zeros(0, np.uint64)

    def runs(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fp):
            return
        same = np.all(key[1:] == key[:-1], axis=1)
        edge = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        size = np.diff(edge)
        us, vs = [], []
        two = edge[:-1][size == 2]  # most shared buckets hold two rows
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        us.append(fp[two[near]])
        vs.append(fp[two[near] + 1])
        for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = fp[s : s + n]
            pairs = list(_links(own, radius))
            if pairs:
                x, y = np.array(pairs, np.int64).T
                us.append(own[x])
                vs.append(own[y])
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        key = np.column_stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)])
        fp = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        key, fp = np.concatenate([rest_key, key]), np.concatenate([rest_fp, fp])
        cut = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1 if np.any(key != key[-1]) else 0
        yield from runs(key[:cut], fp[:cut])
        rest_key, rest_fp = key[cut:], fp[cut:]
    yield from runs(rest_key, rest_fp)


def _in_buckets(rows: DataFrame, radius: int) -> DataFrame:
    dealt = rows.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInArrow(lambda it: _bucket_links(it, radius), "u long, v long")


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links u, v between distinct fingerprints whose closure links every pair within the radius."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    rows = fps.select("fp", F.posexplode(masks).alias("t", "m")).select(F.col("t").cast("long").alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")
    hot = rows.groupBy("t", "k").count().filter(F.col("count") > HOT_BUCKET).select("t", "k", F.lit(True).alias("hot"))
    hot = written(fps.sparkSession, hot, "hot-buckets")
    if hot.isEmpty():
        return _in_buckets(rows, radius)
    marked = rows.join(hot, ["t", "k"], "left")
    n = radius + 1
    segments = F.array(*[F.lit(_signed(sum(1 << i for i in range(j, BITS, n)))) for j in range(n)])
    again = (
        marked.filter("hot")
        .select("t", "k", "fp", F.posexplode(segments).alias("j", "s"))
        .select((F.col("t") + F.lit(1 << 20) * (F.col("j") + 1)).alias("t"), F.xxhash64("k", F.col("fp").bitwiseAND(F.col("s"))).alias("k"), "fp")
    )
    return _in_buckets(marked.filter("hot is null"), radius).unionByName(_in_buckets(again, radius))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc, fp, component): component is the smallest doc reachable over links within the radius."""
    spark = docs.sparkSession
    own = written(spark, fingerprints(docs, doc, text, shingle), "fingerprints")
    classes = written(spark, own.groupBy("fp").agg(F.min(doc).alias("low")), "classes")
    links = components(written(spark, near_links(classes.select("fp"), radius), "links"))
    grouped = classes.join(links.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component"))
    labels = grouped.join(lowest, "root").select("fp", "component")
    return own.join(labels, "fp").select(doc, "fp", "component")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component: 4-word shingles, radius 4."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
