"""Near copies by Jaccard similarity: several SimHash fingerprints under covering masks, confirmed exactly.

Two shingle sets of Jaccard similarity J have a cosine of 2J/(1+J) at least, so a bit of their
SimHash differs with a probability of arccos(2J/(1+J))/pi at most: 0.152 at J = 0.8.  ``WORDS``
independent fingerprints of ``USED`` bits are dealt into the covering tables of ``RADIUS`` each;
at J = 0.8 one fingerprint shares a table with a probability of 0.258 and twelve with 0.972
(0.997 at J = 0.85).  Bucket mates are candidates if all bits of all fingerprints together differ
in :func:`most_apart` places at most, four deviations above what is expected of a pair at the
least similarity; a candidate counts only if the sets of its shingles, compared in full, are as
similar as asked.

The tables are read in rounds: two tables, the other tables of two fingerprints, then those of two
more fingerprints at a time.  Each round looks only at pairs whose texts are not linked yet, so
that a group does not meet itself in every table, and a round holds its own tables only.  A bucket
names its rows that have a candidate, as groups connected over candidates: one row for each member,
however many pairs there are; a group of the same members is looked at once, whatever the number of
tables that name it.  A group meets as a whole with the sets of its texts, and every pair in it that
is not linked yet is compared in full, breadth first; it emits links only, fewer than it has members.
No pair of a bucket is left out.  Buckets over ``HOT_BUCKET`` rows, and groups over ``HEAVY``
shingles, are cut into blocks and every pair of blocks is one group.

Defined results: repeated texts are one class; texts without words are near copies of each
other; a text of fewer words than a shingle is one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import discard, ship, written
from .components import components
from .op05_simhash import shingle_hashes

WORDS, USED, RADIUS = 12, 40, 3
DEVIATIONS = 4
HOT_BUCKET = 4096
#: Shingles of a block of a large group: two blocks are held at once.
HEAVY = 2_000_000
#: Byte to eight one-byte counters.
SPREAD = np.array([sum(1 << 8 * j for j in range(8) if b >> j & 1) for b in range(256)], np.uint64)


def masks() -> list[int]:
    """The covering masks of ``RADIUS`` over the ``USED`` low bits, codes dealt in turn."""
    n = (1 << (RADIUS + 1)) - 1
    return [sum(1 << i for i in range(USED) if bin((1 + i % n) & v).count("1") & 1) for v in range(1, n + 1)]


def rounds() -> list[list[tuple[int, int]]]:
    """Tables of each round."""
    n = len(masks())
    first = [(0, v) for v in range(2)]
    second = [(j, v) for j in range(2) for v in range(n) if (j, v) not in first]
    return [first, second, *[[(j + i, v) for i in range(2) for v in range(n)] for j in range(2, WORDS, 2)]]


def most_apart(least: float) -> int:
    """Bits of all fingerprints that two texts of a similarity of ``least`` differ in, at most but for one pair in thirty thousand."""
    bits = 64 * (WORDS + 1)
    p = math.acos(2 * least / (1 + least)) / math.pi
    return math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of ``a`` and each of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return out


def _sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text, and their number in each text."""
    h, per = shingle_hashes(raw, off, k)
    owner = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(per)).astype(np.int64)


def _majority(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from its hashes; zero for a text without any."""
    out = np.zeros(len(per), np.uint64)
    full = np.flatnonzero(per)
    if not len(full):
        return out
    size = per[full]
    parts = -(-size // 255)  # as many as one-byte counters hold
    base = np.repeat(np.cumsum(size) - size, parts)
    first = np.cumsum(parts) - parts
    cut = base + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    sums = np.add.reduceat(SPREAD[h.view(np.uint8).reshape(-1, 8)], cut, axis=0).view(np.uint8)
    ones = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    out[full] = np.packbits((2 * ones > size[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def signatures(docs: DataFrame, doc: str, text: str, shingle: int) -> DataFrame:
    """(_doc, key, fps) per row: a key of the text, the fingerprints and, last, the check fingerprint."""
    ship(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc).alias("_doc"), F.xxhash64(body).alias("key"), body.alias("_text"))

    shifts = [np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for j in range(WORDS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in W.chunks(batches, "_text"):
            h, per = _sets(raw, off, shingle)
            fps = [_majority(W.mix(h + s), per) for s in shifts]
            flat = np.column_stack(fps).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(per) + 1) * (WORDS + 1), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["_doc", "key", "fps"])

    return slim.mapInArrow(run, f"_doc {slim.schema['_doc'].dataType.simpleString()}, key long, fps array<long>")


def candidate_groups(fps: np.ndarray, label: np.ndarray, most: int) -> np.ndarray:
    """A group for each row of one bucket, -1 without a candidate: rows connected over pairs of different labels worth an exact comparison."""
    n = len(fps)
    group = np.full(n, -1)
    if (label == label[0]).all():
        return group
    near = None
    if n <= 512:
        near = (distances(fps, fps) <= most) & (label[:, None] != label[None, :])
        if not near.any():
            return group
    left = np.ones(n, bool)
    for s in range(n) if near is None else np.flatnonzero(near.any(axis=1)).tolist():
        if not left[s]:
            continue
        left[s], found, stack = False, [s], [s]
        while stack:
            x = stack.pop()
            rest = np.flatnonzero(left & (label != label[x]) if near is None else left & near[x])
            new = rest if near is not None else rest[distances(fps[x : x + 1], fps[rest])[0] <= most]
            left[new] = False
            found += new.tolist()
            stack += new.tolist()
        if len(found) > 1:
            group[found] = s
    return group


ROW = ("t", "k", "key", "label", *[f"f{j}" for j in range(WORDS + 1)])


def _bucket_groups(batches: Iterator[pa.RecordBatch], hot: int, most: int) -> Iterator[pa.RecordBatch]:
    """Members of groups (t = -1, k: a hash of the group's keys, key, label) of buckets in order; rows of buckets over ``hot`` as they are."""
    rest = np.zeros((0, len(ROW)), np.int64)

    def out(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=list(ROW))

    def runs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        edge = np.flatnonzero(np.concatenate(([True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1), [True])))
        size = np.diff(edge)
        key, label, fps = rows[:, 2], rows[:, 3], np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
        mixed = W.mix(key.view(np.uint64))
        two = edge[:-1][size == 2]
        two = two[label[two] != label[two + 1]]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]).sum(axis=1) <= most]
        at, groups = [np.column_stack([two, two + 1]).ravel()], [np.repeat(mixed[two] + mixed[two + 1], 2)]
        for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n > hot:
                yield out(rows[s : s + n].T)
                continue
            group = candidate_groups(fps[s : s + n], label[s : s + n], most)
            for g in np.unique(group[group >= 0]).tolist():
                own = s + np.flatnonzero(group == g)
                at.append(own)
                groups.append(np.full(len(own), mixed[own].sum(dtype=np.uint64)))
        own = np.concatenate(at)
        if len(own):
            members = np.unique(np.column_stack([np.concatenate(groups).view(np.int64), key[own], label[own]]), axis=0)
            columns = np.zeros((len(ROW), len(members)), np.int64)
            columns[0], columns[1:4] = -1, members.T
            yield out(columns)

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.concatenate([rest, np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(ROW))])])
        other = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        yield from runs(rows[:cut])
        rest = rows[cut:]
    yield from runs(rest)


def _in_buckets(rows: DataFrame, hot: int, most: int) -> DataFrame:
    dealt = rows.select(*ROW).repartition("t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInArrow(lambda it: _bucket_groups(it, hot, most), ", ".join(f"{c} long" for c in ROW))


def _blocked(rows: DataFrame, by: str) -> DataFrame:
    """Rows of groups ``by`` of ``n`` blocks, each once for every block of its group: ``by`` becomes a pair of blocks, and two rows of a group meet in one."""
    own = rows.withColumn("b", F.pmod(F.xxhash64("key"), "n"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return own.withColumn(by, F.xxhash64(by, F.least("b", "o"), F.greatest("b", "o"))).drop("b", "o", "n")


def grouped(classes: DataFrame, tables: list[tuple[int, int]], least: float = 0.8, tested: list[DataFrame] | None = None) -> DataFrame:
    """(g, key, label): groups that hold every pair of class keys of different labels that share one of the ``tables`` and are near enough.

    ``classes``: key, label, fps; a table is a fingerprint's number and a mask's.  A group of the same
    members as one of ``tested`` is left out: it was compared before.
    """
    spark = classes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    m, most = masks(), most_apart(least)
    cover = F.array(*[F.struct(F.lit(j * len(m) + v).cast("long").alias("t"), F.lit(j + 1).alias("j"), F.lit(m[v]).alias("m")) for j, v in tables])
    rows = classes.repartition(tasks, "key").select("key", "label", "fps", F.explode(cover).alias("c"))
    rows = rows.select("c.t", F.element_at("fps", F.col("c.j")).bitwiseAND(F.col("c.m")).alias("k"), "key", "label", *[F.element_at("fps", j + 1).alias(f"f{j}") for j in range(WORDS + 1)])
    found = written(spark, _in_buckets(rows, HOT_BUCKET, most), "bucket-groups")
    member = (F.col("k").alias("g"), "key", "label")
    members = found.filter("t = -1").select(*member)
    hot = found.filter("t >= 0")
    if not hot.isEmpty():
        blocks = hot.groupBy("t", "k").agg(F.ceil(F.count("*") / HOT_BUCKET).alias("n"))
        cells = _blocked(hot.join(blocks, ["t", "k"]), "k")
        members = members.unionByName(_in_buckets(cells, 1 << 30, most).select(*member))
    members = members.distinct()
    if tested:
        members = members.join(reduce(DataFrame.unionByName, tested).select("g").distinct(), "g", "left_anti")
    out = written(spark, members, "groups")
    discard(found)
    return out


def links_of(label: np.ndarray, size: np.ndarray, h: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Index pairs that link the rows of one group, breadth first over all pairs that are as similar as asked.

    ``h``: the sets row by row.  Rows of one label are linked already.
    """
    n, found = len(label), []
    ids = np.unique(h, return_inverse=True)[1]
    owner, off = np.repeat(np.arange(n), size), np.concatenate(([0], np.cumsum(size)))
    mark, left, every, held = np.zeros(len(ids) + 1, bool), np.ones(n, bool), ids, n
    while left.any():
        stack = np.flatnonzero(left & (label == label[np.argmax(left)])).tolist()
        left[stack] = False
        while stack:
            x = stack.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return found
            if 2 * len(rest) < held:  # only rows not reached yet are looked at
                kept = left[owner]
                ids, owner, held = ids[kept], owner[kept], len(rest)
            mark[every[off[x] : off[x + 1]]] = True
            common = np.bincount(owner[mark[ids]], minlength=n)[rest]
            mark[every[off[x] : off[x + 1]]] = False
            union = size[x] + size[rest] - common
            new = rest[np.where(union > 0, common / np.maximum(union, 1), 1.0) >= least]  # no shingles at all: equal
            if len(new):
                found += [(x, int(y)) for y in new]
                reached = np.flatnonzero(left & np.isin(label, label[new]))
                left[reached] = False
                stack += reached.tolist()
    return found


def _linked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of groups in order; rows: g, key, label, s."""

    def links(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        if rows.num_rows < 2:
            return
        g, key, label = (rows.column(i).to_numpy() for i in range(3))
        lists = rows.column(3).chunk(0)
        off = lists.offsets.to_numpy()
        h = lists.values.to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        us, vs = [], []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for i, j in links_of(label[s:e], np.diff(off[s : e + 1]), h[off[s] : off[e]], least):
                us.append(key[s + i])
                vs.append(key[s + j])
        if us:
            u, v = np.array(us, np.int64), np.array(vs, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).to_numpy()
        if rest and rest[-1].column(0)[0].as_py() != g[0]:
            yield from links(rest)
            rest = []
        last = int(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))[-1])
        if last:
            yield from links([*rest, b.slice(0, last)])
            rest = []
        rest.append(b.slice(last))
    if rest:
        yield from links(rest)


def confirmed(groups: DataFrame, docs: DataFrame, text: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of pairs in groups whose sets of shingles have a Jaccard similarity of ``least`` or more, and the written sets they are read from."""
    body = F.coalesce(F.col(text), F.lit(""))
    touched = groups.select("key").distinct()
    texts = docs.select(F.xxhash64(body).alias("key"), body.alias("_text")).join(touched, "key", "left_semi").groupBy("key").agg(F.first("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in W.chunks(batches, "_text"):
            h, per = _sets(raw, off, shingle)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "s"])

    sets = written(docs.sparkSession, texts.mapInArrow(run, "key long, s array<long>"), "shingle-sets")
    heavy = groups.join(sets.select("key", F.size("s").cast("long").alias("w")), "key").groupBy("g").agg(F.ceil(F.sum("w") / HEAVY).alias("n")).filter("n > 1")
    if not heavy.isEmpty():
        large = groups.join(heavy, "g")
        groups = groups.join(heavy, "g", "left_anti").unionByName(_blocked(large, "g"))
    dealt = groups.join(sets, "key").select("g", "key", "label", "s").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(lambda it: _linked(it, least), "u long, v long").distinct(), sets


def near_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc, component): component is the smallest doc reachable over confirmed pairs."""
    spark = docs.sparkSession
    own = written(spark, signatures(docs, doc, text, shingle), "signatures")
    classes = written(spark, own.groupBy("key").agg(F.min("_doc").alias("low"), F.first("fps").alias("fps")), "classes")
    apart, labels, links, tested = classes.withColumn("label", F.col("key")), None, [], []
    for tables in rounds():
        groups = grouped(apart, tables, least, tested)
        if groups.isEmpty():
            discard(groups)
            continue
        found, sets = confirmed(groups, docs, text, shingle, least)
        new = written(spark, found, "links")
        tested.append(groups)
        discard(sets)
        if new.isEmpty():  # the labels stay as they are
            discard(new)
            continue
        links.append(new)
        roots = components(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("key"), F.col("root").alias("label"))
        before, labels = labels, written(spark, classes.join(roots, "key", "left").withColumn("label", F.coalesce("label", "key")), "labels")
        apart = labels
        discard(*([before] if before is not None else []))
    discard(*tested, *links, *([classes] if links else []))  # without links the labels are those of the classes
    rooted = apart.select("key", "low", F.col("label").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").select("key", "component")
    return own.select(F.col("_doc").alias(doc), "key").join(named, "key").select(doc, "component")
