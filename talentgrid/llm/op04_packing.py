"""Best-fit packing with swap-based local search.

Documents become ids once; a document longer than a sequence is cut, its first piece takes
what is left over and the others fill a sequence each.  What remains to pack is one piece per
document.  The pieces are dealt into groups of about ``GROUP`` by a hash; each group is packed
in one task of bounded memory: best-fit decreasing first, then a local search over the
underfull bins.  A step moves a piece, or exchanges one for one or one for two, from an
emptier to a fuller bin so that the sum of squared fills grows; bins that run empty are
dropped.  A group wastes less than a bin more than a pack of all groups at once would gain,
so the loss does not grow with the number of rows in a group.

Defined results: a null text is empty and has the end id alone; repeated rows are separate
documents; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import ship, table, written
from .encode import CACHE_UNITS, CHUNK_BYTES, encoder

CAPACITY = 1024
END_ID = 2
GROUP = 40_000
ROUNDS = 6


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the fullest open bin that still takes the piece."""
    bins: list[list[int]] = []
    open_: dict[int, list[int]] = defaultdict(list)  # room left: bins
    rooms = 0  # bit r: some bin has room r
    order = np.argsort(-sizes, kind="stable").tolist()
    size = sizes.tolist()
    for i in order:
        s = size[i]
        fit = rooms >> s
        if fit:
            room = s + ((fit & -fit).bit_length() - 1)
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= s
        else:
            b = len(bins)
            bins.append([i])
            room = capacity - s
        if room:
            open_[room].append(b)
            rooms |= 1 << room
    return bins


class _Search:
    """Local search over the underfull bins of one group."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.size, self.bins, self.capacity = sizes, bins, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.at: dict[int, dict[int, int]] = defaultdict(dict)  # size: piece: bin, of underfull bins
        self.present = 0
        for b, f in enumerate(self.fill):
            if f < capacity:
                for i in bins[b]:
                    self._list(i, b)

    def _list(self, i: int, b: int) -> None:
        self.at[self.size[i]][i] = b
        self.present |= 1 << self.size[i]

    def _unlist(self, i: int) -> None:
        s = self.size[i]
        own = self.at[s]
        own.pop(i, None)
        if not own:
            self.present &= ~(1 << s)

    def _largest(self, most: int, least: int, target: int) -> int | None:
        """A piece of the largest size in [least, most] from a bin no fuller than the target."""
        while most >= least:
            have = self.present & ((1 << (most + 1)) - 1)
            s = have.bit_length() - 1
            if s < least:
                return None
            for n, (i, b) in enumerate(self.at[s].items()):
                if b != target and self.fill[b] <= self.fill[target]:
                    return i
                if n == 8:
                    break
            most = s - 1
        return None

    def _move(self, out: list[int], into: list[int], target: int, source: int) -> None:
        """Exchange pieces ``out`` of the target for ``into`` of the source."""
        for i in out:
            self.bins[target].remove(i)
            self.bins[source].append(i)
        for i in into:
            self.bins[source].remove(i)
            self.bins[target].append(i)
        gain = sum(self.size[i] for i in into) - sum(self.size[i] for i in out)
        self.fill[target] += gain
        self.fill[source] -= gain
        for i in out:
            self._list(i, source)
        if self.fill[target] == self.capacity:
            for i in self.bins[target]:
                self._unlist(i)
            for i in out:
                self._list(i, source)
        else:
            for i in into:
                self._list(i, target)

    def _step(self, target: int) -> bool:
        gap = self.capacity - self.fill[target]
        best: tuple[int, list[int], list[int], int] | None = None
        i = self._largest(gap, 1, target)
        if i is not None:
            best = (self.size[i], [], [i], self.at[self.size[i]][i])
        own = sorted(self.bins[target], key=self.size.__getitem__)
        for o in own:  # one for one
            if best and best[0] == gap:
                break
            s = self.size[o]
            i = self._largest(s + gap, s + 1 + (best[0] if best else 0), target)
            if i is not None:
                best = (self.size[i] - s, [o], [i], self.at[self.size[i]][i])
        if not best or best[0] < gap:  # two of the target for one of the source
            for x in range(len(own)):
                for y in range(x + 1, min(len(own), x + 4)):
                    s = self.size[own[x]] + self.size[own[y]]
                    i = self._largest(s + gap, s + 1 + (best[0] if best else 0), target)
                    if i is not None:
                        best = (self.size[i] - s, [own[x], own[y]], [i], self.at[self.size[i]][i])
        if not best or best[0] < gap:  # one of the target for two of one source
            for o in own[-3:]:
                want = self.size[o] + gap
                i = self._largest(want - 1, 1, target)
                if i is None:
                    continue
                source = self.at[self.size[i]][i]
                for j in self.bins[source]:
                    both = self.size[i] + self.size[j] - self.size[o]
                    if j != i and (best[0] if best else 0) < both <= gap:
                        best = (both, [o], [i, j], source)
        if not best:
            return False
        _, out, into, source = best
        for k in into:
            self._unlist(k)
        self._move(out, into, target, source)
        return True

    def run(self, rounds: int) -> list[list[int]]:
        for _ in range(rounds):
            order = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: -self.fill[b])
            changed = False
            for b in order:
                while 0 < self.fill[b] < self.capacity and self._step(b):
                    changed = True
            if not changed:
                break
        return [b for b in self.bins if b]


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    bins = _Search(sizes.tolist(), best_fit(sizes, capacity), capacity).run(rounds)
    bin_, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for b, own in enumerate(bins):
        at = 0
        for i in own:
            bin_[i], offset[i] = b, at
            at += int(sizes[i])
    return bin_, offset


def pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, spaced: bool = True, with_ids: bool = False, chunk: int = CHUNK_BYTES, units: int = CACHE_UNITS) -> DataFrame:
    """One row per piece: _uid (unique), doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Smaller ``chunk`` (bytes of text encoded at once) and ``units`` (kept by a worker) take less memory and more time.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, spaced, most=units)
        uid = TaskContext.get().partitionId() << 40
        for part, raw, off in W.chunks(batches, "text", chunk):
            ids, bound = enc.encode(raw, off, end_id)
            ids = ids.astype("<u4")
            size = np.diff(bound)
            count = (size - 1) // capacity + 1
            owner = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            first = (size - 1) % capacity + 1
            start = np.where(piece > 0, first[owner] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[owner])
            view, at = memoryview(ids.tobytes()), 4 * (bound[owner] + start)
            raws = [view[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            cols = [pa.array(uid + np.arange(len(owner))), part.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, raws), pa.int64())]
            uid += len(owner)
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(map(bytes, raws), pa.binary())] if with_ids else [])], names=["_uid", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = "_uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def pack(own: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``own`` must be a written table."""
    part = own.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_uid", ignore_index=True)
        bin_, offset = pack_group(rows["length"].to_numpy(), capacity)
        return pd.DataFrame({"_uid": rows["_uid"], "sequence_id": (key[0] << 40) + bin_, "offset": offset})

    dealt = part.select("_uid", "length", F.pmod(F.xxhash64("_uid"), F.lit(groups)).alias("_group"))
    placed = dealt.groupBy("_group").applyInPandas(run, "_uid long, sequence_id long, offset long")
    cut = own.join(placed, "_uid")
    full = own.filter(F.col("length") == capacity).withColumns({"sequence_id": -F.col("_uid") - 1, "offset": F.lit(0).cast("long")})
    return cut.unionByName(full).drop("_uid")


def pack_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Whole documents to placed pieces; ``with_ids=True`` carries each piece's ids along."""
    spark = docs.sparkSession
    return pack(written(spark, pieces(docs, vocabulary, **options), "pieces"), options.get("capacity", CAPACITY))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 byte-level ids."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
