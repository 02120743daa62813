"""Substring dedup by level-wise doubling.

A window of 35 words is repeated only if every shorter window inside it is.  Levels:

1. Seeds of 8 words.  Of all 8-word windows inside a 35-word window the one with the least
   hash (the leftmost of equals) is its seed, so equal windows have equal seeds and about
   one position in fourteen is a seed.  Seeds that occur once drop all their windows.
2. Of the seeds that are left, the *stretch* is the text under all windows that have this
   seed (35 to 62 words).  Stretches that occur twice or more are repeated as a whole: every
   window in them is.  One copy of each different stretch goes on.
3. Stretches that share a seed but differ are taken apart: windows of 16, 32 and at last 35
   words around the seed, each length only where the one before was repeated.

A group is always counted by an aggregation with a map-side part and joined back, so a seed
that a third of all rows share is split like any skewed join.  Keys pair the seed's hash with
an independent hash of the longer text (128 bits).

Defined results: a null text has no words; a row is known by its id and its text, so rows
that repeat an id are told apart and equal rows count as copies; other columns are kept; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import discard, ship, table, written

WINDOW = 35
SEED = 8


def _lengths(window: int, seed: int) -> list[int]:
    """Twice the seed's length and so on, and the window's length at last."""
    out, n = [], 2 * seed
    while n < window:
        out.append(n)
        n *= 2
    return [*out, window]


def _argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least value in each run of ``w`` values."""
    best = np.arange(len(x))
    width = 1
    while 2 * width <= w:  # doubling
        a, b = best[:-width], best[width:]
        best = np.where(x[b] < x[a], b, a)
        width *= 2
    if (rest := w - width) > 0:
        a, b = best[:-rest], best[rest:]
        best = np.where(x[b] < x[a], b, a)
    return best


def _seeds(raw: np.ndarray, off: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each seed: its text's index, seed hash, first window's start word, windows, stretch hash, seed's place."""
    starts, ends, first = W.spans(raw, off, W.NON_SPACE)
    h = W.hash_words(raw, starts, ends)
    none = np.zeros(0, np.int64)
    ok = W.windows_inside(first, window)
    if not ok.any():
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64), none
    g = W.hash_windows(h, seed)
    least = _argmin(g, window - seed + 1)[: len(ok)]
    at = np.flatnonzero(ok)  # start words of all windows
    own = least[at]
    text = np.searchsorted(first, at, "right") - 1
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (np.diff(text) != 0))))
    n = np.diff(np.concatenate((cut, [len(at)])))
    a = at[cut]
    other = W.hash_words(raw, starts, ends, 1)  # independent of the seeds' hashes
    stretch = W.hash_ranges(other, a, a + n + window - 1)
    return text[cut], g[own[cut]], a - first[text[cut]], n, stretch, own[cut] - a


def seeds(rows: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Level 1 rows of (_rid, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in W.chunks(batches, "_text"):
            text, g, a, n, stretch, at = _seeds(raw, off, window, seed)
            rid = part.column(0).take(pa.array(text))
            cols = [rid, pa.array(g.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int8)), pa.array(at.astype(np.int8)), pa.array(stretch.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["_rid", "g", "a", "n", "at", "stretch"])

    return rows.select("_rid", "_text").mapInArrow(run, "_rid long, g long, a int, n byte, at byte, stretch long")


def _expand(batches: Iterator[pa.RecordBatch], length: int, window: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Of each row with word hashes: its texts of ``length`` words, with the windows that depend on each.

    A window looks at the text of that length around its seed, moved as little as keeps it
    inside; equal windows look at equal texts.
    """
    for b in batches:
        if not b.num_rows:
            continue
        c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        at, n, alive = (c[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "n", "alive"))
        raw = c["ctx"].cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        h = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64)
        base = (offsets[:-1] - offsets[0]) // 8
        row = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        on = (alive[row] >> i & 1).astype(bool)
        row, i = row[on], i[on]
        if not len(row):
            continue
        s = np.clip(at[row] - (length - seed) // 2, i, i + window - length)
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(s) != 0))))
        mask = np.bitwise_or.reduceat(np.left_shift(1, i), cut)
        r = row[cut]
        lo = base[r] + s[cut]
        key = W.hash_ranges(h, lo, lo + length)
        idx = pa.array(r)
        yield pa.RecordBatch.from_arrays([c["_rid"].take(idx), c["a"].take(idx), c["g"].take(idx), pa.array(key.view(np.int64)), pa.array(mask)], names=["_rid", "a", "g", "key", "mask"])


def _contexts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Word hashes of the stretches listed with each text."""
    for part, raw, off in W.chunks(batches, "_text"):
        starts, ends, first = W.spans(raw, off, W.NON_SPACE)
        h = W.hash_words(raw, starts, ends, 1)
        lists = part.column(part.schema.get_field_index("own"))
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        a, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "n"))
        lo = first[doc] + a
        ctx = [h[x:y].tobytes() for x, y in zip(lo.tolist(), (lo + n + window - 1).tolist(), strict=True)]
        cols = [part.column(0).take(pa.array(doc)), *(flat.field(k) for k in ("g", "a", "n", "at", "k")), pa.array(ctx, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["_rid", "g", "a", "n", "at", "k", "ctx"])


def _rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(doc), F.col(text)).alias("_rid"), F.col(text).alias("_text"))


def repeated_windows(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(_rid, a, mask): bit i of mask says that the window at word a+i occurs elsewhere too."""
    if not seed <= window <= seed + 27:
        raise ValueError("a stretch's windows must fit 28 bits")
    spark = ship(docs.sparkSession)
    rows = _rows(docs, doc, text)
    every = written(spark, seeds(rows, window, seed), "seeds")
    again = every.groupBy("g").agg(F.count("*").alias("c"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi"))
    again = written(spark, again.filter("c > 1").select("g", (F.col("lo") == F.col("hi")).alias("pure")), "seeds-repeated")
    left = written(spark, every.join(again, "g"), "stretches")
    discard(every, again)
    whole = F.lit(1).cast("long")
    whole = (F.call_function("shiftleft", whole, F.col("n").cast("int")) - 1).alias("mask")
    sure = left.filter("pure").select("_rid", "a", whole)
    mixed = left.filter("not pure")
    kinds = mixed.groupBy("g", "stretch").agg(F.count("*").alias("k"), F.min(F.struct("_rid", "a", "n", "at")).alias("rep"))
    kinds = written(spark, kinds, "stretch-kinds")
    sure = sure.unionByName(mixed.join(kinds.filter("k > 1").select("g", "stretch"), ["g", "stretch"]).select("_rid", "a", whole))
    own = kinds.select("rep.*", "g", "k").groupBy("_rid").agg(F.collect_list(F.struct("g", "a", "n", "at", "k")).alias("own"))
    ctx = rows.join(own.hint("shuffle_hash"), "_rid").select("_rid", "_text", "own").mapInArrow(lambda it: _contexts(it, window), "_rid long, g long, a int, n byte, at byte, k long, ctx binary")
    ctx = written(spark, ctx, "contexts")
    alive = None
    for length in _lengths(window, seed):
        before = alive
        state = ctx.withColumn("alive", whole) if alive is None else ctx.join(alive, ["_rid", "a", "g"])
        state = state.select("_rid", "a", "g", "at", "n", "alive", "ctx")
        found = state.mapInArrow(lambda it, m=length: _expand(it, m, window, seed), "_rid long, a int, g long, key long, mask long")
        twice = found.groupBy("g", "key").count().filter("count > 1").select("g", "key")
        alive = written(spark, found.join(twice, ["g", "key"]).groupBy("_rid", "a", "g").agg(F.bit_or("mask").alias("alive")), f"windows-{length}")
        if before is not None:
            discard(before)
    single = ctx.filter("k = 1").join(alive, ["_rid", "a", "g"]).select("_rid", "a", F.col("alive").alias("mask"))
    marks = written(spark, sure.unionByName(single), "repeated-windows")
    discard(left, kinds, ctx, alive)
    return marks


def _remove(batches: Iterator[pa.RecordBatch], window: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for part, raw, off in W.chunks(batches, "_text"):
        starts, ends, first = W.spans(raw, off, W.NON_SPACE)
        lists = part.column(part.schema.get_field_index("own"))
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        edge = np.zeros(len(starts) + 1, np.int64)
        if len(doc):
            a, mask = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "mask"))
            lo = first[doc] + a
            for i in range(28):
                on = lo[(mask >> i & 1).astype(bool)] + i
                np.add.at(edge, on, 1)
                np.add.at(edge, on + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[first])
        cols = [part.column(part.schema.get_field_index(k)) for k in keep]
        cols += [pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), W.join_words(raw, starts, ends, first, ~gone)]
        yield pa.RecordBatch.from_arrays(cols, names=[*keep, "_n_words", "_n_removed", "_kept"])


def mark_lists(marks: DataFrame) -> DataFrame:
    """(_rid, own): the marks of each text, one for each start word.

    Equal rows share their ``_rid`` and give equal marks; merged before they are listed, a list is
    no longer than its text, however many rows are equal.
    """
    once = marks.groupBy("_rid", "a").agg(F.bit_or("mask").alias("mask"))
    return once.groupBy("_rid").agg(F.collect_list(F.struct("a", "mask")).alias("own"))


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: words in no repeated window, joined by one space.

    Columns of these names that ``docs`` already has are replaced.
    """
    marks = mark_lists(repeated_windows(docs, doc, text, window, seed))
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    named = {c: f"_c{i}" for i, c in enumerate(keep)}
    rows = docs.select(F.xxhash64(F.col(doc), F.col(text)).alias("_rid"), *[F.col(c).alias(n) for c, n in named.items()], F.col(text).alias("_text"))
    both = rows.join(marks.hint("shuffle_hash"), "_rid", "left").select(*named.values(), "_text", "own")
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in named.items())
    out = both.mapInArrow(lambda it: _remove(it, window, list(named.values())), f"{kinds}, _n_words long, _n_removed long, _kept string")
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of its repeated 35-word windows."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def oracle() -> str:
    """DuckDB SQL for the same rows, by counting every window's text."""
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list_distinct(list(p)) AS ps
  FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN rep USING (g)) GROUP BY 1),
kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, k.s
  FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN (
    SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS s
    FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x
    ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) USING (doc_id, p) GROUP BY 1) k ON k.doc_id = w.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM kept
"""
