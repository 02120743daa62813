"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Patterns are the 10-word windows of the benchmark items (a shorter item is one pattern).
Patterns of one length share three tables: a block shift table (how far the scan may jump
from a two-word block), suffix buckets (patterns by their last block) and the test strings
themselves, compared word for word before an occurrence counts.

Documents are scanned in one pass without a shuffle.  The tables are broadcast; one block of
benchmark items holds at most ``BLOCK_BYTES`` of text, and a larger benchmark is handled in
several blocks whose findings are merged per row, under a key written once to the shared folder.

Defined results: a null text or item has no words and no occurrences; repeated item texts
count as separate items; an empty benchmark leaves every document clean; an empty document
table gives an empty result; repeated rows and rows with a repeated or null doc_id each keep
their own findings, whatever the number of blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import words as W
from .common import ship, table, written

WINDOW = 10
#: Most benchmark text in one broadcast block.
BLOCK_BYTES = 32 << 20
TABLE_BITS = 18
MASK = np.uint64((1 << TABLE_BITS) - 1)


def _blocks(h: np.ndarray, width: int) -> np.ndarray:
    """Table slot of the block that ends at each word; the first width-1 words have none."""
    if width == 1:
        return (h & MASK).astype(np.int64)
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = W.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (pair & MASK).astype(np.int64)


def item_words(texts: list[str | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Lower-cased words of each item, and their hashes."""
    raw, off = W.buffer_of(pa.array([t or "" for t in texts], pa.large_string()))
    raw = W.LOWER[raw]
    starts, ends, first = W.spans(raw, off, W.ALNUM)
    h = W.hash_words(raw, starts, ends)
    flat = raw.tobytes()
    found = [flat[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    return [found[a:b] for a, b in cut], [h[a:b] for a, b in cut]


class Patterns:
    """The tables of all patterns of one length in words."""

    def __init__(self, length: int):
        self.length, self.width = length, min(2, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.width + 1, np.uint8)
        self.buckets: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(dict)
        self.whole: np.ndarray | list[int] = []

    def add(self, words: list[bytes], h: np.ndarray, item: str) -> None:
        slots = _blocks(h, self.width)
        for end in range(self.width - 1, self.length):
            slot = slots[end]
            self.shift[slot] = min(self.shift[slot], self.length - 1 - end)
        items = self.buckets[int(slots[-1])].setdefault(tuple(words), [])
        if item not in items:
            items.append(item)
        self.whole.append(int(W.hash_windows(h, self.length)[0]))

    def done(self) -> Patterns:
        self.whole = np.unique(np.array(self.whole, np.uint64))
        self.buckets = dict(self.buckets)
        return self

    def scan(self, h: np.ndarray, first: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Start words of windows worth a comparison, and the table slots of their last blocks."""
        n = len(h)
        if n < self.length:
            return [], np.zeros(0, np.int64)
        slots = _blocks(h, self.width)
        jump = self.shift[slots].tobytes()
        ends, at = [], self.length - 1
        while at < n:
            step = jump[at]
            if step:
                at += step
            else:
                ends.append(at)
                at += 1
        end = np.array(ends, np.int64)
        start = end - (self.length - 1)
        same = W.windows_inside(first, self.length)[start]
        h_all = W.hash_windows(h, self.length)[start]
        near = self.whole[np.minimum(np.searchsorted(self.whole, h_all), len(self.whole) - 1)] == h_all
        keep = same & near
        return start[keep].tolist(), slots[end[keep]]


def compile_patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Tables for the windows of (item_id, text) pairs, one per pattern length."""
    out: dict[int, Patterns] = {}
    words, hashes = item_words([t for _, t in items])
    for (item, _), ws, h in zip(items, words, hashes, strict=True):
        if not ws:
            continue
        n = min(window, len(ws))
        group = out.setdefault(n, Patterns(n))
        for i in range(len(ws) - n + 1):
            group.add(ws[i : i + n], h[i : i + n], str(item))
    return [out[k].done() for k in sorted(out)]


_RANGE = StructType([StructField("first", LongType()), StructField("last", LongType())])
FOUND = [StructField("n_words", LongType()), StructField("ranges", ArrayType(_RANGE)), StructField("items", ArrayType(StringType()))]


def _search(batches: Iterator[pa.RecordBatch], tables, keep: list[str]) -> Iterator[pa.RecordBatch]:
    groups: list[Patterns] = tables.value
    rng = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    for part, raw, off in W.chunks(batches, "_text"):
        low = W.LOWER[raw]
        starts, ends, first = W.spans(low, off, W.ALNUM)
        h = W.hash_words(low, starts, ends)
        edge = np.zeros(len(h) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for g in groups:
            for at, slot in zip(*g.scan(h, first), strict=True):
                ws = tuple(low[starts[k] : ends[k]].tobytes() for k in range(at, at + g.length))
                if found := g.buckets.get(int(slot), {}).get(ws):  # direct comparison
                    edge[at] += 1
                    edge[at + g.length] -= 1
                    items[int(np.searchsorted(first, at, "right")) - 1].update(found)
        hit = np.cumsum(edge[:-1]) > 0
        ranges: list[list] = [[] for _ in range(part.num_rows)]
        for d in items:
            a, b = int(first[d]), int(first[d + 1])
            turn = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0]))))
            ranges[d] = [{"first": int(x), "last": int(y) - 1} for x, y in zip(turn[::2], turn[1::2], strict=True)]
        cols = [part.column(part.schema.get_field_index(c)) for c in keep]
        cols += [pa.array(np.diff(first), pa.int64()), pa.array(ranges, pa.list_(rng)), pa.array([sorted(items.get(d, ())) for d in range(part.num_rows)], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_words", "ranges", "items"])


def _item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of bounded size, streamed through the driver one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(item, text).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "") * 4
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: its words, the word ranges inside occurrences, and the items that occur."""
    spark = ship(docs.sparkSession)
    slim = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    blocks = _item_blocks(benchmark, item, item_text)
    first, second = next(blocks, []), next(blocks, None)

    def search(rows: DataFrame, key: str, tables) -> DataFrame:
        return rows.mapInArrow(lambda it: _search(it, tables, [key]), StructType([rows.schema[key], *FOUND]))

    def shared(block: list[tuple[object, str | None]]):
        return spark.sparkContext.broadcast(compile_patterns(block, window))

    if second is None:
        return search(slim, "_doc", shared(first)).withColumnRenamed("_doc", doc)
    slim = written(spark, slim.withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")
    out = None
    for block in chain([first, second], blocks):  # one block's tables live at a time
        tables = shared(block)
        found = search(slim, "_row", tables)
        # every row once, with its number of words; from later blocks only rows with findings
        found = written(spark, found if out is None else found.filter(F.size("items") > 0), "findings")
        tables.destroy()
        out = found if out is None else out.unionByName(found)
    out = out.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    out = slim.select("_row", "_doc").join(out, "_row").drop("_row")
    return out.withColumnRenamed("_doc", doc)


def covered(ranges: Column) -> Column:
    """Words inside the union of sorted ranges."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("last"))
    return F.aggregate(
        ranges,
        zero,
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(acc["last"], r["first"] - 1))).cast("long").alias("n"),
            F.greatest(acc["last"], r["last"]).alias("last"),
        ),
        lambda acc: acc["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """``find_items`` with the counts and the verdict."""
    found = find_items(docs, benchmark, **names)
    items = F.array_sort("items")
    return found.withColumns(
        {
            "n_hit": covered(F.col("ranges")),
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join(items, ","), 256),
            "contaminated": F.size("ranges") > 0,
        }
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with their own columns."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_body"))
    return find_items(row, benchmark, doc="_row", text="_body").filter(F.size("ranges") == 0).select("_row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` against every item of ``benchmark``."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def oracle() -> str:
    """DuckDB SQL for the same rows, by joining exploded windows."""
    return r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM pat),
win AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens WHERE len(ws) >= n)),
hits AS (SELECT doc_id, item_id, n, i FROM win JOIN pat USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
