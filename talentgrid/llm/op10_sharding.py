"""Sharding by vector bin packing.

Each group of equal texts has a vector of bytes, tokens (words) and rows.  A group with more
than ``LARGE_SHARE`` of all bytes or rows is placed by itself; the many smaller groups are
folded whole into a fixed number of cells by the hash of their text.  Only a group above an
even share of a shard, which no even split could hold, is dealt in parts.  The summed vectors of
groups and cells, never the documents, come to the driver: ``CELLS`` and ``LANES`` for each
large group at most, whatever the input.  There each, largest first, goes to the shard where the
dot product of its vector with the residual capacity is highest; a last pass moves some between
the heaviest and lightest shards.  Law: ``bytes``.

Slots are gapless by arithmetic: the rows of a shard's lanes before this one, plus the row's
rank in its lane.  A lane is a cell, or one of ``LANES`` parts of a large group, so neither a
shard nor a large group is sorted or counted in one task.

Defined results: a null text has no bytes (size 1, crc 0) and groups with other null and
empty texts; repeated rows get slots of their own, ties in any order; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 8
CELLS = 1 << 14
#: Groups above this share of all bytes or rows are placed by themselves; at most 2 / LARGE_SHARE groups.
LARGE_SHARE = 1 / 1024
LANES = 64


def place(vectors: np.ndarray, shards: int, weight: tuple[float, ...] = (4.0, 1.0, 1.0)) -> np.ndarray:
    """Shard of each vector: largest first, to the highest dot product with what is left.

    Capacities are equal shares of the totals; ``weight`` favours the first dimension, the
    one that the law holds.  Afterwards cells move from the heaviest to the lightest shard as
    long as that lowers the spread of the first dimension.
    """
    total = vectors.sum(axis=0)
    unit = vectors / np.where(total > 0, total, 1)
    w = np.array(weight)
    left = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-(unit * w).sum(axis=1), kind="stable"):
        s = int(np.argmax(left @ (unit[i] * w)))
        out[i] = s
        left[s] -= unit[i]
    first = vectors[:, 0]
    load = np.bincount(out, first, shards)
    for _ in range(16 * shards):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        own = np.flatnonzero(out == hi)
        fit = own[first[own] < gap]
        if not len(fit):
            break
        i = fit[np.argmin(np.abs(first[fit] - gap / 2))]
        if first[i] <= 0:
            break
        out[i] = lo
        load[hi] -= first[i]
        load[lo] += first[i]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, words, the hash of the text and a number of each row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""))
    return docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), words.cast("long").alias("words"), F.xxhash64(t).alias("_h"), F.monotonically_increasing_id().alias("_row"))


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of (doc_id, text) rows."""
    spark = docs.sparkSession
    rows = written(spark, measured(docs), "sizes")
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    n_rows, n_bytes = total["n"], total["b"] or 0
    groups = rows.groupBy("_h").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    # at most 2 / LARGE_SHARE rows
    found = groups.filter((F.col("b") > n_bytes * LARGE_SHARE) | (F.col("n") > n_rows * LARGE_SHARE)).orderBy("_h").collect()
    even = 1 / shards
    large = [(r["_h"], -1 - i, LANES if r["n"] > n_rows * LARGE_SHARE else 1, r["n"] > 1 and (r["b"] > n_bytes * even or r["n"] > n_rows * even)) for i, r in enumerate(found)]
    by_hash = F.broadcast(spark.createDataFrame(large, "_h long, _own long, _lanes int, _split boolean"))  # as many rows as found
    lane = F.when(F.col("_lanes") > 1, F.pmod(F.xxhash64("_row"), F.col("_lanes"))).otherwise(F.lit(0)).cast("long")
    celled = rows.join(by_hash, "_h", "left").select("doc_id", "size", "text_crc32", "words", "_row", F.coalesce("_own", F.pmod(F.xxhash64("_h"), F.lit(cells))).alias("_cell"), lane.alias("_lane"))
    sums = celled.groupBy("_cell", "_lane").agg(F.sum("size"), F.sum("words"), F.count("*")).collect()  # one row per lane: CELLS + 2 * LANES / LARGE_SHARE at most
    sums.sort(key=lambda r: (r[0], r[1]))
    split = {own for _, own, _, s in large if s}
    item = [(r[0], r[1] if r[0] in split else 0) for r in sums]  # what is placed as one: a group, a cell, or a part of a split group
    index = {c: i for i, c in enumerate(dict.fromkeys(item))}
    vectors = np.zeros((len(index), 3))
    for key, r in zip(item, sums, strict=True):
        vectors[index[key]] += [float(x) for x in r[2:]]
    to = place(vectors, shards)
    seen, plan = [0] * shards, []
    for key, r in zip(item, sums, strict=True):
        s = int(to[index[key]])
        plan.append((r[0], r[1], s, seen[s]))
        seen[s] += r[4]
    plan_df = F.broadcast(spark.createDataFrame(plan, "_cell long, _lane long, shard int, base long"))  # one row per lane
    rank = F.row_number().over(Window.partitionBy("_cell", "_lane").orderBy("doc_id", "_row"))
    placed = celled.join(plan_df, ["_cell", "_lane"]).withColumn("slot", (F.col("base") + rank - 1).cast("long"))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
