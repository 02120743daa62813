"""Hard-negative mining by segment summary filtering.

A row's vector becomes whole numbers, ``floor(SCALE * x)``; a score is the inner product of two
such vectors.  For every vector the mean and the deviation of each of its segments are stored, at
three levels: the whole vector, four segments, sixteen.  Over a segment of s components

    s * (mean * mean' - dev * dev')  <=  inner product  <=  s * (mean * mean' + dev * dev'),

so the sums over a level's segments bound a score.  A pair is looked at one level further only if
its bounds leave it open, and scored in full only if the finest level does; nothing is lost.

Two passes over blocks of rows and blocks of anchors (``ANCHOR_ROWS`` anchors at most), as Spark
cogroups: first the best positives of every anchor, in blocks of its label; then, for each
anchor and positive, the best rows of other labels inside the band of scores that the positive
sets, over all rows.  Every block names its own best, which are merged by a window over the
anchor.  A common label is cut into as many blocks as its rows need.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take
no part; rows equal in id, label and vector count once; other rows of the anchor's own id are never
its positives or negatives; vectors of different lengths are compared as if padded with zeros;
ties go to the smaller id; whole numbers and scores beyond 64 bits stay at the end of that range;
a positive score below zero has no negatives; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, ship, table, written

SCALE = 256
#: Segments of a vector at each level of its summary.
LEVELS = (1, 4, 16)
POSITIVES, NEGATIVES = 5, 3
#: Rows of a block, by the tasks at hand between these; anchors of a block; rows taken at once in a task.
LEAST_ROWS, MOST_ROWS, ANCHOR_ROWS, STEP_ROWS = 512, 16384, 2048, 1024
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Rounding of sums of bounds, as a share of their size; scores are whole, so half of one is added.
SLACK = 1e-9
VECTOR = "rid long, id long, label long, q array<long>, mean array<double>, dev array<double>"


def edges(dim: int, parts: int) -> np.ndarray:
    """First components of the segments of a level; a level's segments are unions of the next one's."""
    finest = np.linspace(0, dim, LEVELS[-1] + 1).astype(np.int64)
    return np.unique(finest[:: LEVELS[-1] // parts][:-1])


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment of each row, level by level."""
    means, devs, dim = [], [], x.shape[1]
    for parts in LEVELS if dim else ():
        at = edges(dim, parts)
        size = np.diff(np.append(at, dim))
        mean = np.add.reduceat(x, at, axis=1) / size
        means.append(mean)
        devs.append(np.sqrt(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, at, axis=1) / size))
    return np.concatenate(means, axis=1) if means else x, np.concatenate(devs, axis=1) if devs else x


def _padded(column, dim: int) -> np.ndarray:
    """A list column of whole numbers as a matrix; what a row lacks is zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim) < n[:, None]] = lists.flatten().to_numpy()
    return out


def _flat(column, n: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().reshape(n, -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def prepared(rows: DataFrame, id: str = "vec_id", vec: str = "embedding", label: Column | None = None) -> tuple[DataFrame, int]:
    """The rows that take part, with whole-number vectors and their summaries, written; and the longest vector's length."""
    spark = ship(rows.sparkSession)
    own = rows.select(F.col(id).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vec).alias("v"))
    own = own.filter(own.id.isNotNull() & own.label.isNotNull() & own.v.isNotNull())
    own = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))))
    own = own.select("id", "label", F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("q")).distinct()
    kept = written(spark, own.select(F.monotonically_increasing_id().alias("rid"), "*"), "vectors")
    dim = kept.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]

    def run(batches):
        for b in batches:
            at = 0
            while at < b.num_rows:  # a few rows at a time where vectors are long
                part = b.slice(at, max(1, (1 << 21) // max(dim, 1)))
                at += part.num_rows
                mean, dev = summaries(_padded(part.column(3), dim).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(mean), _lists(dev)], names=[*part.schema.names, "mean", "dev"])

    out = written(spark, kept.mapInArrow(run, VECTOR), "segments")
    discard(kept)
    return out, dim


class Block:
    """Vectors of one block, with summaries scaled so that bounds are plain products."""

    def __init__(self, t: pa.Table, dim: int):
        self.rid, self.id, self.label = (t.column(c).to_numpy() for c in ("rid", "id", "label"))
        self.n, self.dim = len(self.id), dim
        self.q = _padded(t.column("q"), dim)
        mean, dev = _flat(t.column("mean"), self.n), _flat(t.column("dev"), self.n)
        self.levels, at = [], 0
        for parts in LEVELS if dim else ():
            size = np.sqrt(np.diff(np.append(edges(dim, parts), dim)))
            self.levels.append((mean[:, at : at + len(size)] * size, dev[:, at : at + len(size)] * size))
            at += len(size)

    def part(self, a: int, b: int) -> Block:
        out = object.__new__(Block)
        out.rid, out.id, out.label, out.q, out.n, out.dim = self.rid[a:b], self.id[a:b], self.label[a:b], self.q[a:b], min(b, self.n) - a, self.dim
        out.levels = [(m[a:b], d[a:b]) for m, d in self.levels]
        return out


def bounds(a: Block, b: Block, level: int, ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of pairs (ia, ib) at one level, with room for rounding."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    if len(ia) * 8 > a.n * b.n:  # most pairs: as products of matrices
        mid, off = (ma @ mb.T)[ia, ib], (da @ db.T)[ia, ib]
    else:
        mid, off = np.einsum("ij,ij->i", ma[ia], mb[ib]), np.einsum("ij,ij->i", da[ia], db[ib])
    off = off + 0.5 + SLACK * (np.abs(mid) + off)
    return mid - off, mid + off


def scores(a: Block, b: Block, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs."""
    if not len(ia) or not a.dim:
        return np.zeros(len(ia), np.int64)
    most = float(np.abs(a.q.astype(np.float64)).max()) * float(np.abs(b.q.astype(np.float64)).max()) * a.dim
    if most < 2**53:  # sums of doubles are exact
        if len(ia) * 8 > a.n * b.n:
            return (a.q.astype(np.float64) @ b.q.astype(np.float64).T)[ia, ib].astype(np.int64)
        step = max(1, (1 << 22) // a.dim)
        return np.concatenate([np.einsum("ij,ij->i", a.q[ia[i : i + step]], b.q[ib[i : i + step]]) for i in range(0, len(ia), step)])
    whole = [sum(x * y for x, y in zip(a.q[i].tolist(), b.q[j].tolist(), strict=True)) for i, j in zip(ia, ib, strict=True)]
    return np.array([min(max(s, int(LOW)), int(HIGH)) for s in whole], np.int64)


class Best:
    """The ``k`` best (score, id) of each of ``n`` slots: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), LOW), np.full((n, k), HIGH)
        self.full = np.zeros((n, k), bool)

    def floor(self) -> np.ndarray:
        """What a score must reach to matter still."""
        return np.where(self.full[:, -1], self.score[:, -1], LOW)

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        had = np.nonzero(self.full)
        s, v, i = np.concatenate([had[0], slot]), np.concatenate([self.score[had], score]), np.concatenate([self.id[had], id])
        order = np.lexsort((i, ~v, s))  # ~v falls as v rises, at the ends of the range too
        s, v, i = s[order], v[order], i[order]
        first = np.searchsorted(s, np.arange(len(self.full)))
        rank = np.arange(len(s)) - first[s]
        ok = rank < self.k
        self.full[s[ok], rank[ok]], self.score[s[ok], rank[ok]], self.id[s[ok], rank[ok]] = True, v[ok], i[ok]


def _kth_lower(low: np.ndarray, ia: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest lower bound of each anchor: so many pairs are sure to score as much."""
    order = np.lexsort((-low, ia))
    first = np.searchsorted(ia[order], np.arange(n + 1))
    out = np.full(n, -np.inf)
    enough = np.flatnonzero(np.diff(first) >= k)
    out[enough] = low[order][first[enough] + k - 1]
    return out


def positives_in(rows: Block, anchors: Block, k: int) -> Best:
    """The best ``k`` rows of each anchor's label in one block."""
    best = Best(anchors.n, k)
    for at in range(0, rows.n, STEP_ROWS):
        part = rows.part(at, at + STEP_ROWS)
        ia, ib = np.nonzero((anchors.label[:, None] == part.label[None, :]) & (anchors.id[:, None] != part.id[None, :]))
        bar = best.floor().astype(np.float64)
        for level in range(len(rows.levels)):
            low, up = bounds(anchors, part, level, ia, ib)
            bar = np.maximum(bar, _kth_lower(low, ia, anchors.n, k))
            open_ = up >= bar[ia]
            ia, ib = ia[open_], ib[open_]
        best.add(ia, scores(anchors, part, ia, ib), part.id[ib])
    return best


def band(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest n with 50 p <= 100 n <= 95 p."""
    return -(-p // 2), p // 20 * 19 + p % 20 * 19 // 20


def negatives_in(rows: Block, anchors: Block, positive: np.ndarray, has: np.ndarray, k: int) -> list[Best]:
    """For each positive of each anchor, the best ``k`` rows of other labels inside its band, in one block.

    ``positive``: scores, a row for each anchor; ``has``: which of them are there.
    """
    low, high = band(positive)
    low, high = np.where(has, low, 1), np.where(has, high, 0)
    best = [Best(anchors.n, k) for _ in range(positive.shape[1])]
    for at in range(0, rows.n, STEP_ROWS):
        part = rows.part(at, at + STEP_ROWS)
        ia, ib = np.nonzero((anchors.label[:, None] != part.label[None, :]) & (anchors.id[:, None] != part.id[None, :]))
        for level in range(len(rows.levels)):
            least, most = bounds(anchors, part, level, ia, ib)
            open_ = np.zeros(len(ia), bool)
            for p, b in enumerate(best):
                bar = np.maximum(low[:, p], b.floor()).astype(np.float64)
                open_ |= (most >= bar[ia]) & (least <= high[ia, p]) & has[ia, p]
            ia, ib = ia[open_], ib[open_]
        s = scores(anchors, part, ia, ib)
        for p, b in enumerate(best):
            ok = (s >= low[ia, p]) & (s <= high[ia, p])
            b.add(ia[ok], s[ok], part.id[ib[ok]])
    return best


def _blocks(count: Column, most: int | Column) -> Column:
    return F.greatest(F.ceil(count / most), F.lit(1)).cast("long")


def _each(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, id: str = "vec_id", vec: str = "embedding", label: Column | None = None, is_anchor: str = "id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``label``: the column of labels (default: ``label``); ``is_anchor``: a condition on ``id``.
    """
    spark = rows.sparkSession
    vectors, dim = prepared(rows, id, vec, label)
    vectors = vectors.withColumn("anchor", F.expr(f"coalesce({is_anchor}, false)"))
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("n_anchors"))
    total, total_anchors = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_anchors"), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = min(max(-(-total // tasks), LEAST_ROWS), MOST_ROWS)

    # positives: blocks of rows and of anchors of one label
    sizes = sizes.filter("n_anchors > 0").select("label", _blocks(F.col("n"), block).alias("blocks"), _blocks(F.col("n_anchors"), ANCHOR_ROWS).alias("anchor_blocks"))
    own = vectors.join(sizes, "label")
    deal = lambda what, n: F.pmod(F.xxhash64("rid", F.lit(what)), n)
    rest = [F.col(c).alias(c) for c in vectors.columns if c not in ("label", "anchor")]  # new columns: both sides of a cogroup come from one table
    label_of = F.col("label").alias("label")
    left = own.select(label_of, deal("row", "blocks").alias("block"), _each("anchor_blocks").alias("anchor_block"), *rest)
    right = own.filter("anchor").select(label_of, _each("blocks").alias("block"), deal("anchor", "anchor_blocks").alias("anchor_block"), *rest)

    def find_positives(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"rid": [], "score": [], "id": []}
        if a.num_rows and b.num_rows:
            anchors = Block(b, dim)
            best = positives_in(Block(a, dim), anchors, positives)
            at = np.nonzero(best.full)
            out = {"rid": anchors.rid[at[0]], "score": best.score[at], "id": best.id[at]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    keys = ("label", "block", "anchor_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find_positives, "rid long, score long, id long")
    best = _merged(found, ["rid"], positives).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    best = written(spark, best.select("rid", F.col("p.id").alias("p_id"), F.col("p.score").alias("p_score")), "positives")

    # negatives: blocks of all rows and of all anchors that have a positive
    blocks, anchor_blocks = (F.lit(max(1, -(-n // m))).cast("long") for n, m in ((total, block), (total_anchors, ANCHOR_ROWS)))
    left = vectors.withColumns({"blocks": blocks, "anchor_blocks": anchor_blocks})
    left = left.select(deal("row", "blocks").alias("block"), _each("anchor_blocks").alias("anchor_block"), label_of, *rest)
    right = vectors.filter("anchor").join(best, "rid").withColumns({"blocks": blocks, "anchor_blocks": anchor_blocks})
    right = right.select(_each("blocks").alias("block"), deal("anchor", "anchor_blocks").alias("anchor_block"), label_of, *rest, "p_score")

    def find_negatives(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, np.int64)] for c in ("rid", "place", "score", "id")}
        if a.num_rows and b.num_rows:
            anchors = Block(b, dim)
            lists = b.column("p_score").combine_chunks()
            n = np.diff(lists.offsets.to_numpy())
            for p, best in enumerate(negatives_in(Block(a, dim), anchors, _padded(lists, positives), np.arange(positives) < n[:, None], negatives)):
                at = np.nonzero(best.full)
                for c, v in (("rid", anchors.rid[at[0]]), ("place", np.full(len(at[0]), p)), ("score", best.score[at]), ("id", best.id[at])):
                    out[c].append(v)
        return pa.table({k: pa.array(np.concatenate(v), pa.int64()) for k, v in out.items()})

    keys = ("block", "anchor_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find_negatives, "rid long, place long, score long, id long")
    top = _merged(found, ["rid", "place"], negatives)
    known = vectors.filter("anchor").select("rid", F.col("id").alias("anchor_id")).join(best, "rid")
    at = (F.col("place") + 1).cast("int")
    return top.join(known, "rid").select(
        "anchor_id",
        F.element_at("p_id", at).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.element_at("p_score", at).alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by 50) over all of ``embeddings``, with mended labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label=label)


def oracle() -> str:
    """DuckDB SQL for the same rows: every anchor against every row."""
    return f"""
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT a, b AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES})
SELECT p.a AS anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, b AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.a, positive_id ORDER BY score DESC, b)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
