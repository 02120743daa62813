"""Connected components by alternating large-star and small-star steps, all as joins and
aggregations; each round is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_path, scratch_path

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root: the smallest node.

    An empty edge list gives an empty result.  Self loops and repeated edges are allowed.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct()
    path, seen = None, None
    for _ in range(MAX_ROUNDS):
        e = _small_star(_large_star(e)).filter("u <> v").distinct()
        new = scratch_path(spark, "components")
        e.write.parquet(new)
        e = spark.read.schema("u long, v long").parquet(new)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if path is not None:
            remove_path(spark, path)
        path = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
