"""Graph operators over (src, dst) implication edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import hop_confidence
from ..scratch import cut, dealt

MAX_HOPS = 3


def hop_distances(edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(src, dst, hop): the least number of edges from src to dst, up to ``max_hops``; src itself left out."""
    step = edges.select("src", "dst").distinct()
    every = step.withColumn("hop", F.lit(1))
    reach = step
    for hop in range(2, max_hops + 1):
        reach = reach.alias("a").join(step.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").distinct()
        every = every.unionByName(reach.withColumn("hop", F.lit(hop)))
    return every.filter("src <> dst").groupBy("src", "dst").agg(F.min("hop").alias("hop"))


def implied_with_hops(held: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(profile_id, skill, hop, via, confidence) of skills implied within ``max_hops``.

    Held skills are left out; the least hop wins, then the smallest start.  Distances are made
    once over the vocabulary and joined to profiles, so the walk does not grow with profiles.
    """
    far = hop_distances(edges, max_hops)
    held = cut(held.select("profile_id", "skill"), "held")
    # dealt by what comes of them: a skill reaches several
    own = dealt(held, held.count() << max_hops + 1, "profile_id").select("profile_id", F.col("skill").alias("via"))
    # a row for each two near skills of the vocabulary; the other side grows with profiles, and if it were sent round in its place one task would make all rows
    new = own.join(F.broadcast(far), F.col("via") == F.col("src")).groupBy("profile_id", F.col("dst").alias("skill")).agg(F.min(F.struct("hop", "via")).alias("b"))
    best = new.join(held.select("profile_id", "skill"), ["profile_id", "skill"], "left_anti")
    return best.select("profile_id", "skill", "b.hop", "b.via", hop_confidence(F.col("b.hop")).alias("confidence"))


def closure(edges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """(src, dst) for every skill reachable from src, itself included; cycles are fine.

    Paths double in length each round, so a graph of diameter n settles in log n rounds.
    """
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    reach = nodes.select("src", F.col("src").alias("dst")).unionByName(edges.select("src", "dst")).distinct()
    count = -1
    for _ in range(max_rounds):
        reach = cut(reach, "reach")
        now = reach.count()
        if now == count:
            break
        count = now
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        reach = reach.unionByName(longer).distinct()
    return reach


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key group in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
