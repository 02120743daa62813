"""Gapless numbers in a stated order, without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 1, tasks: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the given order (ties: by all columns, nulls first).

    The rows are sorted by ranges, each range in its own task, and written with their places in
    the range; the ranges' counts, one row for each task, give the offsets.  The columns behind
    ``order`` are part of the ranges, so a value that many rows share is spread over tasks too.
    Equal rows get different numbers; an empty table stays empty.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ties = [F.xxhash64(*df.columns), *[F.col(c) for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]]
    ranged = df.repartitionByRange(tasks, *keys, *ties).sortWithinPartitions(*keys, *ties)
    # the high bits of an id are the task's number, the low 33 the place in it
    placed = cut(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged")
    task = F.shiftright("_id", 33)
    counts = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # of as many rows as there are tasks
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_task", task).join(F.broadcast(offsets), "_task")  # a row for each task
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, F.col("_before") + place + F.lit(start)).drop("_id", "_task", "_before")


def pages(df: DataFrame, order: list[str | Column], size: int, tasks: int | None = None) -> DataFrame:
    """``df`` with ``page`` and ``place``, both from 1: consecutive pages of ``size`` rows in the given order."""
    at = numbered(df, order, "_at", 0, tasks)
    return at.withColumns({"page": F.floor(F.col("_at") / size) + 1, "place": (F.col("_at") % size + 1).cast("int")}).drop("_at")


def page(df: DataFrame, order: list[str | Column], size: int, after: dict | None = None) -> DataFrame:
    """The ``size`` rows that follow the row ``after`` (values of the order's columns; none: the first page).

    A page is found by its key, so the rows before it are never numbered.
    """
    if after:
        names = [c for c in order if isinstance(c, str)]
        behind = F.lit(False)
        for i, c in enumerate(names):
            same = F.lit(True)
            for earlier in names[:i]:
                same = same & F.col(earlier).eqNullSafe(F.lit(after[earlier]))
            behind = behind | (same & (F.col(c) > F.lit(after[c])))
        df = df.filter(behind)
    return df.orderBy(*order).limit(size)
