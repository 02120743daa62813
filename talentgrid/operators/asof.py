"""As-of lookup: each row takes the latest entry of its key at or before its time, and may interpolate to the next.

Rows and entries are merged by a sort on (key, time) and one window carries the last entry
forward; no range join, no pair of a row and an entry that it does not take.  An entry brings its
successor with it, so one look is enough to interpolate.  A key with many rows is dealt into
several sorted runs, each with all entries of that key; a run has as many rows as entries at least
(and ``RUN_ROWS``), so dealing at most doubles the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least number of rows of one key that are worth a run of their own.
RUN_ROWS = 4096


def asof(rows: DataFrame, entries: DataFrame, key: str, time: str, at: str, before_first: bool = False, run_rows: int = RUN_ROWS) -> DataFrame:
    """``rows`` with ``entry`` and ``next_entry``: structs of the columns of ``entries`` (key, ``at`` and others).

    ``entry`` has the greatest ``at`` that is not over ``time``; with ``before_first`` rows earlier
    than all entries take the first.  Where several entries have one ``at`` the last by all columns counts.
    Rows with a null key or time, or without an entry, stay with nulls; entries with a null key or ``at`` are never taken.
    """
    kind = entries.schema
    whole = F.struct(*entries.columns)
    single = entries.dropna(subset=[key, at]).groupBy(key, at).agg(F.max(whole).alias("entry"))
    after = Window.partitionBy(key).orderBy(at)
    placed = single.withColumn("next_entry", F.lead("entry").over(after))
    if before_first:
        first = F.row_number().over(after) == 1
        placed = placed.withColumn(at, F.when(first, F.lit(None)).otherwise(F.col(at)))  # null sorts before all times
    sizes = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    deals = placed.groupBy(key).agg(F.count("*").alias("_entries")).join(sizes, key).select(key, F.ceil(F.col("_rows") / F.greatest("_entries", F.lit(run_rows))).alias("_deals"))
    deal = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_deals", F.lit(1).cast("long")))
    own = rows.join(deals, key, "left").select(F.col(key).alias("_key"), deal.alias("_deal"), F.col(time).alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    copies = placed.join(deals, key).select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1)).alias("_deal"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct("entry", "next_entry").alias("_found"))
    merged = own.unionByName(copies, allowMissingColumns=True)
    # at one time the entry comes first: it is taken by the row that equals it
    run = Window.partitionBy("_key", "_deal").orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("_found", F.last("_found", ignorenulls=True).over(run)).filter("_row is not null")
    usable = F.when(F.col("_at").isNotNull() & F.col("_key").isNotNull(), F.col("_found"))
    out = found.select("_row.*", usable.alias("_found"))
    return out.select(*rows.columns, F.col("_found.entry").cast(kind).alias("entry"), F.col("_found.next_entry").cast(kind).alias("next_entry"))


def interpolated(time: Column, at: str, value: str) -> Column:
    """The value of a row of :func:`asof` on the line from its entry to the next one; the entry's own where there is no next."""
    here, there = F.col("entry"), F.col("next_entry")
    span = there[at] - here[at]
    ratio = F.when(span > 0, (time - here[at]) / span).otherwise(1.0)
    return F.when(there.isNull(), here[value].cast("double")).otherwise(here[value] + (there[value] - here[value]) * ratio)
