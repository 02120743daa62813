"""Catalog maintenance as joins: upsert, update from values, cascading delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the new row's values win."""
    values = [c for c in existing.columns if c not in keys]
    marked = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_new"))
    both = existing.join(marked, keys, "full_outer")
    return both.select(*keys, *[F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def update_from(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows with the values of ``new`` where a key matches; nulls in ``new`` keep the old value."""
    values = [c for c in new.columns if c not in keys]
    other = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    both = existing.join(other, keys, "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in existing.columns])


def cascade_delete(parent: DataFrame, children: dict[str, DataFrame], ids: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parent and children without the rows of the given ids."""
    gone = ids.select(key).distinct()
    return parent.join(gone, key, "left_anti"), {n: c.join(gone, key, "left_anti") for n, c in children.items()}
