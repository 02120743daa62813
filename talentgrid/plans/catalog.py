"""Registry of the career-analytics queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import build_queries, catalog_queries, edit_queries, match_queries, metric_queries, profile_queries, progress_queries, text_queries

MODULES = (text_queries, catalog_queries, build_queries, profile_queries, edit_queries, match_queries, metric_queries, progress_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship query."""
    return queries()["recommend_topk"](spark, sf_dir)


def queries() -> dict:
    """Name to callable taking (spark, sf_dir)."""
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {k: s for m in MODULES for k, (_, s) in m.QUERIES.items() if s}
