"""Table sources: parquet folders, JSON and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_table(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = True) -> DataFrame:
    """JSON documents of a fixed schema; a document that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multiline).json(path)


def id_list(spark: SparkSession, path: str, name: str = "role_id") -> DataFrame:
    """Distinct ids of comma-separated text files."""
    from pyspark.sql import functions as F

    ids = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("v"))
    return ids.select(F.trim("v").cast("long").alias(name)).dropna().distinct()
