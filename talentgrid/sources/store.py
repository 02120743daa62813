"""Folders of finished parquet writes, through Hadoop's file system, whatever store they are in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a write into the folder was committed: Spark then leaves ``_SUCCESS``."""
    return exists(spark, f"{folder}/_SUCCESS")


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with what is in it."""
    fs, p = _at(spark, path)
    fs.delete(p, True)
