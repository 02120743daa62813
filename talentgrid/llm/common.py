"""Shared plumbing: table reads, the shared scratch folder, written-and-reread cuts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_dir
from ..shipping import ship

__all__ = ["discard", "remove_path", "scratch_dir", "scratch_path", "ship", "table", "with_row_ids", "written"]


#: Spark's setting that removes shuffle files when a SQL execution ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_ids(docs: DataFrame, name: str, first: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` and a struct that tells its rows apart, equal ones too: ``first`` (nulls last), then file and place.

    The rows of a parquet scan are named by file and place in it, which any later scan of the
    same files gives again; another table is written first.
    """
    named = {"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")}
    try:
        place = docs.withColumns(named) if docs.inputFiles() else None
    except AnalysisException:  # made from files, but no scan
        place = None
    place = written(docs.sparkSession, docs, "rows").withColumns(named) if place is None else place
    order = [x for c in first for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    return place.withColumn(name, F.struct(*order, F.col("_file").alias("file"), F.col("_at").alias("at"))).drop("_file", "_at")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_dir(spark)}/talentgrid/{tag}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation.  Shuffle files of the write
    are dropped at its end: nothing reads them again.
    """
    path = scratch_path(spark, tag)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._talentgrid_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        remove_path(df.sparkSession, df._talentgrid_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
