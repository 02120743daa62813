"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a local folder is made, once per
    application.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not hasattr(sc, "_talentgrid_scratch"):
            sc._talentgrid_scratch = "file://" + tempfile.mkdtemp(prefix="talentgrid-")
        found = sc._talentgrid_scratch
    return found.rstrip("/")


#: Rows that one task sorts or counts, about: they fit in its memory.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df`` by a hash of ``columns`` to so many tasks that each has about ``TASK_ROWS`` of ``rows`` or fewer.

    A stated number is not lowered at run time, where a task takes what is small before it grows.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-rows // TASK_ROWS)), *columns)


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """The same rows, written and read back: what uses them does not plan or compute them again."""
    path = f"{scratch_dir(df.sparkSession)}/talentgrid/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
