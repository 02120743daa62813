"""Tables derived from a data folder, written once for each folder and application."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..scratch import cut

Make = Callable[[SparkSession, str], DataFrame]


def derived(make: Make) -> Make:
    """``make`` whose table is written at its first use on a folder and read from then on.

    The tables of a folder must not change while an application runs.  Each call reads anew, so
    that a table can be joined with itself.
    """

    @wraps(make)
    def kept(spark: SparkSession, d: str) -> DataFrame:
        sc = spark.sparkContext
        known = sc.__dict__.setdefault("_talentgrid_derived", {})
        if (d, make.__name__) not in known:
            out = cut(make(spark, d), make.__name__)
            known[d, make.__name__] = (out.inputFiles(), out.schema)
        files, schema = known[d, make.__name__]
        return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

    return kept
