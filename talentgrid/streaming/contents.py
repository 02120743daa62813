"""Content-keyed preparation of a stream: a document that came before, word for word, is not prepared again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_stream(spark: SparkSession, folder: str, schema: StructType | str, files: int = 1) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``content_key``: a digest of the given columns as JSON, so that nested parts count too."""
    return docs.withColumn("content_key", F.sha2(F.to_json(F.struct(*columns)), 256))


def new_contents(docs: DataFrame, columns: list[str], seen_for: str | None = None, time: str = "ts") -> DataFrame:
    """The first document of each content; with ``seen_for`` a key is forgotten that long after its ``time``."""
    x = keyed(docs, columns)
    return x.dropDuplicates(["content_key"]) if seen_for is None else x.withWatermark(time, seen_for).dropDuplicatesWithinWatermark(["content_key"])


def prepare_stream(docs: DataFrame, columns: list[str], prepare: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Prepare each new content once, batch by batch, into parquet files of ``target``; the running query."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own files
        prepare(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return new_contents(docs, columns).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
