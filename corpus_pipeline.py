"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage takes what the one before it kept, written as Parquet in the shared folder and
read back, so a lost executor costs no more than a stage.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm import near_copies, op01_quality, op02_substring, op04_packing, op06_decontaminate
from talentgrid.llm.common import table, with_row_ids, written

#: Near-duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
SHINGLE, LEAST = 5, 0.8
#: Packing comes last, when an executor's heap has grown with the stages before: it encodes little text at once and keeps fewer units.
CHUNK, UNITS = 1 << 19, 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps.

    A null or empty text has no words and goes; repeated rows are judged each, alike; other
    columns, long texts and null ids pass through; an empty table gives an empty one.
    """
    return op01_quality.keep_passing(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one of the smallest doc_id (a null is largest), of these the first in file order.

    Groups are of rows, not of ids: equal rows are a group, whatever their ids, and rows of one
    id with different texts are not.  Texts without words (null, empty) are a group.  Other
    columns pass through; an empty table gives an empty one.
    """
    rows = with_row_ids(docs, "_row", ("doc_id",))
    groups = near_copies.near_copies(rows, doc="_row", shingle=SHINGLE, least=LEAST)
    gone = groups.filter(F.col("_row") != F.col("component")).select(F.col("_row.file").alias("_file"), F.col("_row.at").alias("_at"))
    left = rows.withColumns({"_file": F.col("_row.file"), "_at": F.col("_row.at")})
    return left.join(gone, ["_file", "_at"], "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that repeat; untouched texts stay as they are.

    A text that loses words is its kept words with single spaces (empty if none is left), and
    n_chars follows; rows that come twice lose their windows in both places; null texts stay
    null; other columns pass through; an empty table gives an empty one.
    """
    out = op02_substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs.

    A text without words (null, empty) holds none and stays, as do all where the benchmark is
    empty; repeated rows are judged each; other columns pass through.
    """
    return op06_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 1024 ids.

    A null or empty text is its end id alone; repeated rows are packed each; an empty table
    gives no pieces.
    """
    return op04_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), chunk=CHUNK, units=UNITS)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the fingerprints and the byte-level ids; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
