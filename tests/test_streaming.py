"""A stream prepares each content once."""

from pyspark.sql import functions as F

from talentgrid.streaming import contents as C


def test_each_content_is_prepared_once(spark, tmp_path):
    kind = "doc_id long, text string"
    for n, rows in enumerate(([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, None), (6, None), (7, "c")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    docs = C.table_stream(spark, f"{tmp_path}/in/*", kind)
    for _ in range(2):  # the second run finds nothing new
        C.prepare_stream(docs, ["text"], lambda b: b.select("text", F.upper("text").alias("up")), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    got = sorted(((r["text"], r["up"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    assert got == sorted([("a", "A"), ("b", "B"), ("c", "C"), (None, None)], key=repr)
