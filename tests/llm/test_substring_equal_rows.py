"""Many rows with one id and text: marks do not add up."""

import hashlib

from pyspark.sql import functions as F

from talentgrid.llm import op02_substring as S

ROWS = 20_000


def _text(n: int, salt: str = "") -> str:
    return " ".join(hashlib.md5(f"{salt}{i}".encode()).hexdigest()[:6] for i in range(n))


def test_marks_of_equal_rows_are_listed_once(spark):
    docs = spark.range(ROWS).select(F.lit(7).cast("long").alias("doc_id"), F.lit(_text(100)).alias("text"))
    found = S.repeated_windows(docs)
    lists = S.mark_lists(found).select(F.size("own").alias("n"), F.size(F.array_distinct(F.transform("own", lambda m: m["a"]))).alias("starts")).collect()
    assert len(lists) == 1 and lists[0].n == lists[0].starts <= 100
    out = S.remove_repeats(docs).groupBy("n_words", "n_removed", "kept_text").count().collect()
    assert [(r.n_words, r.n_removed, r.kept_text, r["count"]) for r in out] == [(100, 100, "", ROWS)]


def test_equal_rows_with_null_ids_beside_a_partial_repeat(spark):
    body, tail = _text(60), _text(30, "t")
    rows = [(None, body)] * 3 + [(1, f"{tail} {' '.join(body.split()[:40])}"), (2, _text(80, "u")), (3, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in S.remove_repeats(docs).collect())
    assert got == sorted([(0, 60, 60, "")] * 3 + [(1, 70, 40, tail), (2, 80, 0, _text(80, "u")), (3, 0, 0, ""), (0, 0, 0, "")])
