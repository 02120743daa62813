"""Decontamination with a benchmark of several blocks gives the rows that one block gives."""

from talentgrid.llm import op06_decontaminate


def test_blocks_keep_rows_with_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None, "one two three"), (None, "clean text"), (1, "two three"), (1, "two three"), (1, "zero one two"), (2, "clean text"), (2, "clean text"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two three"), (2, "one two"), (3, "nothing here")], "item_id long, text string")

    def run():
        found = sorted(map(repr, op06_decontaminate.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
        return found, sorted(map(repr, op06_decontaminate.drop_contaminated(docs, bench).collect()))

    want = run()
    assert (len(want[0]), len(want[1])) == (8, 4)
    monkeypatch.setattr(op06_decontaminate, "BLOCK_BYTES", 8)
    assert run() == want
