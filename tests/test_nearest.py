"""Nearest rows by cosine and by shared features, named by cells."""

from talentgrid.operators import pairs as B
from talentgrid.plans import catalog_queries as K
from talentgrid.plans import match_queries as Q


def test_best_of_rows_takes_the_first_of_equals():
    import numpy as np

    x = np.array([[0.5, 0.9, 0.9, 0.9], [-np.inf, -np.inf, 0.1, -np.inf]])
    row, col = B._best(x, 2)
    assert list(zip(row.tolist(), col.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 2)]
    assert B._best(x[:, :1], 2)[1].tolist() == [0]


def test_zero_and_partly_null_vectors_are_near_none(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [0.0, 1.0]), (50, [0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in K.cosine_topk(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 1.0, 1), (0, 1, 1.0, 2), (0, 5, 0.0, 3)]


def test_equal_roles_are_compared_once_and_near_each_other(spark, monkeypatch):
    sets = [(1, ["a", "b"]), (2, ["b", "a"]), (3, ["a", "b"]), (4, ["a", "b", "c"]), (5, ["x"]), (6, []), (7, [])]
    monkeypatch.setattr(Q, "_features", lambda s, d: s.createDataFrame(sets, "role_id long, feature array<string>"))
    seen = []
    alike = B.alike
    monkeypatch.setattr(B, "alike", lambda x, least: seen.append(x.count()) or alike(x, least))
    got = {r["role_id"]: (r["other"], r["similarity"]) for r in Q.role_similarity(spark, "").collect()}
    assert got == {1: (2, 1.0), 2: (1, 1.0), 3: (1, 1.0), 4: (1, 0.666667)} and seen == [4]


def test_the_join_by_frequent_features_is_gone(spark, sf):
    plan = Q.role_similarity(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(feature" not in plan and "FlatMapCoGroupsInArrow" in plan
