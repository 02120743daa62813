"""Catalogue builds: stopped and started again, copied rows, dry runs, retries, constraints."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import builds as B
from talentgrid.sources import store

REPLY = '{"processed_job_title": "T", "skill_domains": [{"domain": "D", "skills": [{"skill": "sql", "tier": "x", "score": 0.5}]}]}'


def inputs(spark, n=40, late="", bad=()):
    k = F.col("role_id")
    return spark.range(n).select(
        F.col("id").alias("role_id"),
        F.concat(F.lit("Role "), "id").alias("title"),
    ).select(
        "role_id",
        "title",
        F.when(k % 5 == 0, F.concat(F.lit("text"), F.lit(late))).otherwise("text").alias("description"),
        F.lit("a").alias("domain_tags"),
        F.lit("sql").alias("skills"),
        F.lit(None).cast("string").alias("certifications"),
        F.lit(None).cast("string").alias("raw_certifications"),
        F.lit("sql, go").alias("raw_skills"),
        F.when(k.isin(list(bad)), "no json").otherwise(REPLY).alias("reply"),
        F.lit(None).cast("array<float>").alias("vector"),
        F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("capability_vector"),
        F.when(k != 3, F.array(F.lit(3.0), F.lit(0.0)).cast("array<float>")).alias("intent_vector"),
    )


def files(root, manifest):
    return {r["bucket"]: [p.read_bytes() for p in Path(f"{root}/{r['folder']}").glob("*.parquet")] for r in manifest}


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "skill string, vector array<float>")


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(B, "BUCKET_ROWS", 5)


def test_stopped_build_ends_like_one_run(spark, none, tmp_path):
    whole = B.Catalogue(spark, f"file://{tmp_path}/whole", 2)
    assert whole.build(inputs(spark), none)["new"] == 40

    class Stop(Exception):
        pass

    def stop(wave):
        if wave == 1:
            raise Stop

    part = B.Catalogue(spark, f"file://{tmp_path}/part", 2)
    with pytest.raises(Stop):
        part.build(inputs(spark), none, after_wave=stop)
    assert part.manifest() == [] and part.state().isEmpty()  # readers see nothing of it
    data = next(Path(f"{tmp_path}/part/data").iterdir())
    half = data / "wave=2" / "bucket=99"
    half.mkdir(parents=True)
    (half / "left.parquet").write_text("half a wave")
    assert part.build(inputs(spark), none)["waves"] == 2  # the other two were there
    a, b = files(f"{tmp_path}/whole", whole.manifest()), files(f"{tmp_path}/part", part.manifest())
    assert a == b and sum(map(len, a.values())) == len(a) == 8


def test_only_changed_buckets_are_written(spark, none, tmp_path):
    c = B.Catalogue(spark, f"file://{tmp_path}/c", 2)
    c.build(inputs(spark), none)
    before = {r["bucket"]: r["folder"] for r in c.manifest()}
    assert c.build(inputs(spark), none)["buckets"] == 0  # nothing to do, no new manifest
    assert c.manifest()[0]["number"] == 1
    dry = c.build(inputs(spark, 41), none, dry_run=True)
    assert (dry["new"], dry["same"]) == (1, 40) and c.manifest()[0]["number"] == 1 and len(os.listdir(tmp_path / "c" / "data")) == 1
    report = c.build(inputs(spark, 41), none)
    after = {r["bucket"]: r["folder"] for r in c.manifest()}
    assert report["buckets"] == 1 and sum(before[b] != f for b, f in after.items()) == 1
    assert {r["role_id"]: r["build"] for r in c.state().collect()} == {i: 1 if i < 40 else 2 for i in range(41)}
    assert c.build(inputs(spark, 39), none)["gone"] == 2 and c.state().count() == 39
    old = c.state().collect()
    c.vacuum()
    assert sorted(c.state().collect()) == sorted(old) and c.vacuum() == []


def test_changed_texts_limit_ids_and_nothing(spark, none, tmp_path):
    c = B.Catalogue(spark, f"file://{tmp_path}/c", 2)
    assert c.build(inputs(spark, 0), none)["buckets"] == 0 and c.state().isEmpty()
    assert c.build(inputs(spark), none, limit=7)["new"] == 7
    assert sorted(r[0] for r in c.state().select("role_id").collect()) == list(range(7))
    c.build(inputs(spark), none)
    ids = spark.createDataFrame([(5,), (10,), (11,)], "role_id long")
    assert {k: v for k, v in c.build(inputs(spark, late="!"), none, ids=ids).items() if k in ("changed", "same", "skipped", "gone")} == {"changed": 2, "same": 1, "skipped": 37, "gone": 0}
    assert c.build(inputs(spark, late="!"), none, rerank=True)["changed"] == 6  # 0, 15, ... 35: the text is an input of the ranking
    texts = {r["role_id"]: r["capability_text"] for r in c.state().collect()}
    assert "text!" in texts[5] and "text!" not in texts[15]  # a rerank leaves texts alone
    assert c.build(inputs(spark), none, version="2", dry_run=True)["changed"] == 40


def test_failures_are_kept_listed_and_retried(spark, none, tmp_path):
    c = B.Catalogue(spark, f"file://{tmp_path}/c", 2)
    assert c.retry(inputs(spark), none) is None
    c.build(inputs(spark, bad=(3, 20)), none)
    assert sorted(r[0] for r in c.failed().collect()) == [3, 20]
    assert {r["role_id"]: r["sort_skills"] for r in c.state().filter("failed").collect()} == {3: "[]", 20: "[]"}
    c.retry(inputs(spark, bad=(20,)), none)
    assert [r[0] for r in c.failed().collect()] == [20]
    c.retry(inputs(spark), none)
    assert not store.exists(spark, f"{c.root}/failures")
    assert B.skill_rows(c.state()).select("skill", "domain", "ord").distinct().collect() == [("sql", "D", 1)]
    c.build(inputs(spark, bad=(4,)), none)  # a ranking that fails later: the old one stays
    row = c.state().filter("role_id = 4").first()
    assert row["failed"] and "sql" in row["sort_skills"]


def test_constraints_are_counted_while_writing(spark, none, tmp_path):
    c = B.Catalogue(spark, f"file://{tmp_path}/c", 2)
    with pytest.raises(ValueError, match="intent_vector_not_unit"):
        c.build(inputs(spark), none, strict=True)
    assert c.manifest() == []
    report = c.build(inputs(spark), none)
    assert (report["intent_vector_missing"], report["intent_vector_not_unit"], report["capability_vector_not_unit"], report["waves"]) == (1, 39, 0, 0)
    wrong = B.Catalogue(spark, f"file://{tmp_path}/w", 3).build(inputs(spark), none)
    assert wrong["capability_vector_wrong_size"] == 40 and wrong["intent_vector_wrong_size"] == 39


def test_listed_skills_of_odd_json(spark):
    rows = [(1, None), (2, "no"), (3, '[null, {"skill": "a", "score": 1}]'), (4, "[]"), (5, '{"skill": "b"}')]
    x = spark.createDataFrame(rows, "role_id long, sort_skills string")
    got = [(r["role_id"], r["skill"], r["score"]) for r in B.skill_rows(x).collect() if r["skill"] is not None]
    assert (3, "a", 1.0) in got and not any(r[0] in (1, 2, 4) for r in got)
