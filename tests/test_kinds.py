"""Kinds of profiles and roles: every pair of ids once, each content compared once, no pair shuffled."""

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import coverage as V
from talentgrid.operators.grid import kinds, kinds_grid, members
from talentgrid.plans import catalog


def _sides(spark, people: int, roles: int):
    p = spark.range(people).select(F.col("id").alias("profile_id"), F.array((F.col("id") % 3).cast("string")).alias("mine"))
    return p, spark.range(roles).select(F.col("id").alias("role_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("theirs"))


def test_every_pair_of_ids_has_the_result_of_its_kinds(spark):
    p, r = _sides(spark, 20, 33)
    x = members(kinds_grid(kinds(p, "profile_id"), kinds(r, "role_id")), F.concat_ws("-", "mine", F.col("theirs").cast("string")).alias("both"))
    want = sorted((i, j, f"{i % 3}-{j % 5}" if j % 5 else f"{i % 3}") for i in range(20) for j in range(33))
    assert sorted(tuple(row) for row in x.collect()) == want


def test_equal_rows_are_one_kind_and_a_large_one_is_several(spark):
    p, r = _sides(spark, 600, 40)
    assert kinds_grid(kinds(p, "profile_id"), kinds(r, "role_id")).count() == 3 * 5
    parts = kinds(p, "profile_id", 50).collect()
    assert max(len(k["_profile_id"]) for k in parts) < 100 and sorted(i for k in parts for i in k["_profile_id"]) == list(range(600))


def test_raw_coverage_compares_equal_lists_once(spark):
    required = spark.range(50).select(F.col("id").alias("role_id"), F.lit("Python, SQL").alias("raw_skills"))
    held = spark.range(40).select(F.col("id").alias("profile_id"), F.lit("sql").alias("term"))
    assert V.raw_kinds(required, held, None, None).count() == 1
    assert V.raw_coverage(required, held, None, None).filter("coverage = 0.5").count() == 2000


@pytest.mark.parametrize("name", ["gap_report", "career_path", "raw_coverage", "domain_overlap", "cert_coverage"])
def test_pairs_are_not_shuffled(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]  # what follows the meeting of the two sides
    assert "Generate explode(_role_id" in above and "Aggregate" not in above and "Window" not in above and "Repartition" not in above
