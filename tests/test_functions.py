"""Known values of the column functions."""

import pytest
from pyspark.sql import functions as F

from talentgrid.functions import scoring as S
from talentgrid.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "key"),
    [("C++ / C#", "c++ c#"), ("  Straße X ", "strasse x"), (None, ""), ("", ""), ("UI/UX Design", "ui ux design")],
)
def test_skill_key(spark, value, key):
    assert one(spark, T.skill_key(F.lit(value).cast("string"))) == key


def test_certification_key(spark):
    assert one(spark, T.certification_key(F.lit("AWS Certified Developer - Associate"))) == "aws certified developer associate"


def test_split_list_keeps_slashes_and_first_spelling(spark):
    assert one(spark, T.split_list(F.lit("Java, PostgreSQL, RESTful APIs, java"))) == ["Java", "PostgreSQL", "RESTful APIs"]
    assert one(spark, T.split_list(F.lit("CI/CD, TCP/IP, I/O"))) == ["CI/CD", "TCP/IP", "I/O"]


def test_variant_and_token(spark):
    assert one(spark, T.variant_match(F.lit("python"), F.lit("python3")))
    assert not one(spark, T.variant_match(F.lit("java"), F.lit("javascript")))
    assert one(spark, T.token_match(F.lit("rest api design"), F.lit("apis rest")))
    assert not one(spark, T.token_match(F.lit("a b c"), F.lit("c d")))


@pytest.mark.parametrize(("title", "level"), [("Senior Engineer", "senior"), ("Head of Data", "director"), ("Jr. Developer", "junior"), ("Engineer", None), (None, None)])
def test_seniority(spark, title, level):
    assert one(spark, T.seniority_level(F.lit(title).cast("string"))) == level


@pytest.mark.parametrize(("bucket", "shown"), [("ready_now", 90), ("next_step", 76), ("aspirational", 58)])
def test_shown_score_of_a_single_candidate(spark, bucket, shown):
    assert one(spark, S.shown_score(F.lit(0.42), F.lit(bucket), F.lit(0.42), F.lit(0.42))) == shown


@pytest.mark.parametrize(("x", "time"), [(0.80, "1-3 months"), (0.60, "3-5 months"), (0.45, "3-5 months"), (0.26, "5-8 months")])
def test_readiness_timeline(spark, x, time):
    assert one(spark, S.readiness_tier(F.lit(x))[1]) == time


@pytest.mark.parametrize(("hop", "credit"), [(1, 0.65), (2, 0.52), (3, 0.416), (9, 0.35)])
def test_hop_confidence(spark, hop, credit):
    assert one(spark, S.hop_confidence(F.lit(hop))) == credit


def test_truncate(spark):
    assert one(spark, T.truncate_words(F.lit("alpha beta gamma"), 12)) == "alpha beta ..."
    assert one(spark, T.truncate_words(F.lit("  a\n b "), 12)) == "a b"
    assert one(spark, T.duration_weeks(F.lit("2 months"))) == 8


def test_rounded_takes_the_double_not_its_text(spark):
    value = 0.85 * (23 / 48 * 1.2)  # 0.48874999999999996, which scales to a tie
    assert one(spark, S.rounded(F.lit(value), 4)) == 0.4888
    assert [one(spark, S.rounded(F.lit(v), 4)) for v in (value, -value, 0.00125, 0.5)] == [round_half_up(v) for v in (value, -value, 0.00125, 0.5)]
    assert one(spark, S.rounded(F.lit(None).cast("double"), 4)) is None
    assert one(spark, F.isnan(S.rounded(F.lit(float("nan")), 4)))


def round_half_up(v: float) -> float:
    return (1 if v > 0 else -1) * int(abs(v) * 10000 + 0.5) / 10000
