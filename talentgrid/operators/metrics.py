"""Ranking and extraction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_text, texts_match


def judged(ranked: DataFrame, judgements: DataFrame) -> DataFrame:
    """Ranked roles (query, role_id, title, pos, bucket) with relevance and expected bucket; null where unjudged.

    A judgement (query, role_id, title, relevance, expected_bucket, ord) counts by role, the last
    of a role; a role without one by its plain title, the first of a title.
    """
    j = judgements.withColumns({"relevance": F.coalesce("relevance", F.lit(0)), "_t": plain_text(F.col("title"))})
    by_id = j.filter("role_id is not null").groupBy("query", "role_id").agg(F.max_by(F.struct("relevance", "expected_bucket"), "ord").alias("_id"))
    by_title = j.filter("_t <> ''").groupBy("query", "_t").agg(F.min_by(F.struct("relevance", "expected_bucket"), "ord").alias("_by"))
    x = ranked.withColumn("_t", plain_text(F.col("title"))).join(by_id, ["query", "role_id"], "left").join(by_title, ["query", "_t"], "left")
    hit = F.coalesce("_id", "_by")
    return x.withColumns({"relevance": hit["relevance"], "expected_bucket": hit["expected_bucket"]}).drop("_id", "_by", "_t")


def ideal_gains(judgements: DataFrame) -> DataFrame:
    """(query, relevance): the best relevance of each judged title, or role where the title is blank."""
    key = F.coalesce(F.nullif(plain_text(F.col("title")), F.lit("")), F.col("role_id").cast("string"))
    return judgements.filter(key.isNotNull()).groupBy("query", key.alias("_k")).agg(F.max(F.coalesce("relevance", F.lit(0))).alias("relevance")).select("query", "relevance")


def ranking_metrics(ranked: DataFrame, ideal: DataFrame, k: int = 9) -> DataFrame:
    """nDCG@k, precision@3, MRR@k, bucket accuracy, duplicates and unjudged per query.

    ``ranked``: query, title, pos (from 1), relevance (null if unjudged), bucket, expected_bucket;
    a title seen earlier has relevance 0, a blank one is never a repeat.  ``ideal``: query,
    relevance of each judged title.  Bucket accuracy is null where nothing can be compared.
    """
    key = F.nullif(plain_text(F.col("title")), F.lit(""))
    first = F.row_number().over(Window.partitionBy("query", "_t").orderBy("pos"))
    top = ranked.filter(F.col("pos") <= k).withColumn("_t", key).withColumn("_dup", F.col("_t").isNotNull() & (first > 1))
    rel = F.when(F.col("_dup"), 0).otherwise(F.coalesce("relevance", F.lit(0)))
    gain = lambda r, p: (F.pow(F.lit(2.0), r) - 1) / F.log2(p + F.lit(1.0))
    shown = F.coalesce("expected_bucket", F.lit(""))
    total = F.count_if((rel > 0) & (shown != ""))
    got = top.groupBy("query").agg(
        F.sum(gain(rel, F.col("pos"))).alias("dcg"),
        (F.sum(F.when((F.col("pos") <= 3) & (rel > 0), 1).otherwise(0)) / 3).alias("p3"),
        F.coalesce(F.max(F.when(rel > 0, 1 / F.col("pos"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.col("_dup").cast("int")).alias("duplicates"),
        F.sum(F.col("relevance").isNull().cast("int")).alias("unjudged"),
        F.count_if((rel > 0) & (shown != "") & (shown == F.col("bucket"))).alias("bucket_hits"),
        total.alias("bucket_total"),
    )
    w = Window.partitionBy("query").orderBy(F.desc("relevance"))
    best = ideal.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).groupBy("query").agg(F.sum(gain(F.col("relevance"), F.col("pos"))).alias("idcg"))
    ndcg = F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0))
    out = got.join(best, "query", "left").withColumn("ndcg", ndcg).drop("dcg", "idcg")
    return out.withColumn("bucket_accuracy", F.try_divide(F.col("bucket_hits"), F.col("bucket_total")))


def summary(metrics: DataFrame) -> DataFrame:
    """Macro means of the ranking metrics (null counts as 0) and the micro mean of bucket accuracy."""
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0))
    return metrics.agg(*[mean(c).alias(c) for c in ("ndcg", "p3", "mrr")], F.try_divide(F.sum("bucket_hits"), F.sum("bucket_total")).alias("bucket_accuracy"), F.count("*").alias("queries"))


def greedy_matches(expected: Column, actual: Column) -> Column:
    """(e, a) pairs of two sorted arrays of plain texts: each expected text takes the first free actual one that it matches."""
    kind = "array<struct<e:string,a:string>>"

    def take(done: Column, e: Column) -> Column:
        free = F.filter(actual, lambda a: ~F.exists(done, lambda d: d["a"] == a) & texts_match(e, a))
        return F.when(F.size(free) > 0, F.concat(done, F.array(F.struct(e.alias("e"), F.get(free, F.lit(0)).alias("a"))))).otherwise(done)

    return F.aggregate(expected, F.array().cast(kind), take)


def list_scores(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Adds matched, precision, recall, f1, missing and extra of two arrays of texts; both empty is 1, one empty 0."""
    plain = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), plain_text), lambda v: v != "")))
    x = df.withColumns({"_e": plain(expected), "_a": plain(actual)})
    x = x.withColumn("_m", greedy_matches(F.col("_e"), F.col("_a")))
    both = (F.size("_e") == 0) & (F.size("_a") == 0)
    part = lambda n: F.when(both, 1.0).when(n > 0, F.size("_m") / n).otherwise(0.0)
    x = x.withColumns({"matched": F.size("_m"), "precision": part(F.size("_a")), "recall": part(F.size("_e"))})
    out = lambda c, f: F.array_join(F.array_except(F.col(c), F.transform("_m", lambda m: m[f])), ",")
    x = x.withColumns({"missing": out("_e", "e"), "extra": out("_a", "a")}).drop("_e", "_a", "_m")
    return x.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def scalar_score(expected: Column, actual: Column) -> Column:
    """1 if two texts match, else 0."""
    return F.when(texts_match(plain_text(expected), plain_text(actual)), 1.0).otherwise(0.0)


def set_scores(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``list_scores`` of two tables of keys and ``values`` (arrays of texts); a key in one table only has an empty array in the other."""
    x = expected.withColumnRenamed("values", "_x").join(actual.withColumnRenamed("values", "_y"), keys, "full_outer")
    return list_scores(x, "_x", "_y").drop("_x", "_y", "matched")


#: Fields of a CV by group.
FIELD_GROUPS = {
    "Contact and identity": ("full_name", "email", "phone", "location", "current_role", "links", "years_of_experience"),
    "Experience": ("experience_roles", "experience_organizations", "experience_industries", "experience_locations", "experience_date_ranges", "experience_responsibilities", "experience_contextual_skills"),
    "Education": ("education_entry_types", "education", "education_institutions", "education_date_ranges", "education_grades", "education_theses", "education_courses"),
    "Skills and interests": ("skills", "languages", "interests"),
    "Projects and certifications": (
        "projects", "project_organizations", "project_roles", "project_descriptions", "project_technologies", "project_outcomes", "project_links", "project_date_ranges",
        "certifications", "certification_issuers", "certification_issue_dates", "certification_expiration_dates", "thesis_titles", "thesis_technologies",
    ),
}


def model_summary(scores: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(model, overall, total, success) of per-field scores (model, cv, field, score) over all ``fixtures`` (model, cv, ok).

    A CV scores the mean of its fields; one that failed scores 0.
    """
    per = scores.groupBy("model", "cv").agg(F.avg("score").alias("score"))
    x = fixtures.join(per, ["model", "cv"], "left")
    return x.groupBy("model").agg(F.avg(F.when(F.col("ok"), F.coalesce("score", F.lit(0.0))).otherwise(0.0)).alias("overall"), F.count("*").alias("total"), F.count_if("ok").alias("success"))


def group_scores(scores: DataFrame) -> DataFrame:
    """(model, group, score): mean of the fields' means over the CVs that have the field."""
    rows = [(f, g) for g, fields in FIELD_GROUPS.items() for f in fields]
    groups = F.broadcast(scores.sparkSession.createDataFrame(rows, "field string, group string"))  # a fixed table
    per = scores.groupBy("model", "field").agg(F.avg("score").alias("score"))
    return per.join(groups, "field").groupBy("model", "group").agg(F.avg("score").alias("score"))


def lag_delta(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Difference to the value before, per key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))
