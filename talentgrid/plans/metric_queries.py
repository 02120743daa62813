"""Evaluation metrics and aggregates over documents, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import standins as X
from ..sources.tables import table


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The nine longest documents of each source as roles titled by their whole texts' digests, and the labels as judgements.

    Every third document is judged under another id, so that its title has to be found.
    """
    x = table(spark, d, "documents").select("doc_id", F.col("source").alias("query"), F.md5(F.coalesce("text", F.lit(""))).alias("title"), "n_chars", "lang")
    pos = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = x.withColumn("pos", pos).filter("pos <= 9").select("query", F.col("doc_id").alias("role_id"), "title", "pos", F.col("lang").alias("bucket"))
    own = F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    j = x.join(table(spark, d, "labels"), "doc_id").select("query", own.alias("role_id"), "title", (2 * F.col("quality") + 1 - F.col("toxic")).alias("relevance"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("").alias("expected_bucket"), F.col("doc_id").alias("ord"))
    return ranked, j


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each source's ranking."""
    ranked, j = _judged(spark, d)
    out = M.ranking_metrics(M.judged(ranked, j), M.ideal_gains(j))
    return out.select("query", F.round("ndcg", 6).alias("ndcg"), F.round("p3", 6).alias("p3"), F.round("mrr", 6).alias("mrr"), "duplicates", "unjudged", "bucket_hits", "bucket_total")


def ranking_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics over all sources."""
    ranked, j = _judged(spark, d)
    out = M.summary(M.ranking_metrics(M.judged(ranked, j), M.ideal_gains(j)))
    return out.select(*[F.round(c, 5).alias(c) for c in ("ndcg", "p3", "mrr", "bucket_accuracy")], "queries")


RANKED = """WITH x AS (SELECT doc_id, source AS query, md5(coalesce(text, '')) AS title, n_chars, lang FROM documents),
j AS (SELECT query, title, doc_id, CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS role_id, 2 * quality + 1 - toxic AS relevance, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE '' END AS eb FROM x JOIN labels USING (doc_id)),
jt AS (SELECT query, title, min_by(relevance, doc_id) AS relevance, min_by(eb, doc_id) AS eb FROM j GROUP BY 1, 2),
r AS (SELECT x.query, x.title, x.lang, row_number() OVER (PARTITION BY x.query ORDER BY n_chars DESC, x.doc_id) AS pos, coalesce(a.relevance, b.relevance) AS relevance, CASE WHEN a.role_id IS NOT NULL THEN a.eb ELSE b.eb END AS eb
  FROM x LEFT JOIN j a ON a.query = x.query AND a.role_id = x.doc_id LEFT JOIN jt b ON b.query = x.query AND b.title = x.title),
t AS (SELECT *, row_number() OVER (PARTITION BY query, title ORDER BY pos) > 1 AS dup FROM r WHERE pos <= 9),
u AS (SELECT *, CASE WHEN dup THEN 0 ELSE coalesce(relevance, 0) END AS g FROM t),
a AS (SELECT query, sum((pow(2, g) - 1) / log2(pos + 1)) AS dcg, count(*) FILTER (pos <= 3 AND g > 0) / 3 AS p3, coalesce(max(CASE WHEN g > 0 THEN 1 / pos END), 0) AS mrr,
  count(*) FILTER (dup) AS duplicates, count(*) FILTER (relevance IS NULL) AS unjudged, count(*) FILTER (g > 0 AND eb <> '' AND eb = lang) AS bucket_hits, count(*) FILTER (g > 0 AND eb <> '') AS bucket_total FROM u GROUP BY 1),
i AS (SELECT query, sum((pow(2, m) - 1) / log2(p + 1)) AS idcg FROM (
  SELECT query, m, row_number() OVER (PARTITION BY query ORDER BY m DESC) AS p FROM (SELECT query, title, max(relevance) AS m FROM j GROUP BY 1, 2)) WHERE p <= 9 GROUP BY 1),
o AS (SELECT *, CASE WHEN coalesce(idcg, 0) > 0 THEN dcg / idcg ELSE 0 END AS ndcg FROM a LEFT JOIN i USING (query))"""

RANKING_METRICS = f"{RANKED} SELECT query, round(ndcg, 6)::DOUBLE AS ndcg, round(p3, 6)::DOUBLE AS p3, round(mrr, 6)::DOUBLE AS mrr, duplicates, unjudged, bucket_hits, bucket_total FROM o"
RANKING_SUMMARY = f"{RANKED} SELECT round(avg(ndcg), 5)::DOUBLE AS ndcg, round(avg(p3), 5)::DOUBLE AS p3, round(avg(mrr), 5)::DOUBLE AS mrr, round(sum(bucket_hits) / nullif(sum(bucket_total), 0), 5)::DOUBLE AS bucket_accuracy, count(*) AS queries FROM o"


def set_f1(spark: SparkSession, d: str) -> DataFrame:
    """Skills of each role against the skills of one profile, matched as texts one to one."""
    e = X.role_skills(spark, d).groupBy("role_id").agg(F.collect_list(F.concat(F.lit("The x"), "skill")).alias("values"))
    n = X.profiles(spark, d).count()
    a = X.profile_skills(spark, d).groupBy("profile_id").agg(F.collect_list(F.concat(F.lit("X"), F.upper("skill"))).alias("values"))
    a = X.roles(spark, d).select("role_id", (F.col("role_id") % n * X.EVERY).alias("profile_id")).join(a, "profile_id").select("role_id", "values")
    out = M.set_scores(e, a, ["role_id"])
    return out.select("role_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "missing", "extra")


SET_F1 = f"""WITH {X.SQL['role_skills']}, {X.SQL['profiles']}, {X.SQL['profile_skills']},
e AS (SELECT role_id, list(skill) AS e FROM role_skills GROUP BY 1), p AS (SELECT profile_id, list(skill) AS a FROM profile_skills GROUP BY 1), np AS (SELECT count(*) AS n FROM profiles),
a AS (SELECT s_suppkey AS role_id, a FROM supplier, np, p WHERE profile_id = s_suppkey % n * {X.EVERY}),
x AS (SELECT role_id, coalesce(e, []) AS e, coalesce(a, []) AS a FROM e FULL JOIN a USING (role_id)),
y AS (SELECT *, CASE WHEN len(a) = 0 AND len(e) = 0 THEN 1 WHEN len(a) > 0 THEN len(list_intersect(e, a)) / len(a) ELSE 0 END::DOUBLE AS p,
  CASE WHEN len(a) = 0 AND len(e) = 0 THEN 1 WHEN len(e) > 0 THEN len(list_intersect(e, a)) / len(e) ELSE 0 END::DOUBLE AS r FROM x)
SELECT role_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1,
  coalesce(array_to_string(list_sort(list_transform(list_filter(e, lambda v: NOT list_contains(a, v)), lambda v: 'the x' || v)), ','), '') AS missing, coalesce(array_to_string(list_sort(list_transform(list_filter(a, lambda v: NOT list_contains(e, v)), lambda v: 'x' || v)), ','), '') AS extra FROM y"""


def lag_delta(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of each event type, with the change from the day before; sums are exact, so no order of rows shows."""
    total = F.sum(F.col("value").cast("decimal(18,6)")).cast("double")
    x = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg((total / F.count("value")).alias("mean"), F.count("*").alias("n"))
    return M.lag_delta(x, "event_type", "day", "mean").select("event_type", F.col("day").cast("string").alias("day"), "mean", "n", "delta")


LAG_DELTA = """
WITH x AS (SELECT event_type, ts::DATE AS day, sum(value::DECIMAL(18,6))::DOUBLE / count(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day::VARCHAR AS day, mean, n, mean - lag(mean) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM x"""


def macro_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality per source, then the mean over sources; unlabelled sources count as zero."""
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    per = x.groupBy("source").agg(F.coalesce(F.avg("quality"), F.lit(0.0)).alias("q"), F.count("quality").alias("n"))
    return per.agg(F.round(F.avg("q"), 6).alias("macro"), F.round(F.sum(F.col("q") * F.col("n")) / F.sum("n"), 6).alias("micro"), F.count("*").alias("sources"))


MACRO_MEANS = """
WITH p AS (SELECT source, coalesce(avg(quality), 0) AS q, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT round(avg(q), 6) AS macro, round(sum(q * n) / sum(n), 6) AS micro, count(*) AS sources FROM p"""


def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents per language and length bucket."""
    b = F.when(F.col("n_chars") >= 3000, "long").when(F.col("n_chars") >= 500, "medium").otherwise("short")
    return table(spark, d, "documents").groupBy("lang", b.alias("bucket")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


BUCKET_COUNTS = "SELECT lang, CASE WHEN n_chars >= 3000 THEN 'long' WHEN n_chars >= 500 THEN 'medium' ELSE 'short' END AS bucket, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2"

QUERIES = {
    "ranking_metrics": (ranking_metrics, RANKING_METRICS),
    "ranking_summary": (ranking_summary, RANKING_SUMMARY),
    "set_f1": (set_f1, SET_F1),
    "lag_delta": (lag_delta, LAG_DELTA),
    "macro_means": (macro_means, MACRO_MEANS),
    "bucket_counts": (bucket_counts, BUCKET_COUNTS),
}
