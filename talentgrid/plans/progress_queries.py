"""Progress of requests at the times of events: an as-of lookup with interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.progress import MILESTONES, MOST
from ..operators.asof import asof, interpolated
from ..sources.tables import table

#: Which kind of request an event stands for; other events have no milestones.
KINDS = {"click": "cv_upload", "view": "manual_profile", "error": "matching", "purchase": "path_prep"}


def progress_asof(spark: SparkSession, d: str) -> DataFrame:
    """Step and progress that every event's request shows after the time that its value gives."""
    rows = [(k, *m) for k, ms in MILESTONES.items() for m in ms]
    milestones = spark.createDataFrame(rows, "request string, at_ms long, step int, progress int")
    request = F.coalesce(*[F.when(F.col("event_type") == e, k) for e, k in KINDS.items()])
    e = table(spark, d, "events").select("event_id", request.alias("request"), F.greatest(F.lit(0).cast("long"), F.floor(F.col("value") * 500) - 400).alias("elapsed_ms"))
    x = asof(e, milestones, "request", "elapsed_ms", "at_ms")
    shown = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), interpolated(F.col("elapsed_ms"), "at_ms", "progress")))
    return x.select("event_id", "request", "elapsed_ms", F.col("entry.step").alias("step"), F.when(F.col("entry").isNotNull(), F.round(shown, 6)).alias("progress"))


PROGRESS_ASOF = f"""
WITH m0(request, at_ms, step, progress) AS (VALUES {", ".join(f"('{k}', {a}, {s}, {p})" for k, ms in MILESTONES.items() for a, s, p in ms)}),
m AS (SELECT *, lead(at_ms) OVER w AS next_ms, lead(progress) OVER w AS next_progress FROM m0 WINDOW w AS (PARTITION BY request ORDER BY at_ms)),
e AS (SELECT event_id, CASE event_type {" ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KINDS.items())} END AS request, greatest(0, floor(value * 500)::BIGINT - 400) AS elapsed_ms FROM events)
SELECT event_id, e.request, elapsed_ms, step, CASE WHEN step IS NOT NULL THEN
  round(greatest(0.0::DOUBLE, least({float(MOST)}::DOUBLE, CASE WHEN next_ms IS NULL THEN progress::DOUBLE ELSE progress + (next_progress - progress) * ((elapsed_ms - at_ms) / (next_ms - at_ms)) END)), 6) END AS progress
FROM e ASOF LEFT JOIN m ON e.request = m.request AND e.elapsed_ms >= m.at_ms"""


def order_prices_asof(spark: SparkSession, d: str) -> DataFrame:
    """For every event the latest earlier order of the customer with the event's user as its number, and the next one."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ordered"), "o_orderkey")
    day = F.col("ts").cast("timestamp_ntz") - F.expr("make_interval(27)")  # events are from 2024, orders from decades before
    e = table(spark, d, "events").select("event_id", "user_id", day.alias("ts"))
    x = asof(e, o, "user_id", "ts", "ordered")
    return x.select("event_id", F.col("entry.o_orderkey").alias("order_key"), F.col("next_entry.o_orderkey").alias("next_key"))


ORDER_PRICES_ASOF = """
WITH o AS (SELECT *, lead(o_orderkey) OVER (PARTITION BY user_id ORDER BY ordered) AS next_key
  FROM (SELECT o_custkey AS user_id, o_orderdate::TIMESTAMP AS ordered, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)),
e AS (SELECT event_id, user_id, ts - INTERVAL 27 YEAR AS ts FROM events)
SELECT event_id, o_orderkey AS order_key, next_key FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.ordered"""

QUERIES = {
    "progress_asof": (progress_asof, PROGRESS_ASOF),
    "order_prices_asof": (order_prices_asof, ORDER_PRICES_ASOF),
}
