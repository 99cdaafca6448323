"""Queries that run as streams, and the same over the whole table in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import access
from veritrail.plans import decisions
from veritrail.streaming import events


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """2.19, 2.16."""
    got = events.finished(events.tumbling(events.stream_of(spark, d, "events")), "complete")
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "most")


def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    got = events.finished(events.sliding(events.stream_of(spark, d, "events")), "complete")
    return got.select(F.col("window.start").alias("start"), "n")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Z4 as windows: a session ends half an hour after its last event."""
    got = events.finished(events.by_session(events.stream_of(spark, d, "events")), "complete")
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def watermark_dedup(spark: SparkSession, d: str) -> DataFrame:
    """D1 as a stream: kinds of events that each user has had."""
    return events.finished(events.first_seen(events.stream_of(spark, d, "events"), ["user_id", "event_type"]), "append").select("user_id", "event_type")


def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """Z1 as a stream."""
    most, seconds = access.POLICIES["resend_verification"]
    return events.limited(events.stream_of(spark, d, "events"), most, seconds * 40).select("event_id", "limited")


def rate_limit_reset_stream(spark: SparkSession, d: str) -> DataFrame:
    """Z9 as a stream: a purchase resets its user."""
    most, seconds = access.POLICIES["resend_verification"]
    e = events.stream_of(spark, d, "events")
    return events.limited(e.withColumn("reset", F.col("event_type") == "purchase"), most, seconds * 40)


QUERIES = {f.__name__: f for f in (tumbling_counts, sliding_counts, session_windows, watermark_dedup, rate_limit_stream, rate_limit_reset_stream)}
SQL = {
    "tumbling_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2",
    "sliding_counts": "SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "watermark_dedup": "SELECT DISTINCT user_id, event_type FROM events",
}
SQL["rate_limit_stream"] = f"SELECT event_id, limited FROM ({decisions.SQL['rate_limit_decisions']})"
SQL["rate_limit_reset_stream"] = decisions.SQL["rate_limit_resets"]
