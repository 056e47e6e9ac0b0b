"""Batch forms of the streaming plans: the same window expressions over the whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators.sequences import islands
from quillspark.plans.registry import query
from quillspark.session import table
from quillspark.streaming import windows as sw


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("tumbling_window", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    """Counts and sums per day and kind."""
    counts = sw.tumbling_counts(events(spark, sf_dir))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query(
    "session_windows",
    """
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, count(*) AS n FROM s GROUP BY user_id, k
    """,
)
def session_windows(spark, sf_dir):
    """Sessions of a user with a gap of six hours."""
    return sw.session_counts(events(spark, sf_dir)).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("begins"), "n")


@query("watermark_dedup", "SELECT event_id, user_id, event_type FROM events")
def watermark_dedup(spark, sf_dir):
    """A stream in which every event arrives twice, each event kept once: the streaming operator over all that is there."""
    twice = sw.event_stream(spark, sf_dir, pattern="events.parquet").unionByName(sw.event_stream(spark, sf_dir, pattern="events.parquet"))
    return sw.run_to_shared(sw.first_seen(twice).select("event_id", "user_id", "event_type"))


@query(
    "sliding_window",
    """
    SELECT strftime(begins, '%Y-%m-%d %H:%M') AS begins, event_type, count(*) AS n FROM (
      SELECT event_type, unnest([date_trunc('day', ts) + INTERVAL 6 HOUR * (hour(ts) // 6 - k) FOR k IN range(4)]) AS begins FROM events) GROUP BY ALL
    """,
)
def sliding_window(spark, sf_dir):
    """Counts per kind in windows of a day that begin every six hours."""
    counts = sw.sliding_counts(events(spark, sf_dir))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("begins"), "event_type", "n")


@query("batch_upserts", "SELECT event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY event_type")
def batch_upserts(spark, sf_dir):
    """Totals per kind kept up to date from a stream: each micro-batch is merged into the table of totals."""
    return sw.run_upserts(sw.event_stream(spark, sf_dir, pattern="events.parquet"))


@query(
    "repeat_watch",
    """
    WITH e AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS d FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, d ORDER BY ts, event_id) AS run FROM e)
    SELECT user_id, event_id, event_type FROM k WHERE run = 3
    """,
)
def repeat_watch(spark, sf_dir):
    """The event at which a user's third repeat running falls."""
    runs = islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    place = F.row_number().over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    return runs.withColumn("place", place).where("place = 3").select("user_id", "event_id", "event_type")
