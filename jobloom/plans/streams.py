"""Stream queries: each runs over the events there are and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.plans.queries import query
from jobloom.session import table
from jobloom.streaming import events as ev


@query("""
SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    x = ev.run_once(ev.tumbling(ev.read_events(spark, d), "1 day", "2 days"), "windows", "complete")
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 2).alias("value"))


@query("SELECT user_id, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    x = ev.read_events(spark, d)
    x = ev.run_once(ev.once(x.select("event_id", "user_id", "ts"), ["event_id"], "1 day"), "once")
    return x.groupBy("user_id").agg(F.count("*").alias("events"))


@query("""
WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
  s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l)
SELECT user_id, count(DISTINCT n) AS sessions, count(*) AS events FROM s GROUP BY 1""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = ev.run_once(ev.sessions(ev.read_events(spark, d), "6 hours", "2 days"), "sessions", "complete")
    return x.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  g(user_id, n, last, granted) AS (SELECT user_id, n, ts, true FROM o WHERE n = 1
    UNION ALL SELECT o.user_id, o.n, CASE WHEN o.ts - g.last >= INTERVAL 12 HOURS THEN o.ts ELSE g.last END, o.ts - g.last >= INTERVAL 12 HOURS FROM g JOIN o ON o.user_id = g.user_id AND o.n = g.n + 1)
SELECT user_id, count(*) AS claims, count(*) FILTER (granted) AS granted FROM g GROUP BY 1""")
def stream_claims(spark: SparkSession, d: str) -> DataFrame:
    """Rate-limited claims by user: granted at most once in twelve hours."""
    x = ev.run_once(ev.claims(ev.read_events(spark, d).select("user_id", "ts"), "user_id", 43_200), "claims")
    return x.groupBy("user_id").agg(F.count("*").alias("claims"), F.count_if("granted").alias("granted"))


_ARRIVALS = """WITH e AS (SELECT *, (floor((epoch(ts + CASE WHEN event_id % 10 = 0 THEN INTERVAL 3 DAYS ELSE INTERVAL 0 DAYS END) - epoch(TIMESTAMP '2024-01-01')) / 432000))::int AS part FROM events),
  m AS (SELECT part, max(max(ts)) OVER (ORDER BY part) - INTERVAL 2 DAYS AS mark FROM e GROUP BY 1)"""


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    """Events as they arrive, one in ten three days late, in micro-batches of five days."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.when(F.col("event_id") % 10 == 0, 3 * 86_400).otherwise(0)
    e = e.withColumn("part", F.floor((F.unix_micros("ts") / 1_000_000 + late - F.unix_seconds(F.to_timestamp(F.lit("2024-01-01")))) / 432_000).cast("int"))
    return ev.replay(e, F.col("part"), e.agg(F.max("part")).first()[0] + 1)  # one number


@query(_ARRIVALS + """
SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events FROM e LEFT JOIN m ON m.part = e.part - 2
WHERE (mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > date_trunc('milliseconds', mark)) AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(mark) FROM m) GROUP BY 1, 2""")
def stream_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day that the watermark has closed, in append mode over several micro-batches: rows that come after
    their window was closed are dropped, windows still open at the end aren't given out."""
    x = ev.run_once(ev.tumbling(_arriving(spark, d), "1 day", "2 days"), "closed")
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events")
