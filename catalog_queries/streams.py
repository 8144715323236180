"""Batch twins of the streaming operators (the same expressions run on streams)."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.streaming import streams as K

from .base import query

N = "CAST(count(*) AS BIGINT)"


def events(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("hourly_failure_rate", f"""SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) FILTER (WHERE event_type='purchase') AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE event_type='error') AS BIGINT) AS failed,
 coalesce(round(count(*) FILTER (WHERE event_type='error') * 100 / nullif(count(*) FILTER (WHERE event_type IN ('purchase','error')), 0), 1), -1) AS fail_rate_pct FROM events GROUP BY 1""")
def hourly_failure_rate(t):
    d = K.failure_rate(events(t), "ts", "event_type", "purchase", "error")
    return d.select(stamp("window_start").alias("window_start"), "ok", "failed", F.coalesce("fail_rate_pct", F.lit(-1.0)).alias("fail_rate_pct"))


@query("sliding_activity", f"""WITH w AS (SELECT user_id, time_bucket(INTERVAL '10 minutes', ts) - INTERVAL '10 minutes' * k AS s FROM events, (SELECT unnest(range(0, 6)) AS k)) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, user_id, {N} AS events FROM w GROUP BY 1, 2""")
def sliding_activity(t):
    d = K.sliding_activity(events(t), "ts", "user_id", "60 minutes", "10 minutes")
    return d.select(stamp("window_start").alias("window_start"), "user_id", "events")


@query("activity_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '4 hours' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, {N} AS events FROM n GROUP BY user_id, k""")
def activity_sessions(t):
    d = K.sessions(events(t), "ts", "user_id", "4 hours")
    return d.select("user_id", stamp("session_start").alias("session_start"), "events")


@query("price_as_of", """WITH r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'signup'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT event_id, coalesce(value, -1) AS price FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts""")
def price_as_of(t):
    e = events(t).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    r = events(t).filter("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("price"))
    return K.latest_asof(e, r, "user_id", "ts", "at", "price", 86_400).select("event_id", F.coalesce("price", F.lit(-1.0)).alias("price"))


@query("audit_log_by_day", f"SELECT strftime(ts, '%Y-%m-%d') AS event_date, event_type, {N} AS n FROM events GROUP BY 1, 2")
def audit_log_by_day(t):
    return events(t).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("event_date"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("deduped_events", "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY ALL")
def deduped_events(t):
    d = events(t).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return d.dropDuplicates(["user_id", "event_type", "day"])
