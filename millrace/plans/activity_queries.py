"""Queries over activity, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.sources import domain
from millrace.streaming import activity


@query(
    "activity_windows",
    "SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, epoch(date_trunc('second', min(ts)))::BIGINT AS first, epoch(date_trunc('second', max(ts)))::BIGINT AS last, "
    "count(DISTINCT event_id % 7) AS session_count, array_to_string(list_sort(list(DISTINCT '10.0.0.' || event_id % 5)), '|') AS unique_ips FROM events GROUP BY 1, 2",
)
def activity_windows(spark, sf):
    """With sessions and addresses made up by the event's number."""
    e = domain.table(spark, sf, "events").withColumns({"session_id": F.col("event_id") % 7, "ip_address": F.concat(F.lit("10.0.0."), (F.col("event_id") % 5).cast("string"))})
    w = activity.windows(e)
    return w.select(
        "user_id", F.unix_timestamp("window.start").alias("start"), "n", "n_view", "n_purchase", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last").alias("last"), "session_count",
        F.array_join("unique_ips", "|").alias("unique_ips"),
    )


_SESSIONS = (
    "SELECT user_id, sid, count(*) AS n, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS s FROM ("
    "SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2"
)


@query(
    "activity_summary",
    f"SELECT count(*) AS total, count(DISTINCT user_id) AS users, (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS by_type, "
    f"(SELECT string_agg(h || '=' || n, ',' ORDER BY h) FROM (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1)) AS by_hour, round((SELECT avg(s) FROM ({_SESSIONS})), 6) AS mean_session FROM events",
)
def activity_summary(spark, sf):
    m = activity.metrics(domain.table(spark, sf, "events"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["k"].cast("string"), F.lit("="), x["n"].cast("string"))), ",").alias(c)
    return m.select("total", "users", listed("by_type"), listed("by_hour"), F.round("mean_session", 6).alias("mean_session"))


@query("activity_metrics", "SELECT hour(ts)::INT AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def activity_metrics(spark, sf):
    return domain.table(spark, sf, "events").groupBy(F.hour("ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "session_duration",
    "SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, sum(s)::BIGINT AS seconds FROM (SELECT user_id, sid, count(*) AS n, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS s FROM ("
    "SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1",
)
def session_duration(spark, sf):
    s = activity.sessions(domain.table(spark, sf, "events"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.sum("seconds").alias("seconds"))


@query("realtime_counters", "SELECT * FROM counters", ["counters"])
def realtime_counters(spark, sf):
    return domain.counters(spark, sf)
