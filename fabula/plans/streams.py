"""Queries that run Structured Streaming over a table until all of it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.plans.registry import Registry
from fabula.streaming import logs

registry = Registry()
query = registry.add


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    """Tumbling hours of event time, as a stream in complete mode, which drops nothing."""
    done = logs.finish(logs.event_windows(logs.stream_table(spark, d, "events")))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


@query("SELECT run_id, step, loss, line FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY line DESC, loaded_at DESC) AS k FROM train_log WHERE step IS NOT NULL) WHERE k = 1")
def stream_last_rows(spark, d):
    return logs.finish(logs.last_rows(logs.stream_table(spark, d, "train_log"))).select("run_id", "step", "loss", "line")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN value >= 40 THEN 1 WHEN value <= 30 THEN 0 END AS mark FROM events),
    s AS (SELECT user_id, event_id, ts, coalesce(last_value(mark IGNORE NULLS) OVER w, 0) AS paused, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT user_id, CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (paused = 1 AND before = 0) AS BIGINT) AS pauses, arg_max(paused, (ts, event_id)) = 1 AS paused FROM s GROUP BY user_id""")
def stream_hysteresis(spark, d):
    """Events and pauses of each user under the stateful guard, and whether it is paused in the end."""
    out = logs.finish(logs.hysteresis(logs.stream_table(spark, d, "events"), 40.0, 30.0), "append")
    return out.groupBy("user_id").agg(F.sum("events").alias("events"), F.sum("pauses").alias("pauses"), F.max_by("paused", "turn").alias("paused"))
