"""Time windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.sources.tables import load
from loomstone.streaming import windows

from .registry import register


@register("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return windows.tumbling(load(spark, d, "events")).withColumn("total", F.round("total", 4))


@register(
    "events_sessionize",
    """WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events))
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def events_sessionize(spark, d):
    return windows.sessionize(load(spark, d, "events"))
