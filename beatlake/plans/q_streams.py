"""The streaming operators' batch counterparts, over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.plans.registry import query, table
from beatlake.streaming import detect as D


def stamped(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")


@query("session_events", """WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS b FROM events WHERE value > 20), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, (epoch_us(min(ts))) AS t_start, (epoch_us(max(ts))) AS t_end, max(value) AS peak_value, count(*) AS n_points FROM i GROUP BY user_id, k""")
def session_events(spark, sf_dir):
    x = D.session_events(stamped(spark, sf_dir), "user_id", "ts", "value", 20.0, "12 hours", "1 hour")
    return x.select("user_id", F.unix_micros("t_start").alias("t_start"), F.unix_micros("t_end").alias("t_end"), "peak_value", "n_points")


@query("tumbling_quality", "SELECT user_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS w_start, count(*) AS n, round(stddev_pop(value), 6) AS std, round(max(value) - min(value), 6) AS range FROM events GROUP BY 1, 2")
def tumbling_quality(spark, sf_dir):
    x = D.tumbling_quality(stamped(spark, sf_dir), "user_id", "ts", "value", "1 day", "1 hour")
    return x.select("user_id", F.unix_micros("w_start").alias("w_start"), "n", F.round("std", 6).alias("std"), F.round("range", 6).alias("range"))
