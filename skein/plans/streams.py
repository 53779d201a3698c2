"""Queries of the streaming operators (T03, T05-T10, T13, T16): drained streams equal their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.registry import query
from skein.streaming import runs as R


@query("t07_daily_tumbling_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def t07(s: SparkSession, d: str) -> DataFrame:
    return R.drained(R.tumbling(R.event_stream(s, d)), "t07")


@query("t08_sliding_stream", """SELECT strftime(g, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-01', INTERVAL 1 DAY) t(g)
  WHERE ts >= g AND ts < g + INTERVAL 7 DAY GROUP BY 1, 2""")
def t08(s: SparkSession, d: str) -> DataFrame:
    return R.drained(R.sliding(R.event_stream(s, d), "7 days", "1 day"), "t08")


@query("t09_day_windows_stream", """SELECT strftime(g, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-01', INTERVAL 6 HOUR) t(g)
  WHERE ts >= g AND ts < g + INTERVAL 24 HOUR GROUP BY 1, 2""")
def t09(s: SparkSession, d: str) -> DataFrame:
    return R.drained(R.sliding(R.event_stream(s, d), "24 hours", "6 hours"), "t09")


@query("t10_first_views_stream", "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events WHERE event_type = 'view'")
def t10(s: SparkSession, d: str) -> DataFrame:
    return R.drained(R.first_views(R.event_stream(s, d)), "t10", "append").select("user_id", "day", "event_type")


@query("t13_session_stream", """SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, g""")
def t13(s: SparkSession, d: str) -> DataFrame:
    return R.drained(R.sessions(R.event_stream(s, d)), "t13")


@query("t03_rate_limiter_stream")
def t03(s: SparkSession, d: str) -> DataFrame:
    return R.drained(R.rate_limited(R.event_stream(s, d), 3, 6 * 3600), "t03", "append")


@query("t05_payload_bounds", r"SELECT event_id, regexp_replace(regexp_replace(substr(props, 1, 100), '[^ @]+@[^ @]+', '', 'g'), '[0-9]{5,}', '', 'g') AS detail, greatest(0, least(value, 50)) AS value FROM events")
def t05(s: SparkSession, d: str) -> DataFrame:
    detail = F.regexp_replace(F.regexp_replace(F.substring("props", 1, 100), "[^ @]+@[^ @]+", ""), "[0-9]{5,}", "")
    return s.read.parquet(f"{d}/events.parquet").select("event_id", detail.alias("detail"), F.greatest(F.lit(0.0), F.least("value", F.lit(50.0))).alias("value"))


@query("t06_gate_counters_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN value < 1 THEN 'client' WHEN user_id % 13 = 0 THEN 'origin' ELSE 'ok' END AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def t06(s: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("value") < 1, "client").when(F.col("user_id") % 13 == 0, "origin").otherwise("ok")
    n = R.event_stream(s, d).groupBy(F.window("ts", "1 day"), reason.alias("reason")).agg(F.count("*").alias("n"))
    return R.drained(n.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "reason", "n"), "t06")


@query("t16_read_depth_stream", "SELECT user_id, round(max(value), 6) AS depth FROM events WHERE event_type = 'purchase' GROUP BY 1")
def t16(s: SparkSession, d: str) -> DataFrame:
    n = R.event_stream(s, d).where("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.max("value"), 6).alias("depth"))
    return R.drained(n, "t16")


_SETTLED = """WITH RECURSIVE a AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1
  UNION ALL SELECT a.user_id, min(e.ts) AS t FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.t + INTERVAL 29 HOUR GROUP BY a.user_id, a.t)
SELECT e.event_id, e.user_id, epoch_us(max(a.t)) AS first_us FROM events e JOIN a ON a.user_id = e.user_id AND a.t <= e.ts
WHERE e.ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2"""


@query("t12_settled_runs_stream", _SETTLED)
def t12_settled(s: SparkSession, d: str) -> DataFrame:
    """Runs of users' events, each told once when a day has passed: what of the last day is still open isn't told."""
    store = "spark.sql.streaming.stateStore.providerClass"
    was = s.conf.get(store)
    s.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return R.drained(R.settled_runs(R.event_stream(s, d), 29 * 3600, "1 day"), "t12-settled", "append")
    finally:
        s.conf.set(store, was)
