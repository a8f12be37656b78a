"""Registered queries: streaming jobs run over all available input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.plans.q_scores import rounded
from murmura.plans.q_text import ROUNDS_SQL
from murmura.plans.star import Star
from murmura.streaming import jobs

EV_AS_OF = "2024-01-31 00:00:00"


def _events(s: Star) -> DataFrame:
    return jobs.read_events(s.spark, s.sf_dir)


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, doubles to fixed places."""
    return rounded(df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in df.dtypes)))


def dedupe(s: Star) -> DataFrame:
    """Every event as an item that shares its url with some and its content with others."""
    k = F.col("event_id")
    items = _events(s).select(k.alias("id"), F.concat(F.lit("u"), F.when(k % 3 != 0, k % 701).otherwise(k)).alias("url_key"), F.concat(F.lit("h"), F.when(k % 5 != 0, k % 907).otherwise(k)).alias("hash_key"), F.col("ts").alias("collected_at"))
    return jobs.ingest_dedupe(items).select("id", "url_key", "hash_key")


def cursor(s: Star) -> DataFrame:
    cursors = s.table("events").where("user_id % 2 = 0").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp") - F.expr("INTERVAL 10 DAYS")).alias("cursor"))
    rows = jobs.run_available(jobs.after_cursor(_events(s), cursors).select("event_id", "user_id", "ts"), mode="append")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


QUERIES = {
    "t1_stream_ingest_dedupe": (
        dedupe,
        f"""WITH RECURSIVE arrivals AS (SELECT event_id AS id, 'u' || CASE WHEN event_id % 3 <> 0 THEN event_id % 701 ELSE event_id END AS u, 'h' || CASE WHEN event_id % 5 <> 0 THEN event_id % 907 ELSE event_id END AS h, ts AS came FROM events),
{ROUNDS_SQL} SELECT id, u AS url_key, h AS hash_key FROM w WHERE status = 1""",
    ),
    "t2_tumbling_metrics": (
        lambda s: _plain(jobs.run_available(jobs.tumbling_metrics(_events(s)), mode="complete")),
        "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    ),
    "t3_sliding_reputation": (
        lambda s: _plain(jobs.run_available(jobs.sliding_mean(_events(s)), mode="complete")),
        """WITH w AS (SELECT unnest(generate_series(0, 6)) AS k), e AS (SELECT date_trunc('day', ts)::TIMESTAMP - to_days(CAST(k AS INT)) AS start, event_type, value FROM events, w)
SELECT start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM e GROUP BY 1, 2""",
    ),
    "t4_late_coverage": (
        lambda s: jobs.run_available(jobs.covered(_events(s), EV_AS_OF, 10).select("event_id", "event_type"), mode="append").groupBy("event_type").agg(F.count("*").alias("n")),
        f"SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{EV_AS_OF}' - INTERVAL 10 DAY GROUP BY 1",
    ),
    "t5_incident_sessions": (
        lambda s: _plain(jobs.run_available(jobs.sessions(_events(s)), mode="complete")),
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    ),
    "t6_source_health_state": (
        lambda s: jobs.run_available(jobs.source_health(_events(s)), mode="update", merge=jobs.newest_per_key, keys=["user_id"]).select("user_id", "failures", "broken"),
        """WITH m AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN ts END) OVER (PARTITION BY user_id) AS ok FROM events)
SELECT user_id, count(*) FILTER (ok IS NULL OR ts > ok) AS failures, count(*) FILTER (ok IS NULL OR ts > ok) >= 5 AS broken FROM m GROUP BY 1""",
    ),
    "t9_incremental_cursor": (
        cursor,
        """WITH c AS (SELECT user_id, max(ts) - INTERVAL 10 DAY AS cursor FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT user_id, count(*) AS n FROM events LEFT JOIN c USING (user_id) WHERE cursor IS NULL OR ts > cursor GROUP BY 1""",
    ),
}
