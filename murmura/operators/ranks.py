"""Ranks, latest rows, running caps, top lists and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each key; Spark prunes to n rows a task before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def cumulative_cap(slices: DataFrame, keys: list[str], order: list, amount: str, cap: int) -> DataFrame:
    """status of each slice: kept until the sum of earlier slices reaches the cap."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(amount).over(w), F.lit(0))
    return slices.withColumn("earlier", earlier).withColumn("status", F.when(F.col("earlier") >= cap, "SKIPPED").otherwise("KEPT"))


def shown_rank(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Competition rank of scores as shown, with one decimal."""
    shown = F.round(score, 1)
    return rows.withColumn("shown_rank", F.rank().over(Window.partitionBy(*keys).orderBy(shown.desc())))


def score_change(history: DataFrame, keys: list[str], order: list, score: str) -> DataFrame:
    """Latest less oldest score of each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = history.select(*keys, F.first(score).over(w).alias("oldest"), F.last(score).over(w).alias("latest")).distinct()
    return ends.withColumn("change", F.col("latest") - F.col("oldest"))


def penalty_streak(runs: DataFrame, key: str, order: list, ok: Column) -> DataFrame:
    """Failures since the last success of each key, and their penalty: 0.2 each, 1 at most."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = runs.withColumn("island", F.sum(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = marked.groupBy(key).agg(F.max("island").alias("island"))
    fails = marked.join(last, [key, "island"]).groupBy(key).agg(F.sum((~ok).cast("int")).alias("failures"))
    return fails.withColumn("penalty", F.least(F.col("failures") * 0.2, F.lit(1.0)))


def run_limits(starts: DataFrame, key: str, at: str, *, cooldown_hours: int, daily: int, as_of: str) -> DataFrame:
    """Earliest next run of each key: last start plus cooldown, and a day after the n-th latest start of the last day."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    recent = starts.where(F.col(at) >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL 24 HOURS")).withColumn("k", F.row_number().over(w))
    nth = recent.where(F.col("k") == daily).select(key, (F.col(at) + F.expr("INTERVAL 24 HOURS")).alias("full_until"))
    last = starts.groupBy(key).agg((F.max(at) + F.expr(f"INTERVAL {cooldown_hours} HOURS")).alias("cool_until"))
    return last.join(nth, key, "left").select(key, F.greatest("cool_until", "full_until").alias("next_run"))


def stream_order(rows: DataFrame, flagged: Column, order: list) -> DataFrame:
    """Flagged rows first, then the rest, each by ``order``: position within the client."""
    w = Window.partitionBy("client_id").orderBy(flagged.desc(), *order)
    return rows.withColumn("position", F.row_number().over(w))


def health_latest(runs: DataFrame, key: str, order: list, ok: Column, at: str, broken: int = 5) -> DataFrame:
    """Failures since the last success of each key, penalty, last success and status: HEALTHY, DEGRADED or BROKEN."""
    last = runs.groupBy(key).agg(F.max(F.when(ok, F.col(at))).alias("last_success"))
    status = F.when(F.col("failures") >= broken, "BROKEN").when(F.col("failures") > 0, "DEGRADED").otherwise("HEALTHY")
    return penalty_streak(runs, key, order, ok).join(last, key).withColumn("status", status)
