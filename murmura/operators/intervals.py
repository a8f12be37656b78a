"""Totals of events inside intervals of the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_totals(events: DataFrame, intervals: DataFrame, key: str, *, at: str, start: str, end: str, by: list[str], sums: dict[str, str], bucket: str = "day") -> DataFrame:
    """``by`` columns of each interval with n (events of its ``key`` from ``start`` to ``end``, both included) and ``sums`` (name: numeric
    column of the events); intervals without events don't come back.

    A sweep of prefix sums: an interval is two bounds, whatever its length or its overlaps, and its total is the difference of
    the running sums there. Running sums are taken within (key, bucket of time) and moved on by the buckets before, so a
    key of many events is spread over its buckets. Rows with a null key, time or bound have no part."""
    measures = {"n": F.lit(1).cast("long"), **{name: F.coalesce(F.col(c), F.lit(0)) for name, c in sums.items()}}
    calls = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).alias("_at"), F.lit(1).alias("_rank"), *(c.alias(f"_{m}") for m, c in measures.items()))
    bound = lambda c, rank, sign: F.struct(F.col(c).alias("_at"), F.lit(rank).alias("_rank"), F.lit(sign).alias("_sign"))
    spans = intervals.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.array(bound(start, 0, -1), bound(end, 2, 1))))
    bounds = spans.select(key, "_b.*", F.struct(*by).alias("_by"))
    rows = calls.unionByName(bounds, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_at"))
    inner = Window.partitionBy(key, "_bucket").orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_{m}" for m in measures]
    running = rows.select(key, "_bucket", "_sign", "_by", *(F.sum(F.coalesce(m, F.lit(0))).over(inner).alias(m) for m in names)).where("_sign IS NOT NULL")
    totals = calls.groupBy(key, F.date_trunc(bucket, "_at").alias("_bucket")).agg(*(F.sum(m).alias(m) for m in names))
    # A bucket where a bound stands may hold no event: it comes in with nothing.
    every = totals.unionByName(running.select(key, "_bucket").distinct(), allowMissingColumns=True).groupBy(key, "_bucket").agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in names))
    before = every.select(key, "_bucket", *(F.coalesce(F.sum(m).over(outer), F.lit(0)).alias(f"{m}_before") for m in names))
    placed = running.join(before, [key, "_bucket"])
    out = placed.groupBy("_by").agg(*(F.sum(F.col("_sign") * (F.col(f"_{m}") + F.col(f"_{m}_before"))).alias(m) for m in measures))
    return out.where("n > 0").select("_by.*", *measures)
