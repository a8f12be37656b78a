"""Mixing sources to target weights over a time-varying curriculum, in DataFrame expressions only.

Source i has weight w_i(t) = target_i * (1 + slope_i * (2t - 1)) at schedule time t in [0, 1]. Its cumulative token
demand is the schedule's integral, target_i * (t + slope_i * (t^2 - t)). A document whose words start at word c of its
source's supply is due when demand reaches c, at the inverse of the integral. The weights of all sources sum to a total
that moves with t, so the training position is the share of all tokens consumed by then: the integral of the total,
t + pace * (t^2 - t), where pace is the targets' mean slope. Documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.scratch import materialize

#: Words: maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(
    sizes: DataFrame,
    *,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    slopes: Sequence[float] = (0.5, 0.0, -0.5),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """source, source_size, target, slope, pace: one row for each source of ``sizes`` (source, size), null included.

    Sources by code point, null last, take ``weights`` and ``slopes`` in turn. Together they share ``share`` times all
    sizes by weight; a target stops at ``most`` times its source's size and the excess goes to the others by weight:
    with sources in order of limit / weight, the first level that no later limit falls below is the water level.
    """
    # One row for each source stands in these windows, however large the corpus is.
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, map(float, values))), (F.col("rank") % len(values) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumns({"weight": pick(weights), "slope": pick(slopes), "limit": F.col("source_size") * F.lit(float(most))})
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    water = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least("limit", F.coalesce(water * F.col("weight"), F.col("limit")))
    per = per.select("source", "source_size", target.alias("target"), "slope")
    pace = F.round(F.sum(F.col("target") * F.col("slope")).over(everything) / F.sum("target").over(everything), 9)
    return per.withColumn("pace", F.coalesce(pace, F.lit(0.0)))


def due(at: Column, target: Column, slope: Column) -> Column:
    """Schedule time at which a source's cumulative demand reaches ``at`` words: the inverse of the integral."""
    x = at / target
    root = F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * x, F.lit(0.0)))
    return F.when(slope == 0, x).otherwise((root - (1 - slope)) / (2 * slope))


def consumed(t: Column, pace: Column) -> Column:
    """Share of all tokens that the mix has consumed at schedule time ``t``."""
    return t + pace * (t * t - t)


def drawn(seed: int) -> Column:
    """Place of a document in its source's order, as a hexadecimal string; rows that share or lack an id spread by text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))


def mixed_documents(docs: DataFrame, *, seed: int = 7, **targets) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) as doc_id, source, size, source_size, target, taken, positions, draw.

    A source's supply is its documents in the order of MD5(seed:doc_id:MD5(text)), read at most twice; ``taken`` counts the words
    of a document below the source's target, ``positions`` holds the training position of each reading. A null or empty
    text has size 0, takes 0 words and has no positions; texts of any length are counted whole; a null source is a source,
    a null doc_id a document; repeated rows are documents of their own; an empty table gives no rows; other columns are
    left aside. Three hexadecimal digits split each source's order into 4,096 buckets, so that no source
    is sorted by one task.
    """
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), drawn(seed).alias("draw"))
    sizes = materialize(sizes.withColumn("bucket", F.substring("draw", 1, 3)), "mix-sizes")
    goal = materialize(source_targets(sizes.select("source", "size"), **targets), "mix-targets")
    filled = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = filled.select("source", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sizes.withColumn("upto", F.sum("size").over(local)).alias("d")
    placed = placed.join(base.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")))
    placed = placed.select("d.doc_id", "d.source", "d.size", "d.draw", (F.col("base") + F.col("upto") - F.col("size")).alias("start")).alias("p")
    placed = placed.join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.*", "source_size", "target", "slope", "pace")
    whole = F.floor("target")
    reading = lambda k: F.greatest(F.least(whole - F.col("source_size") * k - F.col("start"), F.col("size")), F.lit(0))
    at = lambda k: F.when(reading(k) > 0, consumed(due(F.col("source_size") * k + F.col("start"), F.col("target"), F.col("slope")), F.col("pace")))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (reading(0) + reading(1)).cast("long").alias("taken"),
        F.array_compact(F.array(at(0), at(1))).alias("positions"), "draw",
    )


def repeated_documents(docs: DataFrame, *, seed: int = 7, **targets) -> DataFrame:
    """The rows of ``docs``, each as often as the mix reads it, to the nearest whole reading (0, 1 or 2 times).

    Readings fall along a source's order, so two places in it, one row for each source, say how often any document is
    read: texts are neither shuffled nor joined by id. A text without words is not read; equal rows fare alike; all
    columns stay as they are, whatever names they have."""
    mixed = mixed_documents(docs.select("doc_id", "text", "source"), seed=seed, **targets)
    times = F.round(F.try_divide("taken", "size"))
    reached = lambda k: F.max(F.when(times >= k, F.col("draw")))
    limits = mixed.groupBy(F.col("source").alias("of")).agg(reached(1).alias("once"), reached(2).alias("twice"))
    limits = materialize(limits, "mix-limits")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    some = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False)).cast("int").alias("some")
    both = docs.select(row, "source", drawn(seed).alias("draw"), some).join(limits, F.col("source").eqNullSafe(F.col("of")))
    upto = lambda c: F.coalesce(F.col("draw") <= F.col(c), F.lit(False)).cast("int")
    return both.select("row", F.explode(F.array_repeat(F.lit(1), F.col("some") * (upto("once") + upto("twice"))))).select("row.*")


def training_order(mixed: DataFrame) -> DataFrame:
    """The mix as readings (doc_id, source, position), range-sorted by position."""
    readings = mixed.select("doc_id", "source", F.explode("positions").alias("position"))
    return readings.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
