"""Shards by a k-d tree over document metadata.

A node splits at the weighted median (weight: bytes) of its widest metadata dimension, until leaves reach the target
bytes. Medians are found for all nodes of a level at once by five rounds of 12-bit digits over sums that tasks make
before the shuffle; ties of the dimension go by a hash of the row, equal rows by their places in the table. Nodes are
rows of a table, so the driver holds none of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.scratch import materialize

DIGIT, ROUNDS = 12, 5
#: A column of this name in the documents is taken as the number of each row.
PLACE = "kd place"
HALF = 24  # bits of the dimension, and of the tie; one more digit parts equal rows


def metadata(docs: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, tie, place (number of the row, that of ``docs`` if it has one) and the
    dimensions as doubles."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    place = F.col(PLACE) if PLACE in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), place.alias("place"), *(c.cast("double").alias(f"dim_{k}") for k, c in dimensions.items()))
    tie = F.xxhash64("doc_id", "text_crc32", "size").bitwiseAND(F.lit((1 << HALF) - 1))
    return rows.withColumn("tie", tie)


def with_copies(rows: DataFrame, run: int) -> DataFrame:
    """``rows`` with copy: 0, but for ties of more than ``run`` rows (runs of equal rows) a hash of their place.

    At most rows / run ties are that heavy; Spark broadcasts them below its size threshold."""
    heavy = rows.groupBy("tie").count().where(F.col("count") > run).select("tie", F.lit(True).alias("heavy"))
    copy = F.xxhash64("place").bitwiseAND(F.lit((1 << DIGIT) - 1))
    return rows.join(heavy, "tie", "left").withColumn("copy", F.when(F.col("heavy"), copy).otherwise(F.lit(0).cast("long"))).drop("heavy")


def default_dimensions() -> dict[str, Column]:
    """Language and source by hash, bytes by logarithm, doc_id: null is 0."""
    unit = lambda c: (F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))).bitwiseAND(F.lit((1 << HALF) - 1)))
    return {
        "lang": unit("lang"),
        "source": unit("source"),
        "bytes": F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1.0),
        "doc_id": F.coalesce("doc_id", F.lit(0)),
    }


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None, run: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard of every row of ``docs`` (doc_id, text, lang, source).

    ``target_bytes`` sets the number of shards if ``shards`` does not. A node of k leaves splits its bytes at k // 2 of
    k. A null text has no bytes, null doc_ids, languages and sources are values, texts of any length count whole, an empty
    table gives no rows, other columns are left aside. Equal rows share all dimensions and their tie; where more than
    ``run`` of them meet (or sixteen times the rows that share a tie by chance), they part by place in the table, so a heavy
    run of repeats doesn't break the law. Reruns over the same files agree.
    """
    spark = docs.sparkSession
    dimensions = dimensions or default_dimensions()
    rows = materialize(metadata(docs, dimensions), "kd-metadata")
    dims = [f"dim_{k}" for k in dimensions]
    # One row reaches the driver: the bytes and the range of each dimension.
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).first()
    leaves = shards or max(1, -(-whole["bytes"] // target_bytes))
    # Dimensions as 24-bit numbers over their range in the whole table, so that widths compare.
    scale = {d: ((whole[f"hi_{d}"] or 0) - (whole[f"lo_{d}"] or 0)) or 1.0 for d in dims}
    top = (1 << HALF) - 1
    rows = rows.withColumns({d: F.floor((F.col(d) - F.lit(whole[f"lo_{d}"] or 0.0)) / scale[d] * top).cast("long") for d in dims})
    rows = with_copies(rows, max(run, 16 * whole["n"] >> HALF))
    rows = (rows if PLACE in docs.columns else rows.drop("place")).withColumn("node", F.lit(0).cast("long"))
    nodes = spark.range(1).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("first"), F.lit(leaves).cast("long").alias("k"))
    for _ in range(math.ceil(math.log2(leaves))):
        rows, nodes = split_level(rows, nodes, dims)
    kept = ["doc_id", "size", "text_crc32", "tie", "copy", *(["place"] if PLACE in docs.columns else [])]
    return rows.join(nodes, "node").select(*kept, F.col("first").cast("int").alias("shard"))


def split_level(rows: DataFrame, nodes: DataFrame, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``nodes`` (node, first leaf, k leaves) with every node of several leaves split in two.

    ``nodes`` has a row for each node of the level, which Spark broadcasts below its size threshold; above it no node has
    more than a small share of the rows."""
    live = nodes.where("k > 1")
    widths = rows.join(live.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("size").alias("bytes"), *((F.max(d) - F.min(d)).alias(d) for d in dims))
    widest = F.array_max(F.array(*(F.struct(F.col(d).alias("width"), F.lit(-i).alias("i")) for i, d in enumerate(dims))))
    half = F.expr("k div 2")
    plan = live.join(widths, "node").select("node", "first", "k", (-widest["i"] + 1).alias("dim"), (F.col("bytes") * half / F.col("k")).alias("goal"))
    plan = materialize(plan, "kd-nodes")
    value = F.element_at(F.array(*dims), F.col("dim"))
    key = F.shiftleft(F.shiftleft(value, HALF) + F.col("tie"), DIGIT) + F.col("copy")
    keyed = rows.join(plan.select("node", "dim"), "node", "left").withColumn("key", key)
    cut = plan.select("node", "goal", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for r in range(ROUNDS):
        shift = DIGIT * (ROUNDS - 1 - r)
        inside = keyed.join(cut, "node").where(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
        sums = inside.groupBy("node", F.shiftright("key", shift).alias("digit")).agg(F.sum("size").alias("bytes"), F.first("goal").alias("goal"), F.first("below").alias("below"))
        # At most 4,096 digits for each node stand in this window.
        upto = F.col("below") + F.sum("bytes").over(Window.partitionBy("node").orderBy("digit"))
        reached = sums.withColumn("upto", upto).where("upto >= goal")
        cut = materialize(reached.groupBy("node", "goal").agg(F.min(F.struct("digit", (F.col("upto") - F.col("bytes")).alias("under"), "upto")).alias("c")).select("node", "goal", F.col("c.digit").alias("prefix"), F.col("c.under").alias("below"), "c.upto"), "kd-cut")
        if r < ROUNDS - 1:
            cut = cut.drop("upto")
    # The key at the median goes to the nearer side.
    last = F.when(F.col("upto") - F.col("goal") <= F.col("goal") - F.col("below"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    right = (F.col("key") > F.col("cut")).cast("long")
    moved = keyed.join(cut.select("node", last.alias("cut")), "node", "left")
    moved = moved.withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + right)).drop("dim", "key", "cut")
    child = lambda node, first, k: F.struct(node.alias("node"), first.alias("first"), k.alias("k"))
    node, first, k = F.col("node"), F.col("first"), F.col("k")
    children = F.explode(F.array(child(2 * node + 1, first, half), child(2 * node + 2, first + half, k - half)))
    below = plan.select(children.alias("c")).select("c.*").unionByName(nodes.where("k = 1"))
    return materialize(moved, "kd-level"), materialize(below, "kd-nodes")


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: a shard's rows go by hash buckets, so no shard is sorted by one task."""
    placed = placed.withColumn("bucket", F.when(F.col("copy") > 0, 4096 + F.col("copy")).otherwise(F.xxhash64("tie").bitwiseAND(F.lit(0xFFF))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "doc_id", "text_crc32", "size", "copy"))
    return placed.withColumn("rank", local).join(base, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("rank") - 1).drop("bucket", "rank", "base")


def write_shards(docs: DataFrame, path: str, **how: object) -> str:
    """Write every row of ``docs``, with all its columns, once under ``path``/shard=N, and return the name of that column.

    ``how`` goes to `kd_shards`. Rows are numbered before the tree is built and find their shard by number, so null and repeated
    doc_ids do; a column of ``docs`` called shard gets the new one an underscore in front. A shard's rows go by number to as many
    files as tasks wrote, and each of them to one file."""
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    held = materialize(docs.select(whole, "doc_id", "text", "lang", "source").withColumn(PLACE, F.monotonically_increasing_id()), "kd-rows")
    placed = kd_shards(held, **how).select("place", F.col("shard").alias(name))
    rows = held.join(placed, F.col(f"`{PLACE}`") == F.col("place")).withColumn("spread", F.pmod(F.xxhash64("place"), F.lit(64)))
    rows.repartition(name, "spread").select("row.*", name).write.partitionBy(name).parquet(path)
    return name
