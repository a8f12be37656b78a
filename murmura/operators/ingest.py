"""Deduplication and filters on arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.jsons import folded_json
from murmura.operators.components import heavy_rows, joined_by_key
from murmura.scratch import materialize


def ingest_dedupe(new: DataFrame, stored: DataFrame | None = None, stored_keys: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of ``new`` (id, url_key, hash_key, collected_at) that arrival in order would store.

    A row is stored if no stored row has its url or its hash; a suppressed row suppresses nothing. Rounds: rows that
    come first in both of their groups are accepted, then rows that share a key with an accepted one go; what is left
    starts the next round. Null keys count as one value. Firsts are found by sums that tasks make before the shuffle, and
    the rows of a heavy key (the null one, say) stay spread over all tasks. ``stored`` are rows stored before, ``stored_keys`` their keys in
    a table for each key."""
    keys = ("url_key", "hash_key")
    held = lambda df: df.withColumns({f"_{k}": F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys})
    left, accepted = held(new).withColumn("_at", F.struct("collected_at", "id")), None
    for k in keys:
        for before in (stored, (stored_keys or {}).get(k)):
            if before is not None:
                taken = before.select(F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"_{k}"))
                left = left.join(taken.distinct(), f"_{k}", "left_anti")
    left = materialize(left, "dedupe-left")
    while not left.isEmpty():
        heavy = heavy_rows(left.count())
        groups = {k: left.groupBy(f"_{k}").agg(F.min("_at").alias(f"_first_{k}"), F.count("*").alias("n")) for k in keys}
        marked = left
        for k in keys:
            marked = joined_by_key(marked, groups[k], f"_{k}", heavy)
        marked = materialize(marked.withColumn("_won", (F.col("_at") == F.col("_first_url_key")) & (F.col("_at") == F.col("_first_hash_key"))), "dedupe-round")
        won = marked.where("_won").select(left.columns)
        accepted = won if accepted is None else accepted.unionByName(won)
        rest = marked.where("NOT _won").select(left.columns)
        for k in keys:
            taken = groups[k].select(f"_{k}", "n").join(won.select(f"_{k}", F.lit(True).alias("_taken")), f"_{k}", "left")
            rest = joined_by_key(rest, taken, f"_{k}", heavy).where("_taken IS NULL").drop("_taken")
        left = materialize(rest, "dedupe-left")
    return (left if accepted is None else accepted).select(new.columns)


def reject_reason(published: Column, url: Column, relevant: Column, as_of: str) -> Column:
    late = published > F.expr(f"TIMESTAMP '{as_of}' + INTERVAL 2 DAYS")
    return F.when(published.isNull(), "undated").when(late, "future").when(F.coalesce(url, F.lit("")) == "", "no_url").when(~relevant, "irrelevant")


def merge_upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column], json: str | None = None) -> DataFrame:
    """One row for each key (null keys match): the best by ``order``, new rows before stored ones on ties.

    The JSON objects in the column ``json`` are merged key by key over all rows of a key, in the same order."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [*order, F.desc("_new")]
    best = both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k", "_new")
    if json is None:
        return best
    merged = folded_json(both, keys, json, order).withColumnsRenamed({k: f"_{k}" for k in keys})
    return best.withColumnRenamed(json, "_old").join(merged, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(*best.columns)


def archive_once(rows: DataFrame, path: str) -> None:
    """Raw payloads, one for each content hash, added to those in ``path`` in folders by hash prefix."""
    spark = rows.sparkSession
    new = rows.groupBy("content_hash").agg(F.min("payload").alias("payload")).withColumn("prefix", F.substring("content_hash", 1, 2))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        new = new.join(spark.read.schema(new.schema).parquet(path).select("content_hash"), "content_hash", "left_anti")
    new.write.partitionBy("prefix").mode("append").parquet(path)
