"""Structured Streaming jobs. Each takes a streaming DataFrame; ``run_available`` drives one over what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from murmura.operators import ingest
from murmura.scratch import materialize, scratch_path


class KeyedTable:
    """A table in the shared folder whose rows live in buckets by a hash of ``keys``.

    Each batch writes the buckets it touches anew under its own number and no others: ``batch=N/bucket=K``. A bucket's newest
    finished version counts, so a batch that failed or runs again changes nothing, and a restart finds the table by its
    folder. Versions that two later ones have replaced are deleted."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self, before: int | None = None) -> dict[int, list[int]]:
        """Numbers of the finished batches that wrote each bucket, newest first; ``before`` leaves out that batch and later ones."""
        out: dict[int, list[int]] = {}
        for done in self._fs.globStatus(self._path(f"{self.path}/batch=*/_SUCCESS")) or []:
            folder = done.getPath().getParent()
            number = int(folder.getName().split("=")[1])
            if before is None or number < before:
                for part in self._fs.globStatus(self._path(folder, "bucket=*")) or []:
                    out.setdefault(int(part.getPath().getName().split("=")[1]), []).append(number)
        return {k: sorted(v, reverse=True) for k, v in out.items()}

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of ``buckets`` (all, if None) as of batch ``before``."""
        found = {k: v[0] for k, v in self.versions(before).items() if buckets is None or k in buckets}
        paths = [f"{self.path}/batch={n}/bucket={k}" for k, n in sorted(found.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, number: int) -> None:
        """``rows``, all rows of the buckets they lie in, as the version of batch ``number``."""
        rows = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        rows.repartition("bucket", F.pmod(F.xxhash64(*(c for c in self.schema.names)), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        for k, numbers in self.versions().items():
            for old in numbers[2:]:
                self._fs.delete(self._path(f"{self.path}/batch={old}/bucket={k}"), True)

    def merge(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Merge a batch into the buckets that its keys lie in; the other buckets are not read."""
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())  # at most one a bucket
        if touched:
            self.write(merge(self.read(touched, number), batch), number)


def run_available(
    frame: DataFrame, *, mode: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, start: DataFrame | None = None, keys: list[str] | None = None,
    schema: StructType | None = None, buckets: int = 64, home: str | None = None,
) -> DataFrame:
    """Run a stream over all input there is and return its result.

    ``append`` results gather as Parquet. With ``merge`` each batch goes into a `KeyedTable` by ``keys`` (of ``schema``, else the
    batch's): merge(held, batch) gives the rows of the buckets touched; ``start`` is the table before the first batch. Without it,
    ``complete`` and ``update`` results replace the table of the batch before. ``home`` is the job's folder: a job that is started
    again there goes on where it ended."""
    spark = frame.sparkSession
    home = home or scratch_path(spark, "stream")
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
    if merge is not None:
        table = KeyedTable(spark, f"{home}/table", schema or (start.schema if start is not None else frame.schema), keys, buckets)
        if start is not None and not table.versions():
            table.write(start, -1)
        writer.foreachBatch(lambda batch, number: table.merge(batch, number, merge)).start().awaitTermination()
        return table.read()
    if mode == "append":
        writer.format("parquet").option("path", f"{home}/out").start().awaitTermination()
        return spark.read.schema(frame.schema).parquet(f"{home}/out")
    last: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{home}/table-{number}"
        batch.write.mode("overwrite").parquet(path)
        last.append(path)

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(last[-1]) if last else spark.createDataFrame([], frame.schema)


def read_events(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table of Parquet files as a stream; the time column becomes a timestamp with zone."""
    path = f"{sf_dir}/{table}.parquet"
    held = spark.read.parquet(path)
    stream = spark.readStream.schema(held.schema)
    if all(f.rstrip("/").endswith(f"/{table}.parquet") for f in held.inputFiles()):  # one file: streams read folders
        stream, path = stream.option("pathGlobFilter", f"{table}.parquet"), sf_dir
    return stream.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def ingest_dedupe(items: DataFrame, home: str | None = None, buckets: int = 64) -> DataFrame:
    """Rows of a stream of items (id, url_key, hash_key, collected_at) that arrival in order stores: no stored row has their url or
    their hash, and a suppressed row suppresses nothing.

    State are the keys of stored rows, in two tables by url and by hash, of which a batch reads the buckets it touches. A batch
    goes through the rounds of the batch operator against them, so the result is the one that a single pass over all arrivals
    gives, as long as batches come in order of collected_at."""
    spark = items.sparkSession
    home = home or scratch_path(spark, "stream-dedupe")
    held = {k: KeyedTable(spark, f"{home}/{k}", StructType([items.schema[k]]), [k], buckets) for k in ("url_key", "hash_key")}

    def store(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        stored, touched = {}, {}
        for k, table in held.items():
            touched[k] = sorted(r[0] for r in batch.select(table.bucket()).distinct().collect())  # at most one a bucket
            stored[k] = table.read(touched[k], number)
        fresh = materialize(ingest.ingest_dedupe(batch, stored_keys=stored), "stream-stored")
        for k, table in held.items():
            mine = table.read(sorted(r[0] for r in fresh.select(table.bucket()).distinct().collect()), number)
            table.write(mine.unionByName(fresh.select(k)).distinct(), number)
        fresh.write.mode("overwrite").parquet(f"{home}/stored/batch={number}")

    writer = items.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(store).start().awaitTermination()
    found = held["url_key"]._fs.globStatus(held["url_key"]._path(f"{home}/stored/batch=*")) or []
    paths = [str(f.getPath()) for f in found]
    return spark.read.schema(items.schema).parquet(*paths) if paths else spark.createDataFrame([], items.schema)


def tumbling_metrics(events: DataFrame, width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return windows.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sliding_mean(events: DataFrame, width: str = "7 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "event_type")
    return windows.agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "mean", "n")


def sessions(events: DataFrame, gap: str = "2 days", delay: str = "3 days") -> DataFrame:
    """Chains of events of one key with gaps below ``gap``."""
    windows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id")
    return windows.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def covered(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Late coverage: rows whose event time lies in the window, whenever they arrive."""
    return events.where(F.col("ts") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS"))


HEALTH = "user_id long, failures long, broken boolean, at timestamp"


def source_health(events: DataFrame, *, failed: str = "event_type = 'error'", trip: int = 5) -> DataFrame:
    """Consecutive failures of each source after each batch: reset by a success, broken at ``trip``.

    State is one counter a source; a source silent for 30 days of event time is forgotten."""

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        count = state.get[0] if state.exists else 0
        ok = (~rows["failed"].to_numpy()).nonzero()[0]
        count = len(rows) - 1 - int(ok[-1]) if len(ok) else count + len(rows)
        state.update((count,))
        last = rows["ts"].iloc[-1]
        state.setTimeoutTimestamp(int(last.timestamp() * 1000) + 30 * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "failures": [count], "broken": [count >= trip], "at": [last]})

    rows = events.withWatermark("ts", "1 day").select("user_id", "event_id", "ts", F.expr(failed).alias("failed"))
    return rows.groupBy("user_id").applyInPandasWithState(update, HEALTH, "failures long", "update", GroupStateTimeout.EventTimeTimeout)


def newest_per_key(held: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge of a batch into the table held: the latest row of each key stays."""
    return held.unionByName(batch).groupBy("user_id").agg(F.max_by(F.struct("failures", "broken", "at"), "at").alias("s")).select("user_id", "s.*")


def after_cursor(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events newer than the stored cursor of their key (static table user_id, cursor)."""
    return events.join(cursors, "user_id", "left").where(F.col("cursor").isNull() | (F.col("ts") > F.col("cursor"))).drop("cursor")
