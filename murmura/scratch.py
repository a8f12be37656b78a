"""Tables written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a fresh temp folder is set only where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-murmura-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under this application's own folder, which can go when the application has ended."""
    return f"{shared_dir(spark)}/murmura/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and a lost executor
    costs a re-read, never a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that broadcasts neither side, as one side may grow with the rows.

    Spark takes a table's files for its size. Zstandard and dictionaries leave a tenth or less of the rows, so tables written
    between jobs, and what is made of them, seem small enough to broadcast when the driver can't hold them."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` returned; nothing may read it any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written between jobs; results that read them must be written first."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/murmura/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
