"""Shared-folder staging for results that several later steps read.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only a
local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="quorumcast-")
    return _local_dirs[app]


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` once as parquet and return a reader of it.  ``options`` go to the writer.

    Cuts the lineage, survives the loss of executors, and gives every later
    reader column pruning and size statistics.  It stays until ``clear_staged``.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    writer = df.write.mode("errorifexists").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Staged results that only lead to another result, in one folder that goes when that is there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, staging_path(spark, name)

    def stage(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.mode("errorifexists").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.folder)


def clear_staged(spark: SparkSession) -> None:
    """Delete all this application has staged; for the end of a run, when its results are written."""
    remove(spark, f"{staging_root(spark)}/{spark.sparkContext.applicationId}")


def join_by_measured_size(spark: SparkSession) -> None:
    """Broadcast a side of a join by its size as measured, not by the size of the files it comes from.

    The plan's estimate is the compressed size of the files, also behind an ``explode``, so a table that
    unpacks to many times that would be sent through the driver.  What was the limit holds at run time.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, spark.conf.get(planned))
    spark.conf.set(planned, "-1")


def join_where_rows_are(spark: SparkSession) -> None:
    """Rows that lie together by some of a join's keys are not shuffled again by all of them; the other side comes to them."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def lists_in_hash_tables(spark: SparkSession, groups: int = 1 << 14) -> None:
    """Lists and percentiles of a task are gathered in a hash table; Spark sorts the rows from 128 groups on if nothing is set."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    if spark.conf.get(name, None) in (None, "128"):
        spark.conf.set(name, str(groups))


#: Bytes of input for a shuffle partition; forecasts unpack to about 75 times their events.
INPUT_PER_PARTITION = 1 << 18


def partitions_by_input(spark: SparkSession, path: str) -> None:
    """Let shuffles begin with as many partitions as the input asks for; adaptive execution merges small ones.

    With a fixed number a task's share, and what it sorts in memory, would grow with the input.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if size // INPUT_PER_PARTITION > now:
        spark.conf.set(name, str(size // INPUT_PER_PARTITION))


def shuffle_partitions(spark: SparkSession) -> int:
    """What ``repartition`` by columns begins with, for rows that are to lie as it would lay them."""
    adaptive = all(spark.conf.get(f"spark.sql.adaptive.{x}", "true") == "true" for x in ("enabled", "coalescePartitions.enabled"))
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) if adaptive else None
    return int(first or spark.conf.get("spark.sql.shuffle.partitions"))


def as_is(df: DataFrame, name: str) -> DataFrame:
    """For callers that keep nothing: the plan itself."""
    return df
