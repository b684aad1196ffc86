"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest small side that may be broadcast after its size has been checked.
MAX_BROADCAST_ROWS = 200_000


def ship_by_value(module: str) -> None:
    """Send a module's functions to the Python workers as code, so that workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ticketloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Bytes of input for each core from which a table is left as it is.
SMALL_SHARE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Give costly per-row work to all cores when the input is small.

    A small file is one task however many splits it is cut into: a split
    without the start of a row group is empty.  A large table has row groups
    and splits enough and is left as it is: no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= 4 * cores:
        return df
    files, size = df.inputFiles(), 0
    if not files:
        return df if splits >= cores else df.repartition(cores)
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for file in files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(configuration).getFileStatus(path).getLen()
        if size > cores * SMALL_SHARE:
            return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, or a local one in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    base = os.path.join(tempfile.gettempdir(), "ticketloom-shared")
    spark.sparkContext.setCheckpointDir(base)
    return base


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/ticketloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives executor loss."""
    path = work_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(small: DataFrame, name: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side only after its stored size has been checked; else leave the join to shuffle."""
    stored = materialise(small, name)
    return F.broadcast(stored) if stored.count() <= max_rows else stored
