"""Vector tables on disk and embedding run statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ticketloom.sources.tables import path_exists


# Folders of a vector table by hash of the key; a table keeps the number it was made with.
BUCKETS = 32
# Files of a bucket that one write adds.
FILES = 4
_BUCKET, _LAYOUT = "_bucket", "_layout"


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows with their bucket."""
    return _dealt(df.withColumn(_BUCKET, F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")), key)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """A bucket is a few tasks and files; dealing by range instead would run the encoder twice, once for its sample."""
    return rows.repartition(_BUCKET, F.pmod(F.hash(F.col(key)), F.lit(FILES)))


def write_vectors(df: DataFrame, path: str, key: str, vec: str, keep=(), buckets: int = BUCKETS) -> int:
    """Write keyed vectors as parquet, in folders by hash of the key, and check that every row arrived with one dimension.

    Rows are counted while they are written, so the check costs no second run of
    the encoder.  Returns the number of rows in the table.
    """
    spark, written = df.sparkSession, Observation("written_vectors")
    rows = df.select(key, vec, *keep).observe(written, F.count("*").alias("rows"))
    _bucketed(rows, key, buckets).write.partitionBy(_BUCKET).mode("overwrite").parquet(path)
    stored, size = _measured(spark.read.parquet(path), path, vec)
    if stored != written.get["rows"]:
        raise ValueError(f"vector table {path} has {stored} rows, expected {written.get['rows']}")
    spark.createDataFrame([(buckets, size)], "buckets int, size int").coalesce(1).write.mode("overwrite").json(f"{path}/{_LAYOUT}")
    return stored


def _measured(rows: DataFrame, path: str, vec: str) -> tuple[int, int | None]:
    stored = rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(vec).isNull()).alias("missing"),
        F.min(F.size(vec)).alias("low"),
        F.max(F.size(vec)).alias("high"),
    ).first()
    if stored["missing"] or stored["low"] != stored["high"]:
        raise ValueError(f"vector table {path} is incomplete: {stored.asDict()}")
    return stored["rows"], stored["low"]


def verify_vectors(spark: SparkSession, path: str, vec: str) -> int:
    """Row count of a stored vector table; missing or unequal vectors are an error."""
    return _measured(read_vectors(spark, path), path, vec)[0]


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_BUCKET)


def add_documents(df: DataFrame, path: str, key: str, vec: str, keep=(), batch: str | None = None) -> int:
    """Put documents with their vectors into a searchable corpus; a key that it holds already gets the new row.

    Only the buckets that the new keys fall into are read and overwritten.  Their
    new contents are stored under the name of the `batch` first: a run that
    fails while it replaces them is repeated with the same name and finishes
    with what was stored.  Of repeated keys in `df` the row with the smallest
    vector stays; a null key or a vector of another length is an error, before
    anything is replaced.  Returns the number of rows now in the table.
    """
    spark = df.sparkSession
    layout = spark.read.schema("buckets int, size int").json(f"{path}/{_LAYOUT}").first()
    columns = [key, vec, *keep]
    staged = f"{path}/_batches/{batch or uuid.uuid4().hex}"
    if not path_exists(spark, f"{staged}/merged/_SUCCESS"):
        order = F.struct(vec, *keep)
        new = df.select(*columns).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_row")).select("_row.*")
        _bucketed(new, key, layout["buckets"]).write.mode("overwrite").parquet(f"{staged}/new")
        new = spark.read.schema(df.select(*columns).schema.add(_BUCKET, "integer")).parquet(f"{staged}/new")
        # A bucket number is one of a fixed few.
        touched = [r[_BUCKET] for r in new.select(_BUCKET).distinct().collect()]
        wrong = F.lit(False) if layout["size"] is None else F.size(vec) != layout["size"]
        if new.filter(F.col(key).isNull() | F.col(vec).isNull() | wrong).limit(1).count():
            raise ValueError(f"documents for {path} lack a key or a vector of length {layout['size']}")
        held = spark.read.parquet(path).filter(F.col(_BUCKET).isin(touched)).select(*columns, _BUCKET)
        merged = held.join(new.select(key), key, "left_anti").select(*columns, _BUCKET).unionByName(new)
        merged.write.mode("overwrite").parquet(f"{staged}/merged")
    merged = spark.read.parquet(f"{staged}/merged")
    (
        _dealt(merged, key).write.partitionBy(_BUCKET)
        .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    )
    return spark.read.parquet(path).count()


def run_stats(df: DataFrame, vec: str, model_name: str, seconds: float, batch_size: int = 256) -> DataFrame:
    """One-row throughput and shape record of an embedding job."""
    return df.agg(
        F.count("*").alias("total_documents"), F.max(F.size(vec)).alias("embedding_dimension")
    ).select(
        F.lit(model_name).alias("model_name"),
        "embedding_dimension",
        F.lit(batch_size).alias("batch_size"),
        "total_documents",
        F.lit(seconds / 60.0).alias("time_minutes"),
        (F.col("total_documents") / F.lit(max(seconds, 1e-9))).alias("docs_per_second"),
        F.current_timestamp().alias("timestamp"),
    )
