"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

FORMATS = ("csv", "json", "parquet")

MESSAGE_SCHEMA = ST.StructType(
    [
        ST.StructField("tweet_id", ST.LongType()),
        ST.StructField("author_id", ST.StringType()),
        ST.StructField("inbound", ST.BooleanType()),
        ST.StructField("created_at", ST.StringType()),
        ST.StructField("text", ST.StringType()),
        ST.StructField("response_tweet_id", ST.StringType()),
        ST.StructField("in_response_to_tweet_id", ST.StringType()),
    ]
)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on whatever file system the path names."""
    fs, jvm_path = _file_system(spark, path)
    return fs.exists(jvm_path)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _file_system(spark, path)
    return fs.exists(jvm_path) and fs.getFileStatus(jvm_path).isDirectory()


def _check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}; use one of {FORMATS}")


def load_table(spark: SparkSession, path: str, fmt: str = "csv", schema=None, **options) -> DataFrame:
    """Read csv, json (lines, or ``multiLine=True``) or parquet; missing path or odd format is an error."""
    _check_format(fmt)
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
        if schema is None:
            reader = reader.option("inferSchema", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def save_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write csv (with header), json lines or parquet; parent folders are created."""
    _check_format(fmt)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def read_messages_csv(spark: SparkSession, path: str, schema: ST.StructType = MESSAGE_SCHEMA) -> DataFrame:
    """Quoted multi-line CSV; rows with too many fields are skipped, short rows are null padded.

    A sentinel column after the last field shows which rows were too long.  Such
    files cannot be split between tasks: convert them to parquet once.
    """
    wide = ST.StructType([*schema.fields, ST.StructField("_extra", ST.StringType())])
    raw = spark.read.schema(wide).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)
    return raw.filter(F.col("_extra").isNull()).drop("_extra")


def parse_created_at(col) -> F.Column:
    """``Wed Oct 11 06:55:44 +0000 2017`` as a timestamp."""
    return F.to_timestamp(F.substring(col, 5, 30), "MMM dd HH:mm:ss Z yyyy")


def response_ids(col) -> F.Column:
    """Comma-separated reply ids as an array of numbers."""
    return F.transform(F.split(col, ","), lambda s: s.try_cast("long"))


def scan_pruned(spark: SparkSession, path: str, cols: Sequence[tuple[str, str]], fmt: str = "parquet", **options) -> DataFrame:
    """Read only the named columns with pinned types; pruning reaches the scan."""
    _check_format(fmt)
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(path).select(*[F.col(name).cast(kind).alias(name) for name, kind in cols])


def materialise_once(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """Load a finished result, or build and save it first.  A half-written result does not count."""
    if force or not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_available(spark: SparkSession, preferred: str, parts: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The preferred table when it exists, else the union of those parts that do."""
    if path_exists(spark, preferred):
        return load_table(spark, preferred, fmt)
    frames = [load_table(spark, p, fmt) for p in parts if path_exists(spark, p)]
    if not frames:
        raise FileNotFoundError(f"none of {[preferred, *parts]} found")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def head_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """First ``n`` rows by key."""
    return df.orderBy(key).limit(n)


def save_results(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Export result tables (comparison, confusion matrix, per-class metrics), one folder each, in as many files as they have partitions."""
    for name, table in tables.items():
        save_table(table, f"{folder.rstrip('/')}/{name}", fmt)
