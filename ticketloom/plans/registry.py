"""Registered queries: a Spark callable per name and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketloom.session import spread
from ticketloom.sources.tables import is_folder
from ticketloom.streaming.jobs import stream_messages

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to process; small single-split files are spread over the cores."""
    return spread(table(spark, sf_dir, name))


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = 100) -> DataFrame:
    """A table as a file stream (`max_files=None`: in one batch), whether it is stored as one file or as a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = table(spark, sf_dir, name).schema
    if is_folder(spark, path):
        return stream_messages(spark, path, schema, max_files)
    return stream_messages(spark, sf_dir, schema, max_files, pathGlobFilter=f"{name}.parquet")
