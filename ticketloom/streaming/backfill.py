"""Backfills: a stored table handed on in batches of whole event-time ranges, the earliest first.

A file stream reads files in the order of modification, so a watermark drops
rows of a backfill whose files are not in event-time order.  Here the table is
laid out by time once; every batch holds whole ranges, so no row is late, no
state lasts from one batch to the next, and a range that is too large for one
task is many files.  A run that was interrupted goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ticketloom.operators.corpus import text_digest
from ticketloom.sources.tables import path_exists

SLICE = "_slice"
# Rows that a batch may hold before it ends; a range is never cut.
MAX_BATCH_ROWS = 100_000_000


def _finished(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


class Backfill:
    """`df` laid out by event time under `path`, a folder per range of `width` seconds counted from the epoch.

    One shuffle by range: rows of equal time are told apart by their contents,
    so a crowded moment is split as well.  Rows without a time are left out.  A
    layout that stands under `path` already is used as it is.
    """

    def __init__(self, df: DataFrame, ts_col: str, width: int, path: str):
        self.spark, self.ts_col, self.width, self.path = df.sparkSession, ts_col, width, path
        self.columns, self.schema = df.columns, df.schema
        if not _finished(self.spark, path):
            start = F.window(F.col(ts_col).cast("timestamp"), f"{width} seconds").start
            sliced = df.filter(F.col(ts_col).isNotNull()).withColumn(SLICE, F.unix_seconds(start))
            # Time alone would leave all rows of one instant in one task.
            by = sliced.repartitionByRange(SLICE, ts_col, F.xxhash64(*df.columns))
            by.write.partitionBy(SLICE).mode("overwrite").parquet(path)
        # One row per range of time, however many rows there are.
        latest = F.max(F.unix_micros(F.col(ts_col).cast("timestamp"))).alias("latest")
        ranges = self.rows().groupBy(SLICE).agg(F.count("*").alias("n"), latest).orderBy(SLICE).collect()
        self.counts = {r[SLICE]: r["n"] for r in ranges}
        self.latest = max((r["latest"] for r in ranges), default=None)

    def rows(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(SLICE, LongType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def closed(self, delay: int) -> list[int]:
        """Ranges that end at least `delay` seconds before the latest row; later ones belong to the live stream."""
        return [s for s in self.counts if (s + self.width + delay) * 1_000_000 <= self.latest]

    def batches(self, slices: list[int], max_rows: int) -> Iterator[list[int]]:
        """Neighbouring ranges of at most so many rows together; a larger range is a batch of its own."""
        batch, n = [], 0
        for s in slices:
            if batch and n + self.counts[s] > max_rows:
                yield batch
                batch, n = [], 0
            batch.append(s)
            n += self.counts[s]
        if batch:
            yield batch

    def replay(
        self,
        out: str,
        handle: Callable[[DataFrame, DataFrame | None], DataFrame],
        delay: int | None = None,
        max_rows: int = MAX_BATCH_ROWS,
    ) -> DataFrame:
        """Write ``handle(batch, earlier)`` of every batch to its own folder under `out`, in order; the folders together.

        `earlier` reads the results of all batches before (None for the first),
        so that a handler can refer to them.  A batch that was written is not
        repeated; one that was interrupted is written anew.  With `delay` only
        closed ranges are replayed.
        """
        slices = list(self.counts) if delay is None else self.closed(delay)
        schema = handle(self.rows().filter(F.lit(False)).select(*self.columns), None).schema
        folders: list[str] = []
        for batch in self.batches(slices, max_rows):
            folder = f"{out}/from-{batch[0]}"
            if not _finished(self.spark, folder):
                held = self.rows().filter(F.col(SLICE).between(batch[0], batch[-1])).select(*self.columns)
                earlier = self.spark.read.schema(schema).parquet(*folders) if folders else None
                handle(held, earlier).write.mode("overwrite").parquet(folder)
            folders.append(folder)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)


def first_copies(col: str, ts_col: str, key: str) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    """Handler that keeps the first row of each text by time, then key, over all batches.

    Texts are compared by their SHA-256: digests and keys are ranked and
    shuffled, and only digests of earlier batches are read.
    """

    def handle(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        rows = batch.withColumn("digest", text_digest(col))
        order = F.struct(ts_col, key)
        first = rows.groupBy("digest").agg(F.min_by(F.struct(*batch.columns), order).alias("_first"))
        if earlier is not None:
            # A null text is a text like any other.
            seen = earlier.select(F.col("digest").alias("_seen"))
            first = first.join(seen, F.col("digest").eqNullSafe(F.col("_seen")), "left_anti")
        return first.select("digest", "_first.*")

    return handle
