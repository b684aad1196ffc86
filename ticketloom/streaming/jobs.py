"""Streaming forms of labelling, deduplication and monitoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketloom.functions import constants as K
from ticketloom.functions import text as T
from ticketloom.functions.rules import STARTER_RULES, RuleBase
from ticketloom.operators import columns as C
from ticketloom.operators import monitor as M
from ticketloom.operators.label import categorize


def stream_messages(
    spark: SparkSession, path: str, schema, max_files: int | None = 100, fmt: str = "parquet", **options
) -> DataFrame:
    """File source read in bounded micro-batches, or with `max_files=None` all files at hand in one.

    Files come in the order of modification, which need not be that of event
    time: with a watermark a backfill is read in one batch, in which no row is late.
    """
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).load(path)


def append_sink(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to parquet.  The checkpoint makes a re-run add only what is new."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark dropped in the run's batches, aggregates counted as one row per task and group."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


def run_available(stream: DataFrame, path: str, checkpoint: str, backfill: bool = False) -> DataFrame:
    """Process everything available, then read the sink; a backfill that loses late rows is an error."""
    run = append_sink(stream, path, checkpoint)
    run.awaitTermination()
    if backfill and (late := late_rows(run)):
        raise ValueError(f"{late} late rows were dropped: read the backfill in one batch")
    # An explicit schema: a run without output rows still reads as an empty table.
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def stream_label(
    stream: DataFrame,
    key: str,
    text_col: str = "text",
    inbound_col: str = "inbound",
    min_length: int = K.MIN_MESSAGE_LENGTH,
    min_confidence: float = K.MIN_RULE_CONFIDENCE,
    rules: RuleBase = STARTER_RULES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Clean and label messages; stateless, so it equals the batch result row by row."""
    inbound = C.filter_inbound(stream, inbound_col)
    narrow = inbound.select(key, *keep, text_col)
    clean = C.compute_once(narrow, clean_text=T.clean_tweet_text(F.col(text_col))).drop(text_col)
    labelled = categorize(C.filter_min_length(clean, "clean_text", min_length), "clean_text", rules)
    return C.filter_confidence(labelled, min_confidence).withColumn("source", F.lit("twitter"))


def stream_dedupe(stream: DataFrame, col: str, ts_col: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a text that arrive within the watermark; which copy stays is not defined."""
    # Event time must be a zoned timestamp for a watermark; state holds a digest, not the text.
    timed = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withColumn("_digest", F.sha2(F.col(col), 256))
    return timed.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def stream_truth(
    predictions: DataFrame, truth: DataFrame, key: str, ts_col: str, truth_ts: str, wait: str, delay: str = "1 hour"
) -> DataFrame:
    """Predictions with the truth that arrives up to `wait` after them.

    A pair is emitted when both are there; a prediction without truth once the
    watermarks of both streams have passed the time that it waits.  Neither
    side is kept in state for longer.  For stored tables this is the left join.
    """
    p = predictions.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    t = truth.withColumn(truth_ts, F.col(truth_ts).cast("timestamp")).withWatermark(truth_ts, delay)
    t = t.withColumnRenamed(key, "_key")
    in_time = F.col(truth_ts).between(F.col(ts_col), F.col(ts_col) + F.expr(f"INTERVAL {wait}"))
    return p.join(t, (F.col(key) == F.col("_key")) & in_time, "left").drop("_key")


def stream_monitor(
    stream: DataFrame,
    ts_col: str,
    truth: str,
    pred: str,
    confidence: str,
    period: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """Volume, accuracy and mean confidence per closed event-time window; later rows are dropped."""
    timed = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    return (
        timed.groupBy(F.window(ts_col, period).alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.count_if(F.col(truth) == F.col(pred)) / F.count("*"), 6).alias("accuracy"),
            F.round(F.avg(confidence), 6).alias("mean_confidence"),
        )
        .select(M.window_text(F.col("w")).alias("window_start"), "n", "accuracy", "mean_confidence")
    )


def stream_class_counts(stream: DataFrame, ts_col: str, col: str, period: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Rows per class and closed window: the input of windowed drift."""
    timed = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    return (
        timed.groupBy(F.window(ts_col, period).alias("w"), F.col(col).alias("category"))
        .agg(F.count("*").alias("n"))
        .select(M.window_text(F.col("w")).alias("window_start"), "category", "n")
    )


def window_drift(counts: DataFrame, reference: DataFrame, threshold: float = K.DRIFT_THRESHOLD) -> DataFrame:
    """Drift of every window's class shares against static reference shares (category, share)."""
    totals = counts.groupBy("window_start").agg(F.sum("n").alias("_total"))
    # One row per window and known class, so classes missing from a window count too.
    ref = F.array_agg(F.struct("category", "share"))
    known = reference.agg(ref).scalar()
    expected = totals.select("window_start", "_total", F.inline(known)).withColumnRenamed("share", "_p")
    both = expected.join(counts, ["window_start", "category"], "left").select(
        "window_start", "_p", (F.coalesce("n", F.lit(0)) / F.col("_total")).alias("_q"), "n"
    )
    gaps = both.groupBy("window_start").agg(
        F.sum(F.abs(F.col("_p") - F.col("_q"))).alias("_gap"), F.sum("_q").alias("_known")
    )
    # Rows of classes the reference does not know count in full.
    score = (F.col("_gap") + (1 - F.col("_known"))) / 2
    return gaps.select("window_start", F.round(score, 6).alias("drift_score"), (score > threshold).alias("drift"))


def foreach_batch_drift(
    reference: DataFrame, category: str, handle: Callable[[DataFrame, int], None], threshold: float = K.DRIFT_THRESHOLD
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: drift of each micro-batch against a static reference."""

    def on_batch(batch: DataFrame, epoch: int) -> None:
        handle(M.detect_drift(reference, batch, category, threshold), epoch)

    return on_batch

