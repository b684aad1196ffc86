"""Append-only logs: predictions, metrics and saved models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.sources.tables import path_exists


def prediction_records(
    df: DataFrame,
    input_col: str,
    prediction_col: str,
    confidence_col: str,
    truth_col: str | None = None,
    ts: Column | None = None,
) -> DataFrame:
    """Rows as log records (timestamp, input, prediction, confidence, ground_truth)."""
    truth = F.col(truth_col).cast("string") if truth_col else F.lit(None).cast("string")
    return df.select(
        (ts if ts is not None else F.current_timestamp()).alias("timestamp"),
        F.col(input_col).cast("string").alias("input"),
        F.col(prediction_col).cast("string").alias("prediction"),
        F.col(confidence_col).cast("double").alias("confidence"),
        truth.alias("ground_truth"),
    )


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metric_records(spark: SparkSession, run: str, metrics: Mapping[str, float], step: int = 0) -> DataFrame:
    """One run's metrics in long form (timestamp, run, step, key, value)."""
    rows = [(run, step, k, float(v)) for k, v in metrics.items()]
    return spark.createDataFrame(rows, "run string, step int, key string, value double").select(
        F.current_timestamp().alias("timestamp"), "*"
    )


def save_model(model: PipelineModel, path: str, config: Mapping[str, str]) -> None:
    """Save a fitted model with a small configuration table (type, parameters, accuracy, classes)."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    rows = [(k, str(v)) for k, v in config.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, str]]:
    if not path_exists(spark, f"{path}/model"):
        raise FileNotFoundError(path)
    config = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/config").collect()}
    return PipelineModel.load(f"{path}/model"), config
