"""Monitoring, drift and retraining decisions over a prediction log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.operators import evaluate as E
from ticketloom.operators.profile import exact_quantiles


def window_text(window: Column) -> Column:
    """Start of a window as text, the same in every time zone setting."""
    return F.date_format(window.getField("start"), "yyyy-MM-dd HH:mm:ss")


def monitor_summary(log: DataFrame, model_name: str, recent: int = 100) -> DataFrame:
    """Model name, logged predictions and size of the recent window."""
    return log.agg(F.count("*").alias("total_predictions")).select(
        F.lit(model_name).alias("model_name"),
        "total_predictions",
        F.least(F.col("total_predictions"), F.lit(recent)).alias("recent_predictions"),
    )


def shares(df: DataFrame, col: str, out: str) -> DataFrame:
    """Share of every value."""
    counts = df.groupBy(col).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select(col, (F.col("_n") / total).alias(out))


def detect_drift(ref: DataFrame, cur: DataFrame, col: str, threshold: float = K.DRIFT_THRESHOLD) -> DataFrame:
    """Total-variation distance between two class distributions, and whether it is drift.

    A null class is a class.  With fewer than two current records there is no drift.
    """
    now = shares(cur, col, "_q").withColumnRenamed(col, "_class")
    both = shares(ref, col, "_p").join(now, F.col(col).eqNullSafe(F.col("_class")), "full")
    gap = F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))
    enough = cur.agg(F.count("*")).scalar() >= 2
    score = F.coalesce(F.sum(gap) / 2, F.lit(0.0))
    return both.agg(
        F.round(score, 6).alias("drift_score"),
        (score > threshold).alias("_over"),
    ).select("drift_score", (F.col("_over") & enough).alias("drift"))


def _period_scores(log: DataFrame, ts_col: str, truth: str, pred: str, period: str) -> DataFrame:
    counts = log.groupBy(
        F.window(ts_col, period).alias("w"), F.col(truth).alias("truth"), F.col(pred).alias("prediction")
    ).agg(F.count("*").alias("n"))
    return E.per_class_from_counts(counts, by=["w"])


def accuracy_over_time(log: DataFrame, ts_col: str, truth: str, pred: str, period: str = "7 days") -> DataFrame:
    """Accuracy and macro F1 per period."""
    hits = F.sum(F.col("recall") * F.col("support"))
    return (
        _period_scores(log, ts_col, truth, pred, period)
        .groupBy("w")
        .agg(
            F.sum("support").alias("n"),
            F.round(hits / F.sum("support"), 6).alias("accuracy"),
            F.round(F.avg("f1"), 6).alias("macro_f1"),
        )
        .select(window_text(F.col("w")).alias("window_start"), "n", "accuracy", "macro_f1")
    )


def class_scores_over_time(log: DataFrame, ts_col: str, truth: str, pred: str, period: str = "7 days") -> DataFrame:
    """Precision, recall and F1 per class and period."""
    return _period_scores(log, ts_col, truth, pred, period).select(
        window_text(F.col("w")).alias("window_start"),
        "category",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
        "support",
    )


def latency_percentiles(
    log: DataFrame, ts_col: str, latency_col: str, period: str = "7 days", approximate: bool = False
) -> DataFrame:
    """p50, p95 and p99 per period."""
    marks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    windowed = log.select(window_text(F.window(ts_col, period)).alias("window_start"), latency_col)
    if not approximate:
        return exact_quantiles(windowed, "window_start", latency_col, marks)
    return windowed.groupBy("window_start").agg(
        *[F.round(F.percentile_approx(latency_col, F.lit(q)), 6).alias(n) for n, q in marks.items()]
    )


def error_rate_throughput(log: DataFrame, ts_col: str, is_error: Column, period: str = "1 day") -> DataFrame:
    """Requests, errors, error rate and requests per second of each period."""
    window = F.col("w")
    seconds = F.unix_timestamp(window.getField("end")) - F.unix_timestamp(window.getField("start"))
    return (
        log.groupBy(F.window(ts_col, period).alias("w"))
        .agg(F.count("*").alias("requests"), F.count_if(is_error).alias("errors"))
        .select(
            window_text(window).alias("window_start"),
            "requests",
            "errors",
            F.round(F.col("errors") / F.col("requests"), 6).alias("error_rate"),
            F.round(F.col("requests") / seconds, 6).alias("per_second"),
        )
    )


def alert_rules(metrics: DataFrame, rules: Sequence[tuple] = K.ALERT_RULES) -> DataFrame:
    """Fired alerts; ``metrics`` is long: (..., metric, value)."""
    table = metrics.sparkSession.createDataFrame(
        list(rules), "alert string, metric string, comparison string, threshold double, notification string"
    )
    fired = F.when(F.col("comparison") == "<", F.col("value") < F.col("threshold")).otherwise(
        F.col("value") > F.col("threshold")
    )
    # The rule table is a literal of the plan: a handful of rows.
    return metrics.join(F.broadcast(table), "metric").filter(fired)


def should_retrain(
    accuracy: DataFrame,
    drift: DataFrame,
    last_trained: str,
    now: str,
    manual: bool = False,
    min_accuracy: float = K.RETRAIN_MIN_ACCURACY,
    interval_days: int = K.RETRAIN_INTERVAL_DAYS,
) -> DataFrame:
    """The four triggers and whether any of them fired."""
    days = F.datediff(F.lit(now).cast("date"), F.lit(last_trained).cast("date"))
    flags = accuracy.sparkSession.range(1).select(
        F.coalesce(accuracy.select("accuracy").scalar() < min_accuracy, F.lit(False)).alias("low_accuracy"),
        F.coalesce(drift.select("drift").scalar(), F.lit(False)).alias("drift"),
        (days >= interval_days).alias("scheduled"),
        F.lit(manual).alias("manual"),
    )
    return flags.withColumn(
        "retrain", F.col("low_accuracy") | F.col("drift") | F.col("scheduled") | F.col("manual")
    )


def promote_model(current: DataFrame, candidate: DataFrame, truth: str, pred: str) -> DataFrame:
    """Promote the candidate when its accuracy is higher than the current model's."""
    old = E.accuracy(current, truth, pred).select("accuracy").scalar()
    new = E.accuracy(candidate, truth, pred).select("accuracy").scalar()
    return current.sparkSession.range(1).select(
        old.alias("current_accuracy"), new.alias("new_accuracy"), (new > old).alias("promote")
    )
