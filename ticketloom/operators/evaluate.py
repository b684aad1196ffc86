"""Classifier and search evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prediction_truth(predictions: DataFrame, truth: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Predictions with their ground truth, where known."""
    return predictions.join(truth, key, how)


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, prediction, n); every metric below starts from this small table."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("prediction")).agg(F.count("*").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    """Zero when the denominator is zero."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    hits = F.count_if(F.col(truth) == F.col(pred))
    return df.agg(
        F.count("*").alias("n"),
        hits.alias("correct"),
        F.round(hits / F.nullif(F.count("*"), F.lit(0)), 6).alias("accuracy"),
    )


def _class_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: hits, predicted rows and true rows, from (truth, prediction, n)."""
    sides = F.array(
        F.struct(
            F.col("truth").alias("category"),
            F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
            F.lit(0).cast("long").alias("predicted"),
            F.col("n").alias("support"),
        ),
        F.struct(
            F.col("prediction").alias("category"),
            F.lit(0).cast("long").alias("tp"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("long").alias("support"),
        ),
    )
    return (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "category")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    )


def per_class_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class (and ``by``) from (truth, prediction, n)."""
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    return _class_counts(counts, by).select(
        *by, "category", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def per_class_prf(df: DataFrame, truth: str, pred: str, averages: bool = True) -> DataFrame:
    """Per-class report, with macro and weighted average rows."""
    return prf_report(confusion_counts(df, truth, pred), averages)


def prf_report(counts: DataFrame, averages: bool = True) -> DataFrame:
    report = per_class_from_counts(counts)
    scores = ("precision", "recall", "f1")
    if averages:
        macro = report.agg(
            F.lit("macro avg").alias("category"), *[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support")
        )
        weighted = report.agg(
            F.lit("weighted avg").alias("category"),
            *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores],
            F.sum("support").alias("support"),
        )
        report = report.withColumn("category", F.col("category").cast("string")).unionByName(macro).unionByName(weighted)
    return report.select("category", *[F.round(s, 6).alias(s) for s in scores], "support")


def weighted_prf(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one row."""
    report = per_class_from_counts(confusion_counts(df, truth, pred)).withColumn(
        "_hits", F.col("recall") * F.col("support")
    )
    total = F.sum("support")
    return report.agg(
        F.round(F.sum("_hits") / total, 6).alias("accuracy"),
        *[F.round(F.sum(F.col(s) * F.col("support")) / total, 6).alias(s) for s in ("precision", "recall", "f1")],
    )


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return per_class_from_counts(confusion_counts(df, truth, pred)).agg(F.avg("f1").alias("macro_f1"))


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """Confusion counts as a matrix in fixed label order, zeros filled, a row per label."""
    counts = confusion_counts(df, truth, pred)
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction") == name, F.col("n"))), F.lit(0)).alias(str(name)) for name in labels
    ]
    rows = df.sparkSession.createDataFrame([(n,) for n in labels], "truth string")
    matrix = counts.groupBy(F.col("truth").cast("string").alias("truth")).agg(*cells)
    return rows.join(matrix, "truth", "left").na.fill(0)


def misclassified(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows whose prediction is wrong."""
    return df.filter(F.col(truth) != F.col(pred))


def misclassified_rate(df: DataFrame, truth: str, pred: str) -> DataFrame:
    wrong = F.count_if(F.col(truth) != F.col(pred))
    return df.agg(
        F.count("*").alias("n"),
        wrong.alias("wrong"),
        F.round(wrong * 100.0 / F.nullif(F.count("*"), F.lit(0)), 6).alias("wrong_pct"),
    )


def confusion_pairs(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Wrong (truth, prediction) pairs with counts."""
    return confusion_counts(misclassified(df, truth, pred), truth, pred)


def most_confused_with(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per true class: wrong rows and the most frequent wrong label, first label on ties."""
    wrong = confusion_pairs(df, truth, pred)
    order = F.struct((-F.col("n")).alias("n"), F.col("prediction").alias("p"))
    return wrong.groupBy("truth").agg(
        F.sum("n").alias("misclassified"), F.min_by("prediction", order).alias("most_confused")
    )


def best_model(results: DataFrame, name_col: str, value_col: str) -> DataFrame:
    """Row with the highest value; ties go to the first name."""
    return results.orderBy(F.desc(value_col), name_col).limit(1)


def model_report(
    results: DataFrame, name_col: str, value_col: str, baseline: str, suspicious: float = 0.95
) -> DataFrame:
    """Status per model: the baseline, suspiciously high, below the baseline, or good."""
    base = results.filter(F.col(name_col) == baseline).agg(F.max(value_col)).scalar()
    status = (
        F.when(F.col(name_col) == baseline, F.lit("Good baseline"))
        .when(F.col(value_col) > suspicious, F.lit("Suspicious"))
        .when(F.col(value_col) < base, F.lit("Too low"))
        .otherwise(F.lit("Good"))
    )
    return results.select(name_col, value_col, status.alias("status"))


def rank_of_expected(
    results: DataFrame, queries: DataFrame, k: int = 5, query: str = "qid", category: str = "category"
) -> DataFrame:
    """Per query: rank of the first result of the expected class within the top k, and the top 3 classes.

    ``results`` has (query, rank, category), ``queries`` has (query, expected).
    """
    top = results.filter(F.col("rank") <= k)
    ranked = F.array_sort(F.collect_list(F.struct("rank", category)))
    # At most k rows per query.
    lists = top.groupBy(query).agg(ranked.alias("_top"))
    joined = queries.join(lists, query, "left")
    classes = F.coalesce(F.transform("_top", lambda s: s[category].cast("string")), F.array().cast("array<string>"))
    position = F.array_position(classes, F.col("expected").cast("string"))
    return joined.select(
        query,
        "expected",
        (position > 0).alias("hit"),
        F.when(position > 0, position).alias("rank"),
        F.array_join(F.slice(classes, 1, 3), ",").alias("top_categories"),
        F.coalesce(F.try_element_at(classes, F.lit(1)), F.lit("Unknown")).alias("top_category"),
    )


def search_hit_rate(hits: DataFrame) -> DataFrame:
    """Overall hit rate of a ``rank_of_expected`` table."""
    return hits.agg(
        F.count("*").alias("queries"),
        F.count_if("hit").alias("hits"),
        F.round(F.count_if("hit") / F.nullif(F.count("*"), F.lit(0)), 6).alias("hit_rate"),
    )


def search_confusion(hits: DataFrame) -> DataFrame:
    """Expected class against the class of the first result."""
    return hits.groupBy("expected", F.col("top_category").alias("actual")).agg(F.count("*").alias("n"))


def search_accuracy_by_category(hits: DataFrame) -> DataFrame:
    """Hits, queries and hit rate per expected class."""
    return hits.groupBy("expected").agg(
        F.count_if("hit").alias("hits"),
        F.count("*").alias("queries"),
        F.round(F.count_if("hit") / F.count("*"), 6).alias("accuracy"),
    )


def search_miss_analysis(
    results: DataFrame, hits: DataFrame, k: int = 20, query: str = "qid", category: str = "category"
) -> DataFrame:
    """For missed queries: class distribution of the top k results."""
    missed = hits.filter(~F.col("hit")).select(query, "expected")
    return (
        results.filter(F.col("rank") <= k)
        .join(missed, query)
        .groupBy(query, "expected", category)
        .agg(F.count("*").alias("n"))
        .withColumn("pct", F.round(F.col("n") * 100.0 / k, 6))
    )


def first_n(df: DataFrame, group: str, key: str, n: int = 1) -> DataFrame:
    """First ``n`` rows per group by key."""
    order = W.partitionBy(group).orderBy(key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def argmax_label(df: DataFrame, group: str, value: str, label: str) -> DataFrame:
    """Label with the largest value per group; ties go to the first label."""
    order = F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))
    return df.groupBy(group).agg(F.min_by(label, order).alias(label), F.max(value).alias(value))


def recent_n(df: DataFrame, ts_col: str, key: str, n: int = 100) -> DataFrame:
    """Latest ``n`` records."""
    return df.orderBy(F.desc(ts_col), F.desc(key)).limit(n)


def recent_n_per_model(df: DataFrame, model_col: str, ts_col: str, key: str, n: int = 100) -> DataFrame:
    """Latest ``n`` records of each model."""
    order = W.partitionBy(model_col).orderBy(F.desc(ts_col), F.desc(key))
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def pseudo_label_precision(labelled: DataFrame, truth: DataFrame, key: str, label: str, truth_label: str) -> DataFrame:
    """Share of correct labels per assigned label, over rows whose truth is known."""
    known = labelled.select(key, F.col(label).alias("label")).join(
        truth.select(key, F.col(truth_label).alias("truth")), key
    )
    right = F.count_if(F.col("label") == F.col("truth"))
    return known.groupBy("label").agg(
        F.count("*").alias("n"), right.alias("correct"), F.round(right / F.count("*"), 6).alias("precision")
    )
