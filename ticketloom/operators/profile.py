"""Aggregations and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.functions import text as T
from ticketloom.session import materialise


def category_distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows and percentage per value, most frequent first."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 6)).orderBy(F.desc("n"), col)


def text_stats_by_category(df: DataFrame, group: str, text_col: str) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of text length and word count per class."""
    measured = df.select(
        group, T.char_length(F.col(text_col)).alias("_len"), T.word_count(F.col(text_col)).alias("_words")
    )
    stats = []
    for col, name in (("_len", "len"), ("_words", "words")):
        stats += [
            F.bround(F.avg(col), 2).alias(f"{name}_mean"),
            F.bround(F.stddev_samp(col), 2).alias(f"{name}_std"),
            F.min(col).alias(f"{name}_min"),
            F.max(col).alias(f"{name}_max"),
        ]
    return measured.groupBy(group).agg(*stats, F.count("*").alias("count")).orderBy(F.desc("count"), group)


def null_profile(df: DataFrame) -> DataFrame:
    """Type, nulls and rows per column, in one pass."""
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f.name).alias("nulls"),
            F.col("_rows").alias("rows"),
        )
        for f in df.schema.fields
    ]
    return counted.select(F.inline(F.array(*rows)))


def length_histogram(df: DataFrame, value_col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram; the last bin includes its upper end."""
    bounds = df.agg(F.min(value_col).cast("double").alias("lo"), F.max(value_col).cast("double").alias("hi"))
    low, high = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    # A constant column gets a bin range of one around its value.
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low) / bins
    position = F.floor((F.col(value_col) - start) / width)
    binned = df.filter(F.col(value_col).isNotNull()).groupBy(F.least(position, F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n")
    )
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        F.round(start + F.col("id") * width, 6).alias("lower"),
        F.round(start + (F.col("id") + 1) * width, 6).alias("upper"),
    )
    return edges.join(binned, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def exact_quantiles(df: DataFrame, group: str, value_col: str, marks: Mapping[str, float]) -> DataFrame:
    """(group, one column per mark): exact quantiles with linear interpolation, by distributed selection.

    Equal values are counted, the counts lie in ranges of (group, value), and
    running sums over the ranges' totals tell which range holds each wanted
    rank; only those ranges are looked into.  A group of any size is spread
    over as many ranges as it has values for.  Null values count nowhere; a
    group without values has nulls; a null group is a group.
    """
    # A struct with a null field equals itself, a null does not.
    keyed = df.select(F.struct(F.col(group).alias("group")).alias("key"), F.col(value_col).cast("double").alias("value"))
    counts = keyed.groupBy("key", "value").agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange("key", "value").withColumn("range", F.spark_partition_id())
    stored = materialise(ranged, "value-counts")
    known = stored.filter(F.col("value").isNotNull())
    before = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = known.groupBy("key", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = known.groupBy("key").agg(F.sum("n").alias("total"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("mark"), F.lit(float(q)).alias("q")) for name, q in marks.items()]))
    ranks = totals.select("key", "total", wanted.alias("m")).select(
        "key", "m.mark", (F.col("m.q") * (F.col("total") - 1)).alias("place")
    )
    ranks = ranks.select("key", "mark", "place", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank"))
    held = ranks.join(ranges, "key").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    held = held.select("key", "range", "mark", "place", "rank", (F.col("rank") - F.col("first")).alias("inside")).distinct()
    upto = W.partitionBy("key", "range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    looked = known.join(held.select("key", "range").distinct(), ["key", "range"]).withColumn("upto", F.sum("n").over(upto))
    found = held.join(looked, ["key", "range"]).filter(
        (F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n"))
    )
    # One or two ranks per mark: the value at the lower one, and the share of the way to the upper one.
    low, high = F.min("value"), F.max("value")
    value = low + (high - low) * (F.first("place") - F.floor(F.first("place")))
    values = found.groupBy("key", "mark").agg(F.round(value, 6).alias("at"))
    wide = values.groupBy("key").agg(*[F.max(F.when(F.col("mark") == name, F.col("at"))).alias(name) for name in marks])
    return stored.select("key").distinct().join(wide, "key", "left").select(F.col("key.group").alias(group), *marks)


def length_quantiles(df: DataFrame, group: str, value_col: str, approximate: bool = False) -> DataFrame:
    """Box-plot numbers per class: exact with linear interpolation, or approximate."""
    marks = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    if not approximate:
        return exact_quantiles(df, group, value_col, marks)
    return df.groupBy(group).agg(*[F.round(F.percentile_approx(value_col, F.lit(q)), 6).alias(n) for n, q in marks.items()])


def imbalance_ratio(df: DataFrame, group: str, text_col: str) -> DataFrame:
    """Rows, classes, largest / smallest class, mean text length."""
    per_class = df.groupBy(group).agg(
        F.count("*").alias("_n"), F.sum(T.char_length(F.col(text_col))).alias("_chars")
    )
    return per_class.agg(
        F.sum("_n").alias("rows"),
        F.count("*").alias("classes"),
        F.round(F.max("_n") / F.min("_n"), 6).alias("imbalance"),
        F.round(F.sum("_chars") / F.sum("_n"), 6).alias("avg_length"),
    )


def dominant_share(df: DataFrame, col: str, value: str) -> DataFrame:
    """Rows and percentage of one named class."""
    return df.agg(
        F.count_if(F.col(col) == value).alias("n"),
        F.round(F.count_if(F.col(col) == value) * 100.0 / F.nullif(F.count("*"), F.lit(0)), 6).alias("pct"),
    )


def category_presence(df: DataFrame, text_col: str, categories: Sequence[str]) -> DataFrame:
    """Number of texts that contain a category's own lower-cased name."""
    counted = df.agg(
        *[F.count_if(F.contains(F.col(text_col), F.lit(c.lower()))).alias(f"_{i}") for i, c in enumerate(categories)]
    )
    rows = [F.struct(F.lit(c).alias("category"), F.col(f"_{i}").alias("n")) for i, c in enumerate(categories)]
    return counted.select(F.inline(F.array(*rows)))


def class_terms(df: DataFrame, group: str, text_col: str, stopwords: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each term in each class."""
    terms = df.select(group, F.explode(T.tokenise_terms(F.col(text_col), stopwords)).alias("term"))
    return terms.groupBy("term", group).agg(F.count("*").alias("tf"))


def term_profile_by_class(
    df: DataFrame,
    group: str,
    text_col: str,
    top_terms: int = 50,
    per_class: int = 10,
    stopwords: Sequence[str] = K.ENGLISH_STOPWORDS,
) -> DataFrame:
    """Most frequent corpus terms, their mean count per class, best terms of each class."""
    counts = class_terms(df, group, text_col, stopwords)
    vocabulary = (
        counts.groupBy("term").agg(F.sum("tf").alias("_cf")).orderBy(F.desc("_cf"), "term").limit(top_terms)
    )
    sizes = df.groupBy(group).agg(F.count("*").alias("_docs"))
    # Both small sides are bounded: top_terms rows, and one row per class.
    profile = (
        counts.join(F.broadcast(vocabulary.select("term")), "term")
        .join(sizes, group)
        .select(group, "term", F.round(F.col("tf") / F.col("_docs"), 6).alias("mean_count"))
    )
    return _best_terms(profile, group, "mean_count", per_class)


def _best_terms(scored: DataFrame, group: str, value: str, n: int) -> DataFrame:
    order = W.partitionBy(group).orderBy(F.desc(value), "term")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_terms_per_class(
    df: DataFrame, group: str, text_col: str, n: int = 10, stopwords: Sequence[str] = K.ENGLISH_STOPWORDS
) -> DataFrame:
    """Most frequent terms of each class."""
    return _best_terms(class_terms(df, group, text_col, stopwords), group, "tf", n)


def class_vocab_size(df: DataFrame, group: str, text_col: str, approximate: bool = False) -> DataFrame:
    """Distinct terms per class."""
    if approximate:
        terms = df.select(group, F.explode(T.tokenise_terms(F.col(text_col))).alias("term"))
        return terms.groupBy(group).agg(F.approx_count_distinct("term").alias("vocab_size"))
    return class_terms(df, group, text_col).groupBy(group).agg(F.count("*").alias("vocab_size"))


def improvement_vs_baseline(df: DataFrame, name_col: str, value_col: str, baseline: str) -> DataFrame:
    """Absolute and relative improvement of each model over a named baseline."""
    base = df.filter(F.col(name_col) == baseline).agg(F.max(value_col)).scalar()
    gain = F.col(value_col) - base
    return df.select(
        name_col,
        value_col,
        F.round(gain, 6).alias("improvement"),
        F.round(gain * 100.0 / F.nullif(base, F.lit(0.0)), 6).alias("improvement_pct"),
    )


def validate_training_data(
    df: DataFrame, text_col: str, label_col: str, min_rows: int = 1000
) -> DataFrame:
    """Training checks as rows: enough rows, labels match texts, no missing text, not empty."""
    seen = df.agg(
        F.count("*").alias("_rows"),
        F.count(label_col).alias("_labels"),
        F.count(text_col).alias("_texts"),
    )
    checks = [
        ("enough_rows", F.col("_rows") > min_rows, F.col("_rows")),
        ("labels_match", F.col("_labels") == F.col("_rows"), F.col("_labels")),
        ("no_missing_text", F.col("_texts") == F.col("_rows"), F.col("_rows") - F.col("_texts")),
        ("not_empty", F.col("_rows") > 0, F.col("_rows")),
    ]
    rows = [
        F.struct(F.lit(n).alias("check"), ok.alias("passed"), value.cast("long").alias("observed"))
        for n, ok, value in checks
    ]
    return seen.select(F.inline(F.array(*rows)))


def dataset_fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Content hash of a dataset version that does not depend on row order or layout."""
    cols = list(cols or df.columns)
    # Unit separator between fields, a control character for null.
    content = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in cols])
    digest = F.md5(content)
    halves = [F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(38,0)") for at in (1, 9)]
    return df.agg(
        F.count("*").alias("rows"),
        F.sha2(F.concat_ws(":", F.count("*"), *[F.sum(h).cast("string") for h in halves]), 256).alias("fingerprint"),
    )


def data_quality_metrics(
    df: DataFrame, ts_col: str, text_col: str, label_col: str, period: str = "7 days"
) -> DataFrame:
    """Volume, missing values, text length and class balance per period."""
    measured = df.select(
        F.window(ts_col, period).alias("_w"),
        F.col(label_col).alias("_label"),
        F.col(text_col).isNull().alias("_missing"),
        F.length(text_col).alias("_len"),
    )
    # Two levels: per period and class first, so the class balance needs no second pass.
    per_class = measured.groupBy("_w", "_label").agg(
        F.count("*").alias("_n"),
        F.count_if("_missing").alias("_nulls"),
        F.sum("_len").alias("_chars"),
        F.count("_len").alias("_texts"),
        F.min("_len").alias("_shortest"),
        F.max("_len").alias("_longest"),
    )
    return per_class.groupBy("_w").agg(
        F.sum("_n").alias("rows"),
        F.sum("_nulls").alias("missing"),
        F.round(F.sum("_chars") / F.sum("_texts"), 6).alias("len_mean"),
        F.min("_shortest").alias("len_min"),
        F.max("_longest").alias("len_max"),
        F.count("*").alias("classes"),
        F.round(F.max("_n") / F.sum("_n"), 6).alias("largest_share"),
    ).select(F.date_format("_w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "*").drop("_w")
