"""Set operations, deduplication and overlap reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.operators import columns as C

def union_sources(sources: Sequence[DataFrame], priority: str = "priority") -> DataFrame:
    """Concatenate sources; ``priority`` records the position of the source."""
    marked = [df.withColumn(priority, F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def dedupe_keep_first(df: DataFrame, subset: Sequence[str], key: str | Sequence[str]) -> DataFrame:
    """One row per ``subset``: the one with the smallest key.

    An aggregate rather than a window: copies are merged before the shuffle, so
    a text that fills a third of the table costs one row per task.  Strings are
    grouped, sorted and shuffled by their SHA-256; a null differs from "".
    """
    keys = [key] if isinstance(key, str) else list(key)
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    by = [(text_digest(c) if kinds[c] in ("string", "varchar", "char") else F.col(c)).alias(f"_by{i}") for i, c in enumerate(subset)]
    order = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    first = df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), order).alias("_first"))
    return first.select("_first.*")


def merge_corpora(tickets: DataFrame, tweets: DataFrame, key: str, **columns) -> DataFrame:
    """Union of labelled tickets and messages, one row per text, tickets first."""
    t = C.filter_ticket_categories(C.standardise_tickets(tickets, keep=[key]))
    m = C.filter_tweet_categories(C.standardise_tweets(tweets, keep=[key], **columns))
    merged = union_sources([t, m])
    return dedupe_keep_first(merged, ["clean_text"], ["priority", key]).select(key, *C.CORPUS_COLUMNS)


def clean_then_dedupe(df: DataFrame, key: str, text_col: str, label_col: str) -> DataFrame:
    """Raw tickets -> cleaned tickets: dedupe raw, clean, drop empty, dedupe cleaned."""
    raw = df.select(
        key,
        T.text_or_empty(F.col(text_col)).alias("_raw"),
        F.col(label_col).cast("string").alias("Issue_Category"),
    )
    once = dedupe_keep_first(raw, ["_raw"], key)
    clean = C.compute_once(once, clean_text=T.clean_ticket_text(F.col("_raw"))).drop("_raw")
    kept = clean.filter(F.col("clean_text") != "")
    return dedupe_keep_first(kept, ["clean_text"], key).withColumn("source", F.lit("ticket"))


def text_digest(col: str) -> Column:
    """A short shuffle key that stands for a whole text; null for null."""
    return F.unhex(F.sha2(F.col(col).cast("binary"), 256))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of rows that repeat an earlier row in full."""
    cols = list(cols or df.columns)
    per_row = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    return per_row.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_texts(df: DataFrame, col: str) -> DataFrame:
    """Repeated texts, distinct texts, and whether every text is unique.

    Texts are grouped by their SHA-256, so digests are shuffled instead of whole texts.
    """
    per_text = df.groupBy(text_digest(col).alias("_digest")).agg(F.count("*").alias("_n"))
    return per_text.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_texts"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicated"),
    ).withColumn("all_unique", F.col("rows") == F.col("distinct_texts"))


def duplicate_rate(df: DataFrame, col: str, limit: float = 10.0) -> DataFrame:
    """Share of repeated texts in percent, flagged above ``limit``."""
    rate = F.col("duplicated") * 100.0 / F.nullif(F.col("rows"), F.lit(0))
    return duplicate_texts(df, col).select(
        "rows",
        "distinct_texts",
        F.round(rate, 6).alias("duplicate_rate"),
        F.coalesce(rate > limit, F.lit(False)).alias("high"),
    )


def _class_pairs(names: Column) -> Column:
    """Every pair of a sorted list of class names, the smaller one first."""
    later = lambda i: F.slice(names, i + 2, F.size(names))
    pairs = F.transform(
        names, lambda a, i: F.transform(later(i), lambda b: F.struct(a.alias("class_a"), b.alias("class_b")))
    )
    return F.flatten(pairs)


def vocab_overlap(
    df: DataFrame,
    label: str,
    text_col: str,
    labels: Sequence | None = None,
    examples: int = 5,
    low: int = 10,
) -> DataFrame:
    """Shared vocabulary of each pair of classes, with the first few shared terms.

    Every term gets the sorted list of the classes that use it, and terms with
    the same list are counted together; the pairs come from the lists, so no
    term joins with itself and no pair of rows is formed.  ``labels`` limits
    the classes; rows without a class are left out.
    """
    if labels is None:
        all_names = df.agg(F.sort_array(F.collect_set(label)).alias("_names"))
        known = F.col(label).isNotNull()
    else:
        names = F.array_sort(F.array_distinct(F.array(*[F.lit(x) for x in labels])))
        all_names = df.sparkSession.range(1).select(names.alias("_names"))
        known = F.col(label).isin(list(labels))
    grid = all_names.select(F.inline(_class_pairs(F.col("_names"))))
    terms = df.filter(known).select(
        F.col(label).alias("_class"), F.explode(F.array_distinct(T.tokenise_terms(F.col(text_col)))).alias("term")
    )
    lists = terms.groupBy("term").agg(F.sort_array(F.collect_set("_class")).alias("_classes"))
    shared = lists.filter(F.size("_classes") >= 2)
    counts = (
        shared.groupBy("_classes")
        .agg(F.count("*").alias("_n"))
        .select("_n", F.inline(_class_pairs(F.col("_classes"))))
        .groupBy("class_a", "class_b")
        .agg(F.sum("_n").alias("overlap"))
    )
    # The first terms per pair are found per list first: a list needs only its own first few.
    per_list = W.partitionBy("_classes").orderBy("term")
    heads = shared.withColumn("_r", F.row_number().over(per_list)).filter(F.col("_r") <= examples)
    per_pair = W.partitionBy("class_a", "class_b").orderBy("term")
    shown = (
        heads.select("term", F.inline(_class_pairs(F.col("_classes"))))
        .withColumn("_r", F.row_number().over(per_pair))
        .filter(F.col("_r") <= examples)
        .groupBy("class_a", "class_b")
        .agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("examples"))
    )
    return (
        grid.join(counts, ["class_a", "class_b"], "left")
        .join(shown, ["class_a", "class_b"], "left")
        .select(
            "class_a",
            "class_b",
            F.coalesce("overlap", F.lit(0)).alias("overlap"),
            F.coalesce("examples", F.lit("")).alias("examples"),
            (F.coalesce("overlap", F.lit(0)) < low).alias("very_little"),
        )
    )


def _by_digest(train: DataFrame, test: DataFrame, text_col: str, how: str) -> DataFrame:
    """The training side is read as digests only and merges its copies before the shuffle."""
    seen = train.select(text_digest(text_col).alias("_seen")).distinct()
    return test.join(seen, text_digest(text_col) == F.col("_seen"), how)


def split_leakage(train: DataFrame, test: DataFrame, text_col: str) -> DataFrame:
    """Test rows whose text also occurs in the training rows; a null text never does."""
    return _by_digest(train, test, text_col, "left_semi")


def unleaked(train: DataFrame, test: DataFrame, text_col: str) -> DataFrame:
    """Test rows whose text does not occur in the training rows."""
    return _by_digest(train, test, text_col, "left_anti")
