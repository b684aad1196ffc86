"""Projections and filters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.functions import text as T
from ticketloom.session import materialise

CORPUS_COLUMNS = ("clean_text", "category", "source", "confidence")


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters must not repeat.

    A filter on a computed column is pushed below the projection by repeating
    the whole expression, and even below an aggregate.  A generator of one row
    keeps the expression, and the filter, in their places.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def standardise(df: DataFrame, mapping: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Project to named columns, optionally keeping key columns."""
    return df.select(*keep, *[c.alias(name) for name, c in mapping.items()])


def standardise_tickets(
    df: DataFrame, text_col: str = "clean_text", label_col: str = "Issue_Category", keep: Sequence[str] = ()
) -> DataFrame:
    """Tickets as (clean_text, category, 'ticket', 1.0)."""
    return standardise(
        df,
        {
            "clean_text": F.col(text_col).cast("string"),
            "category": F.col(label_col).cast("string"),
            "source": F.lit("ticket"),
            "confidence": F.lit(1.0),
        },
        keep,
    )


def standardise_tweets(
    df: DataFrame,
    text_col: str = "clean_text",
    label_col: str | Column = "category",
    confidence_col: str = "confidence",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Messages as (clean_text, category, 'twitter', confidence); 0.7 when no confidence column."""
    label = label_col if isinstance(label_col, Column) else F.col(label_col)
    confidence = (
        F.col(confidence_col).cast("double")
        if confidence_col in df.columns
        else F.lit(K.DEFAULT_TWEET_CONFIDENCE)
    )
    return standardise(
        df,
        {
            "clean_text": F.col(text_col).cast("string"),
            "category": label.cast("string"),
            "source": F.lit("twitter"),
            "confidence": confidence,
        },
        keep,
    )


def pick_first_column(df: DataFrame, names: Sequence[str], out: str, default: str | None = None) -> DataFrame:
    """Copy the first of the named columns that exists; nulls become ``default`` when given."""
    present = [n for n in names if n in df.columns]
    if not present and default is None:
        raise ValueError(f"none of the columns {list(names)} found")
    if not present:
        return df.withColumn(out, F.lit(default))
    col = F.col(present[0]).cast("string")
    return df.withColumn(out, col if default is None else F.coalesce(col, F.lit(default)))


def pick_text_column(df: DataFrame, out: str = "full_text") -> DataFrame:
    return pick_first_column(df, ("Ticket_Description", "clean_text", "text"), out)


def pick_category_column(df: DataFrame, out: str = "category") -> DataFrame:
    return pick_first_column(df, ("category", "Issue_Category"), out, default=K.UNKNOWN_CATEGORY)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop personal or irrelevant columns; absent names are ignored."""
    return df.drop(*cols)


def concat_text(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Join text columns with one blank; nulls count as empty."""
    return df.withColumn(out, F.concat_ws(" ", *[T.text_or_empty(F.col(c)) for c in cols]))


def filter_inbound(df: DataFrame, col: str = "inbound") -> DataFrame:
    """Keep customer messages; keep everything when there is no such column."""
    return df.filter(F.col(col)) if col in df.columns else df


def filter_categories(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    return df.filter(F.col(col).isin(*allowed))


def filter_ticket_categories(df: DataFrame, col: str = "category") -> DataFrame:
    return filter_categories(df, col, K.TICKET_CATEGORIES)


def filter_tweet_categories(df: DataFrame, col: str = "category") -> DataFrame:
    return filter_categories(df, col, K.TWEET_CATEGORIES)


def filter_min_length(df: DataFrame, col: str, n: int = K.MIN_MESSAGE_LENGTH) -> DataFrame:
    return df.filter(F.length(col) >= n)


def filter_nonempty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Trim the columns and drop rows where any of them is null or blank."""
    for c in cols:
        df = df.withColumn(c, T.strip(F.col(c)))
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) != "" for c in cols]))


def filter_confidence(df: DataFrame, threshold: float, col: str = "confidence") -> DataFrame:
    return df.filter(F.col(col) >= threshold)


def drop_other(df: DataFrame, col: str = "label", other: str = K.SIMPLE_LADDER_DEFAULT) -> DataFrame:
    """Drop rows the ladder could not label."""
    return df.filter(F.col(col) != other)


def fill_missing_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill("", subset=list(cols))


def assign_index(df: DataFrame, key: str, out: str = "embedding_index") -> DataFrame:
    """Dense 0-based index in the order of a unique key; a row without a key gets none.

    Rows are sorted by ranges of the key and stored with their place in their
    part, then shifted by the size of the earlier parts: one shuffle, however
    the keys are spread, and no single-task numbering.
    """
    place = F.monotonically_increasing_id()
    # The number is the part times 2^33 plus the place within it.
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(df.filter(F.col(key).isNotNull()).orderBy(key).withColumn("_place", place), "index")
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per part of the sort: a small table.
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    indexed = (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(out, (F.col("_offset") + within).cast("long"))
        .select(*df.columns, out)
    )
    return indexed.unionByName(df.filter(F.col(key).isNull()).withColumn(out, F.lit(None).cast("long")))


def audit_steps(df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], Column]]]) -> DataFrame:
    """Rows in, out and removed per filter step, in one pass over the data.

    ``steps`` are (name, predicate) pairs applied in order; a row that fails a
    step does not reach the next one.
    """
    alive = F.lit(True)
    counts = [F.count("*").alias("_0")]
    for i, (_, predicate) in enumerate(steps, 1):
        alive = alive & F.coalesce(predicate(df), F.lit(False))
        counts.append(F.count_if(alive).alias(f"_{i}"))
    rows = [
        F.struct(
            F.lit(i).alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"_{i - 1}").alias("rows_in"),
            F.col(f"_{i}").alias("rows_out"),
            (F.col(f"_{i - 1}") - F.col(f"_{i}")).alias("removed"),
        )
        for i, (name, _) in enumerate(steps, 1)
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))
