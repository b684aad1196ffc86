"""Deterministic sampling, splitting and balancing.

Rows are ordered by ``md5(seed, key)``, so a result depends on the data alone.
A rank within a class is built from two levels: rows are first spread over hash
buckets, each bucket is ranked on its own and shifted by the size of the earlier
buckets.  A class that holds a third of the table is therefore ranked by many
tasks, and a bounded sample drops most rows before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketloom.session import broadcast_if_small

SEED = 42
# Buckets are named by leading hex digits of the hash: 16 ** 3 buckets per class.
BUCKET_DIGITS = 3


def row_hash(key: str | Sequence[str], seed: int = SEED) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hashed_rank(
    df: DataFrame,
    key: str,
    group: Sequence[str] = (),
    seed: int = SEED,
    limit: int | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``_rank`` (1-based, by row hash within each group) and ``_class_n`` (group size).

    With ``limit`` only rows of rank <= limit are returned, and buckets past
    the limit are dropped before the shuffle.  A null group value is a group.
    """
    group = list(group)
    ids = [f"_g{i}" for i in range(len(group))]
    hashed = df.select(
        "*",
        *[F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(i) for g, i in zip(group, ids)],
        row_hash(key, seed).alias("_h"),
    ).withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*ids, "_b").agg(F.count("*").alias("_n"))
    # At most 16 ** digits rows per group take part in these windows.
    whole = W.partitionBy(*ids)
    earlier = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *ids,
        "_b",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_class_n"),
    )
    if limit is not None:
        offsets = broadcast_if_small(offsets.filter(F.col("_offset") < limit), "bucket-offsets")
    within = F.row_number().over(W.partitionBy(*ids, "_b").orderBy("_h", key))
    ranked = (
        hashed.join(offsets, [*ids, "_b"])
        .withColumn("_rank", (F.col("_offset") + within).cast("long"))
        .drop("_h", "_b", "_offset", *ids)
    )
    return ranked if limit is None else ranked.filter(F.col("_rank") <= limit)


def sample_n(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (all rows when there are fewer)."""
    return hashed_rank(df, key, seed=seed, limit=n).drop("_rank", "_class_n")


def sample_in_category(df: DataFrame, label: str, value, n: int, key: str, seed: int = SEED) -> DataFrame:
    """``n`` random members of one class."""
    return sample_n(df.filter(F.col(label) == value), n, key, seed)


def cap_per_class(df: DataFrame, label: str, key: str, n: int = 2000, seed: int = SEED) -> DataFrame:
    """At most ``n`` rows per class, without replacement."""
    return hashed_rank(df, key, [label], seed, limit=n).drop("_rank", "_class_n")


def rounded_share(share: Column) -> Column:
    """Whole number of rows, halves up."""
    return F.floor(share + F.lit(0.5))


def stratified_split(
    df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = SEED, out: str = "is_test"
) -> DataFrame:
    """Mark ``round(test * n)`` rows of every class as test rows."""
    ranked = hashed_rank(df, key, [label], seed)
    quota = rounded_share(F.col("_class_n") * F.lit(test))
    return ranked.withColumn(out, F.col("_rank") <= quota).drop("_rank", "_class_n")


def split_in_place(
    df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = SEED, out: str = "is_test"
) -> DataFrame:
    """The rows that ``stratified_split`` marks, without moving them: only classes and keys are ranked.

    A row is a test row up to the hash of its class's last one.  Where copies
    of a key lie on both sides of that line, the rows themselves are ranked.
    """
    narrow = stratified_split(df.select(label, key), label, key, test, seed, out)
    group, digest = F.coalesce(F.col(label).cast("string"), F.lit("\0")), row_hash(key, seed)
    ends = narrow.groupBy(group.alias("_g")).agg(
        F.max(F.when(F.col(out), digest)).alias("_last"), F.min(F.when(~F.col(out), digest)).alias("_next")
    )
    ends = broadcast_if_small(ends, "split-ends")
    if not ends.filter(F.col("_last") == F.col("_next")).isEmpty():
        return stratified_split(df, label, key, test, seed, out)
    marked = df.withColumn("_g", group).join(ends.drop("_next"), "_g")
    return marked.withColumn(out, F.coalesce(digest <= F.col("_last"), F.lit(False))).drop("_g", "_last")


def stratified_sample(df: DataFrame, label: str, key: str, total: int, seed: int = SEED) -> DataFrame:
    """Stratified sample of about ``total`` rows: ``round(total * share)`` per class."""
    rows = df.agg(F.count("*")).scalar()
    quota = rounded_share(F.lit(total) * F.col("_class_n") / rows)
    ranked = hashed_rank(df, key, [label], seed, limit=total)
    return ranked.filter(F.col("_rank") <= quota).drop("_rank", "_class_n")


def kfold_assign(df: DataFrame, label: str, key: str, k: int = 5, seed: int = SEED, out: str = "fold") -> DataFrame:
    """Stratified fold number 0..k-1."""
    ranked = hashed_rank(df, key, [label], seed)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_class_n")


def balance_classes(df: DataFrame, label: str, key: str, target: int, seed: int = SEED) -> DataFrame:
    """Bring every class to ``target`` rows; adds ``copy`` (draw number) and ``method``.

    Larger classes are sampled without replacement.  Smaller classes are drawn
    with replacement: draw i of class c picks the row whose rank is a hash of
    (seed, c, i).  Rows of larger classes never reach the drawing join.  A null
    label is a class.
    """
    ranked = hashed_rank(df, key, [label], seed, limit=target)
    kept = ranked.filter(F.col("_class_n") >= target).withColumn("copy", F.col("_rank")).withColumn(
        "method", F.when(F.col("_class_n") > target, F.lit("undersampled")).otherwise(F.lit("kept"))
    )
    small = ranked.filter(F.col("_class_n") < target)
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    # Draw numbers are made in two steps so that a large target is spread over tasks.
    block = 10_000
    blocks = sizes.filter(F.col("_n") < target).select(
        label, "_n", F.explode(F.sequence(F.lit(0), F.lit((target - 1) // block))).alias("_block")
    )
    if target > block:
        blocks = blocks.repartition(label, "_block")
    first = F.col("_block") * block
    draws = blocks.select(
        label, "_n", F.explode(F.sequence(first + 1, F.least(first + block, F.lit(target)))).alias("copy")
    ).withColumn("copy", F.col("copy").cast("long"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(label).cast("string"), F.col("copy").cast("string")))
    pick = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("_n") + 1
    picked = draws.select(F.col(label).alias("_class"), pick.alias("_pick"), "copy")
    same = F.col(label).eqNullSafe(F.col("_class")) & (F.col("_rank") == F.col("_pick"))
    grown = small.join(picked, same).drop("_class", "_pick").withColumn("method", F.lit("oversampled"))
    return kept.unionByName(grown).drop("_rank", "_class_n")
