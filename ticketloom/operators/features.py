"""Text features: relational TF-IDF and its MLlib form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
)
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.functions import text as T
from ticketloom.operators import terms as R
from ticketloom.session import broadcast_if_small

# Training rows one task handles per pass, and the fewest while there are idle cores.
ROWS_PER_TASK = 10_000
LEAST_ROWS_PER_TASK = 1000


def tfidf(
    df: DataFrame,
    key: str,
    text_col: str,
    max_features: int = 5000,
    min_df: int = 2,
    max_df: float = 0.8,
    stopwords: Sequence[str] = K.ENGLISH_STOPWORDS,
    ngram: tuple[int, int] = (1, 1),
) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), rows scaled to unit length.  A key names one row."""
    lists = R.term_lists(df, text_col, stopwords, ngram, [key])
    terms = R.vocabulary(lists, max_features, min_df, max_df)
    return R.term_weights(lists, key, R.idf_of(terms, df.count()))


def term_counts(
    df: DataFrame, text_col: str, top: int = 50, stopwords: Sequence[str] = K.ENGLISH_STOPWORDS
) -> DataFrame:
    """Most frequent terms of the corpus."""
    terms = df.select(F.explode(T.tokenise_terms(F.col(text_col), stopwords)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Alphabetical label encoding: (label, index)."""
    # One row per class.
    return df.select(label).distinct().withColumn(
        "index", (F.row_number().over(W.orderBy(F.col(label).cast("string"))) - 1).cast("int")
    )


def label_indexer(label: str, out: str = "label_index") -> StringIndexer:
    """The same encoding as a fitted stage; ``IndexToString`` with its labels inverts it."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights: n / (classes * n_class)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = sizes.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return sizes.select(
        label, "n", F.round(totals["rows"] / (totals["classes"] * F.col("n")), 6).alias("weight")
    )


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add the balanced weight as a column."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = sizes.agg(F.struct(F.sum("_n").alias("rows"), F.count("*").alias("classes"))).scalar()
    weights = sizes.select(label, (totals["rows"] / (totals["classes"] * F.col("_n"))).alias(out))
    # One row per class travels; a shuffle would bring each class to one task.
    return df.join(broadcast_if_small(weights, "class-weights"), label)


def sized(df: DataFrame, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """As few partitions as keep the cores busy: an iteration costs at least one task each.

    A set of fewer than ``LEAST_ROWS_PER_TASK`` rows is one task; a stored set of too few partitions is spread.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, -(-rows // per_task), min(cores, -(-rows // LEAST_ROWS_PER_TASK)))
    enough = wanted == 1 or wanted > cores or df.rdd.getNumPartitions() >= wanted
    return df.coalesce(wanted) if enough else df.repartition(wanted)


def fit_tfidf(
    df: DataFrame,
    text_col: str,
    out: str = "features",
    max_features: int = 5000,
    min_df: int = 2,
    max_df: float = 0.8,
    stopwords: Sequence[str] = K.ENGLISH_STOPWORDS,
    ngram: tuple[int, int] = (1, 1),
) -> PipelineModel:
    """Fitted text -> unit-length TF-IDF vector stages, savable as one model."""
    text_stages = [
        RegexTokenizer(
            inputCol=text_col, outputCol="_tokens", pattern=f"{T.WORD}{{2,}}", gaps=False, toLowercase=True
        ),
        StopWordsRemover(inputCol="_tokens", outputCol="_kept", stopWords=list(stopwords), caseSensitive=True),
    ]
    columns = []
    for n in range(ngram[0], ngram[1] + 1):
        columns.append("_kept" if n == 1 else f"_gram{n}")
        if n > 1:
            text_stages.append(NGram(n=n, inputCol="_kept", outputCol=f"_gram{n}"))
    text_stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(columns)}) AS _terms FROM __THIS__"))
    lists = R.term_lists(df, text_col, stopwords, ngram)
    idf = R.idf_of(R.vocabulary(lists, max_features, min_df, max_df), df.count())
    if not idf:
        raise ValueError("no term is within the document-frequency limits")
    counter = CountVectorizerModel.from_vocabulary(list(idf), inputCol="_terms", outputCol="_counts")
    scale = ElementwiseProduct(inputCol="_counts", outputCol="_scaled", scalingVec=DenseVector(list(idf.values())))
    unit = Normalizer(inputCol="_scaled", outputCol=out, p=2.0)
    return PipelineModel([*text_stages, counter, scale, unit])


def vector_entries(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, index, value) for the stored entries of sparse vectors; zeros are never expanded."""
    stored = "v struct<indices: array<int>, values: array<double>>"
    parsed = F.from_json(F.to_json(F.struct(F.col(vec).alias("v"))), stored)["v"]
    pairs = F.arrays_zip(parsed["indices"].alias("index"), parsed["values"].alias("value"))
    return df.select(key, F.inline(pairs))


def regularisation(c: float, rows: int) -> float:
    """Spark's regParam for an inverse regularisation strength C on ``rows`` rows."""
    return 1.0 / (c * rows) if rows else math.inf
