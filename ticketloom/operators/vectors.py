"""Vector tables: embedding, profiles, exact top-k search, fusion and retrieval context."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ticketloom.functions import text as T
from ticketloom.functions.prompts import build_prompt
from ticketloom.session import ship_by_value

ship_by_value(__name__)

# Query vectors shipped to every task: checked before use, see ``search``.
MAX_SHIPPED_QUERIES = 4096
# Rows of one block of the grid search, the fewest that a block is cut to, and the queries and rows scored at once.
BLOCK_ROWS = 65_536
LEAST_BLOCK_ROWS = 4096
QUERY_SLICE = 256
CORPUS_SLICE = 4096
SCORE_DIGITS = 6
DEFAULT_DIM = 256


# --- embedding ---------------------------------------------------------------------
def embed_texts(
    df: DataFrame,
    text_col: str,
    out: str = "vec",
    dim: int = DEFAULT_DIM,
    encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
) -> DataFrame:
    """Add a unit-length float vector per text.

    ``encoder`` is a factory called once per Python worker; it returns a
    function from a list of texts to a matrix.  The built-in encoder hashes the
    terms of a text into ``dim`` buckets and stays inside the JVM.
    """
    if encoder is not None:
        return _embed_with(df, text_col, out, encoder)
    bucket = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("string")
    tokens = df.withColumn("_buckets", F.transform(T.tokenise_terms(F.col(text_col)), bucket))
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dim)], inputCol="_buckets", outputCol="_counts"
    )
    normed = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counter.transform(tokens))
    return normed.withColumn(out, vector_to_array("_unit", "float32")).drop("_buckets", "_counts", "_unit")


def _embed_with(df, text_col, out, encoder) -> DataFrame:
    @F.pandas_udf(ST.ArrayType(ST.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in batches:
            matrix = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.Series(list(matrix / np.where(norms == 0, 1, norms)))

    return df.withColumn(out, encode(F.col(text_col)))


# --- profiles ----------------------------------------------------------------------
def vector_profile(df: DataFrame, vec: str) -> DataFrame:
    """Rows, dimension, and smallest, largest and mean component."""
    return df.select(
        F.size(vec).alias("_dim"),
        F.array_min(vec).cast("double").alias("_lo"),
        F.array_max(vec).cast("double").alias("_hi"),
        F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("_sum"),
    ).agg(
        F.count("*").alias("n"),
        F.max("_dim").alias("dim"),
        F.round(F.min("_lo"), 6).alias("min_value"),
        F.round(F.max("_hi"), 6).alias("max_value"),
        F.round(F.sum("_sum") / F.sum("_dim"), 6).alias("mean_value"),
    )


def category_centroids(df: DataFrame, label: str, vec: str, out: str = "centroid") -> DataFrame:
    """Mean vector per class; partial means are merged, vectors are never unfolded to rows."""
    mean = Summarizer.mean(array_to_vector(F.col(vec)))
    return df.groupBy(label).agg(vector_to_array(mean).alias(out))


def centroid_components(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Centroids in long form: (label, pos, value)."""
    return category_centroids(df, label, vec, "_mean").select(label, F.posexplode("_mean").alias("pos", "value"))


def centroid_similarity(df: DataFrame, label: str, vec: str, threshold: float | None = None) -> DataFrame:
    """Cosine similarity of each pair of class centroids, by joining components on position."""
    parts = centroid_components(df, label, vec)
    norms = parts.groupBy(label).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    unit = parts.join(norms, label).select(label, "pos", (F.col("value") / F.col("_norm")).alias("u"))
    a = unit.select("pos", F.col(label).alias("class_a"), F.col("u").alias("_a"))
    b = unit.select("pos", F.col(label).alias("class_b"), F.col("u").alias("_b"))
    pairs = (
        a.join(b, "pos")
        .filter(F.col("class_a") < F.col("class_b"))
        .groupBy("class_a", "class_b")
        .agg(F.round(F.sum(F.col("_a") * F.col("_b")), SCORE_DIGITS).alias("similarity"))
    )
    return pairs if threshold is None else pairs.filter(F.col("similarity") > threshold)


def attach_vectors(df: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows joined to their vectors by key, never by position."""
    return df.join(vectors, key)


# --- exact top-k search ------------------------------------------------------------
def _matrix(column: pa.Array) -> np.ndarray:
    """List column of equal-length vectors as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def _prepare(matrix: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return matrix
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores before rounding."""
    if metric == "cosine":
        return q @ c.T
    squared = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (q @ c.T)
    return -np.sqrt(np.maximum(squared, 0))


def _best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int):
    """Best k (score, then id) per query number from flat candidate lists."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    if not len(q):
        return q, ids, s
    starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = place < k
    return q[keep], ids[keep], s[keep]


def _first_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the best k of every row; of equal scores the first columns."""
    if scores.shape[1] <= k:
        return scores > -np.inf
    cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1, None]
    above, tie = scores > cut, scores == cut
    tie &= np.cumsum(tie, axis=1, dtype=np.int32) <= k - above.sum(1)[:, None]
    return (above | tie) & (scores > -np.inf)


def _top_candidates(qm, q_ids, q_groups, cm, c_ids, c_groups, k, metric, exclude_self):
    """Best k corpus rows of one block per query number: (query number, id, score).

    The corpus is met in slices in order of id, so a later row that ties with
    the k-th score so far has lost, and however many rows tie, no more than one
    slice of scores and k rows per query are held.
    """
    order = np.argsort(c_ids, kind="stable")
    cm, c_ids = cm[order], c_ids[order]
    c_groups = None if c_groups is None else c_groups[order]
    return top_by_score(
        lambda part, near: _scores(qm[part], cm[near], metric), len(qm), q_ids, q_groups, c_ids, c_groups, k, exclude_self
    )


def top_by_score(score, n_queries, q_ids, q_groups, c_ids, c_groups, k, exclude_self=False):
    """The same for corpus rows in order of id, from the scores of a slice of queries against a slice of the corpus."""
    # A score that rounds to more than another rounded one exceeds it by more than this.
    slack = 0.4 * 10.0**-SCORE_DIGITS
    found = [(np.empty(0, np.int64), c_ids[:0], np.empty(0))]
    for lo in range(0, n_queries, QUERY_SLICE):
        part = slice(lo, min(lo + QUERY_SLICE, n_queries))
        floor, best = np.full(part.stop - lo, -np.inf), found[0]
        for at in range(0, len(c_ids), CORPUS_SLICE):
            near = slice(at, min(at + CORPUS_SLICE, len(c_ids)))
            scores = score(part, near)
            if q_groups is not None:
                scores[q_groups[part][:, None] != c_groups[near][None, :]] = -np.inf
            if exclude_self:
                scores[q_ids[part][:, None] == c_ids[near][None, :]] = -np.inf
            mask = scores > (floor + slack)[:, None]
            if np.count_nonzero(mask) > 4 * k * len(floor):
                scores = np.round(scores, SCORE_DIGITS)
                scores[~(np.isfinite(scores) & (scores > floor[:, None]))] = -np.inf
                mask = _first_best(scores, k)
            qi, ci = np.nonzero(mask)
            values = np.round(scores[qi, ci], SCORE_DIGITS)
            new = np.isfinite(values) & (values > floor[qi])
            if not new.any():
                continue
            best = _best(*(np.concatenate(x) for x in zip(best, (qi[new], c_ids[near][ci[new]], values[new]))), k)
            last = np.flatnonzero(np.r_[np.diff(best[0]) > 0, True])
            full = np.diff(np.r_[-1, last]) == k
            floor[best[0][last[full]]] = best[2][last[full]]
        found.append((best[0] + lo, *best[1:]))
    return [np.concatenate(x) for x in zip(*found)]


def search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    query_id: str = "qid",
    corpus_id: str = "id",
    vec: str = "vec",
    group: str | None = None,
    exclude_self: bool = False,
    metric: str = "cosine",
    max_shipped: int = MAX_SHIPPED_QUERIES,
) -> DataFrame:
    """Exact top-k corpus rows per query: (query_id, corpus_id, score, rank).

    Ties are broken by corpus id.  ``group`` limits matches to the query's own
    group, ``exclude_self`` drops the row with the query's id.  A query set of
    checked size travels to the tasks and the corpus is read in place without a
    shuffle; a larger one is joined with the corpus block by block on a grid.
    Either way a task returns at most k rows per query, never all pairs.
    The longest query vector sets the dimension: rows whose vector is null, of
    another length or lacks a component find nothing and are never found.
    """
    q_cols = [query_id, vec] + ([group] if group else [])
    c_cols = [corpus_id, vec] + ([group] if group else [])
    queries, corpus = queries.select(*q_cols), corpus.select(*c_cols)
    fields = [queries.schema[query_id], corpus.schema[corpus_id]]
    schema = ST.StructType(
        [ST.StructField(query_id, fields[0].dataType), ST.StructField(corpus_id, fields[1].dataType),
         ST.StructField("score", ST.DoubleType())]
    )
    shipped = queries.limit(max_shipped + 1).toArrow()
    spec = dict(k=k, query_id=query_id, corpus_id=corpus_id, vec=vec, group=group, exclude_self=exclude_self, metric=metric)
    if shipped.num_rows <= max_shipped:
        lengths = pc.list_value_length(shipped.column(vec))
        dim = pc.max(lengths).as_py() or 0
        shipped = _of_length(shipped, vec, dim)
        partial = _search_in_place(shipped, corpus, schema, dim=dim, **spec)
    else:
        dim = queries.agg(F.max(F.size(vec))).first()[0]
        partial = _search_on_grid(queries, corpus, schema, dim=dim, **spec)
    order = W.partitionBy(query_id).orderBy(F.desc("score"), corpus_id)
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _of_length(rows, vec: str, dim: int):
    """Arrow rows whose vector has this length.

    A filter of the DataFrame would repeat a computed vector, and all that it
    is made from, below every exchange.
    """
    return rows.filter(pc.fill_null(pc.equal(pc.list_value_length(rows.column(vec)), dim), False))


def _search_in_place(shipped, corpus, schema, dim, k, query_id, corpus_id, vec, group, exclude_self, metric) -> DataFrame:
    q_ids = shipped.column(query_id).to_numpy()
    q_groups = shipped.column(group).to_numpy() if group else None
    q_matrix = _prepare(_matrix(shipped.column(vec)), metric)

    def scan(batches):
        best = None
        for batch in batches:
            batch = _of_length(batch, vec, dim)
            if not batch.num_rows or not len(q_ids):
                continue
            c_ids = batch.column(corpus_id).to_numpy(zero_copy_only=False)
            c_groups = batch.column(group).to_numpy(zero_copy_only=False) if group else None
            c_matrix = _prepare(_matrix(batch.column(vec)), metric)
            found = _top_candidates(q_matrix, q_ids, q_groups, c_matrix, c_ids, c_groups, k, metric, exclude_self)
            if best is not None:
                found = [np.concatenate(x) for x in zip(best, found)]
            best = _best(*found, k)
        if best is not None:
            q, ids, s = best
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[q]), pa.array(ids), pa.array(s)], names=[query_id, corpus_id, "score"]
            )

    return corpus.mapInArrow(scan, schema)


def _search_on_grid(queries, corpus, schema, dim, k, query_id, corpus_id, vec, group, exclude_self, metric) -> DataFrame:
    """Queries and corpus cut into hash blocks of bounded size; one task per pair of blocks."""
    q_rows, c_rows = queries.count(), corpus.count()
    q_blocks, c_blocks = max(1, -(-q_rows // BLOCK_ROWS)), max(1, -(-c_rows // BLOCK_ROWS))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    while q_blocks * c_blocks < 2 * cores and max(q_rows / q_blocks, c_rows / c_blocks) > LEAST_BLOCK_ROWS:
        if q_rows / q_blocks > c_rows / c_blocks:
            q_blocks += 1
        else:
            c_blocks += 1

    def cut(df, key, blocks, name):
        # New columns: both sides may come from one table.
        own = df.select(*[F.col(c).alias(c) for c in df.columns])
        return own.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))

    def spread(blocks, name):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)

    q = cut(queries, query_id, q_blocks, "_qb").select("*", spread(c_blocks, "_cb"))
    c = cut(corpus, corpus_id, c_blocks, "_cb").select("*", spread(q_blocks, "_qb"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _of_length(left, vec, dim), _of_length(right, vec, dim)
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, types)})
        ids = left.column(query_id).to_numpy(), right.column(corpus_id).to_numpy()
        groups = (left.column(group).to_numpy(), right.column(group).to_numpy()) if group else (None, None)
        qi, found, s = _top_candidates(
            _prepare(_matrix(left.column(vec)), metric), ids[0], groups[0],
            _prepare(_matrix(right.column(vec)), metric), ids[1], groups[1], k, metric, exclude_self,
        )
        return pa.table({query_id: ids[0][qi], corpus_id: found, "score": s})

    types = [pa.int64() if isinstance(f.dataType, ST.LongType) else pa.int32() if isinstance(f.dataType, ST.IntegerType)
             else pa.float64() if isinstance(f.dataType, ST.DoubleType) else pa.string() for f in schema.fields]
    return q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb")).applyInArrow(cell, schema)


def search_filtered(queries: DataFrame, corpus: DataFrame, condition, **options) -> DataFrame:
    """Top-k over the corpus rows that meet a metadata condition; the filter reaches the scan."""
    return search(queries, corpus.filter(condition), **options)


def knn_classify(
    train: DataFrame, test: DataFrame, label: str, train_id: str, test_id: str, vec: str = "vec", k: int = 5,
    find: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Majority vote of the k nearest (Euclidean) training rows; ties go to the smallest label.

    ``find`` maps the test rows to their neighbours, such as the search of a
    neighbour index over the training rows; the exact search by default.
    """
    near = find(test) if find else search(test, train, k, test_id, train_id, vec, metric="euclidean")
    votes = near.join(train.select(train_id, label), train_id).groupBy(test_id, label).agg(F.count("*").alias("_votes"))
    order = F.struct((-F.col("_votes")).alias("v"), F.col(label).alias("l"))
    return votes.groupBy(test_id).agg(F.min_by(label, order).alias("prediction"), F.max("_votes").alias("votes"))


def fuse(
    first: DataFrame,
    second: DataFrame,
    query: str = "qid",
    doc: str = "doc",
    weights: tuple[float, float] = (0.5, 0.5),
    k: int = 5,
) -> DataFrame:
    """Weighted sum of two result lists, a missing score counting zero; best k per query."""
    a = first.select(query, doc, F.col("score").alias("_a"))
    b = second.select(query, doc, F.col("score").alias("_b"))
    score = F.coalesce("_a", F.lit(0.0)) * weights[0] + F.coalesce("_b", F.lit(0.0)) * weights[1]
    # Two more digits than the inputs, so that a weighted mean of them is kept as it is.
    joined = a.join(b, [query, doc], "full").select(query, doc, F.round(score, SCORE_DIGITS + 2).alias("score"))
    order = W.partitionBy(query).orderBy(F.desc("score"), doc)
    return joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid_retrieve(
    first: Callable[[int], DataFrame],
    second: Callable[[int], DataFrame],
    weights: tuple[float, float] = (0.5, 0.5),
    k: int = 5,
    query: str = "qid",
    doc: str = "id",
) -> DataFrame:
    """The top-k lists of two retrievers, fused; a retriever maps k to (query, doc, score)."""
    return fuse(first(k), second(k), query=query, doc=doc, weights=weights, k=k)


# --- retrieval context -------------------------------------------------------------
def _majority(labels: Column) -> Column:
    """Most frequent label of a short list; ties go to the smallest."""
    distinct = F.array_sort(F.array_distinct(labels))
    votes = F.transform(distinct, lambda name: F.size(F.filter(labels, lambda x: x == name)))
    return F.element_at(distinct, F.array_position(votes, F.array_max(votes)).cast("int"))


def _ranked(results: DataFrame, corpus: DataFrame, query: str, corpus_id: str, cols: Sequence[str]) -> DataFrame:
    """Columns of the top-k rows of every query as one list in rank order: at most k entries."""
    found = results.select(query, "rank", corpus_id).join(corpus.select(corpus_id, *cols), corpus_id)
    return found.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", *cols))).alias("_top"))


def _context(text_col: str) -> Column:
    return F.array_join(F.transform("_top", lambda s: s[text_col]), "\n")


def rag_context(results: DataFrame, corpus: DataFrame, query: str, corpus_id: str, text_col: str) -> DataFrame:
    """Texts of the top-k results in rank order, one per line."""
    ranked = _ranked(results, corpus, query, corpus_id, [text_col])
    return ranked.select(query, _context(text_col).alias("context"))


def neighbour_vote(results: DataFrame, corpus: DataFrame, query: str, corpus_id: str, label: str) -> DataFrame:
    """Most frequent class among the results of each query: the default responder."""
    ranked = _ranked(results, corpus, query, corpus_id, [label])
    return ranked.select(query, _majority(F.transform("_top", lambda s: s[label])).alias("response"))


def rag_batch(
    tickets: DataFrame,
    corpus: DataFrame,
    categories: Sequence[str],
    query: str = "qid",
    query_text: str = "text",
    corpus_id: str = "id",
    corpus_text: str = "text",
    label: str = "category",
    vec: str = "vec",
    k: int = 5,
    responder: Callable[[pd.Series], pd.Series] | None = None,
) -> DataFrame:
    """Per ticket: retrieved context, prompt and response.

    ``responder`` maps a batch of prompts to responses and runs as a pandas UDF;
    without one the response is the neighbours' majority class.
    """
    results = search(tickets, corpus, k, query, corpus_id, vec)
    # One search and one join give both the context and the neighbours' classes.
    ranked = _ranked(results, corpus, query, corpus_id, [corpus_text, label])
    joined = tickets.select(query, F.col(query_text).alias("ticket")).join(ranked, query, "left")
    filled = joined.withColumn("context", F.coalesce(_context(corpus_text), F.lit(""))).withColumn(
        "prompt", build_prompt(F.col("ticket"), F.col("context"), categories)
    )
    vote = _majority(F.transform("_top", lambda s: s[label]))
    response = vote if responder is None else F.pandas_udf(responder, "string")("prompt")
    return filled.withColumn("response", response).drop("_top")
