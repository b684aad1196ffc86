"""Product codes of vectors: eight parts, a small codebook for each, refined on a trie over the distinct parts.

The distinct parts of each position, with how often they occur, are stored in
lexicographic order, so every run of rows is a trie whose levels are the
dimensions.  A depth-first walk carries the vector of distances to all
entries down the trie: a prefix that many parts share is priced once, and a
leaf takes the nearest entry and adds its part, times its count, to that
entry's sum.  The driver sees the sums of 8 x 16 entries a round, nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import Stored
from ticketloom.session import ship_by_value

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Components beyond this, scaled, are set to it: 64 squared differences then still fit 64 bits.
WIDEST = 1 << 27
# Leaves that the walk prices together, level by level.
BLOCK = 4096


def scaled(vector: Column) -> Column:
    """floor(4096 * x) of every component."""
    low, high = F.lit(float(-WIDEST)), F.lit(float(WIDEST))
    return F.transform(vector, lambda x: F.floor(F.greatest(low, F.least(high, x.cast("double") * SCALE))).cast("int"))


def usable(vector: Column) -> Column:
    """No null vector, and no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def shared_prefix(parts: np.ndarray) -> np.ndarray:
    """How many leading dimensions each row shares with the row before it."""
    if not len(parts):
        return np.zeros(0, np.int64)
    differs = parts[1:] != parts[:-1]
    same = np.where(differs.any(1), differs.argmax(1), parts.shape[1])
    return np.concatenate([[0], same])


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part and its squared distance, ties to the lower index; `parts` in any order,
    the cheaper the better they are sorted."""
    n, dims = parts.shape
    entries = entries.astype(np.int64)
    shared = shared_prefix(parts)
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def step(acc: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
        return acc + (parts[rows, dim].astype(np.int64)[:, None] - entries[:, dim]) ** 2

    def finish(low: int, high: int, dim: int, starts: np.ndarray, acc: np.ndarray) -> None:
        """The leaves of neighbouring subtrees, which begin at `starts` and are priced up to `dim`."""
        for d in range(dim, dims):
            below = low + np.flatnonzero(shared[low:high] <= d)
            below = below if len(below) and below[0] == low else np.concatenate([[low], below])
            acc, starts = step(acc[np.searchsorted(starts, below, "right") - 1], below, d), below
        best = acc.argmin(1)
        times = np.diff(np.append(starts, high))
        index[low:high] = np.repeat(best, times)
        distance[low:high] = np.repeat(acc[np.arange(len(best)), best], times)

    stack = [(0, n, 0, np.zeros((1, len(entries)), np.int64))] if n else []
    while stack:
        low, high, dim, acc = stack.pop()
        if high - low <= BLOCK or dim == dims:
            finish(low, high, dim, np.array([low]), acc)
            continue
        starts = low + np.flatnonzero(shared[low:high] <= dim)
        starts = starts if len(starts) and starts[0] == low else np.concatenate([[low], starts])
        ends, children = np.append(starts[1:], high), step(np.repeat(acc, len(starts), 0), starts, dim)
        # Small children go together, in runs of at most BLOCK leaves; a large one is walked by itself.
        at = 0
        while at < len(starts):
            upto = int(np.searchsorted(ends, starts[at] + BLOCK, "right"))
            if upto > at:
                finish(int(starts[at]), int(ends[upto - 1]), dim + 1, starts[at:upto], children[at:upto])
                at = upto
            else:
                stack.append((int(starts[at]), int(ends[at]), dim + 1, children[at : at + 1]))
                at += 1
    return index, distance


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def distinct_parts(kept: DataFrame, width: int, parts: int) -> DataFrame:
    """position, part and how often it occurs, in lexicographic order; copies meet inside the reading tasks first."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = matrix(batch.column(0), width * parts)
            for p in range(parts):
                own, n = np.unique(whole[:, p * width : (p + 1) * width], axis=0, return_counts=True)
                offsets = np.arange(0, own.size + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), p), pa.int32()), pa.ListArray.from_arrays(offsets, own.ravel().astype(np.int32)), pa.array(n, pa.int64())],
                    ["position", "part", "n"],
                )

    found = kept.select("vector").mapInArrow(split, "position int, part array<int>, n long")
    ranges = found.repartitionByRange("position", "part")
    return ranges.groupBy("position", "part").agg(F.sum("n").alias("n")).sortWithinPartitions("position", "part")


def refined(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries without parts stay."""
    parts, entries, width = books.shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            positions, own, n = batch.column(0).to_numpy(), matrix(batch.column(1), width), batch.column(2).to_numpy()
            for p in np.unique(positions):
                rows = positions == p
                index, _ = nearest(own[rows], books[p])
                np.add.at(count[p], index, n[rows])
                np.add.at(total[p], index, own[rows].astype(np.int64) * n[rows][:, None])
        p, e = np.nonzero(count)
        columns = [p.astype(np.int32), e.astype(np.int32), count[p, e], *total[p, e].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    sums = [f"s{k}" for k in range(width)]
    names = ["position", "entry", "n", *sums]
    schema = "position int, entry int, " + ", ".join(f"{c} long" for c in names[2:])
    rows = stored.mapInArrow(walk, schema).groupBy("position", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
    after = books.copy()
    # At most parts * entries rows, whatever the input.
    for row in rows.collect():
        after[row["position"], row["entry"]] = [row[s] // row["n"] for s in sums]
    return after


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every row."""
    parts, entries, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = matrix(batch.column("vector"), width * parts)
            codes, error = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
            for p in range(parts):
                own, back = np.unique(whole[:, p * width : (p + 1) * width], axis=0, return_inverse=True)
                index, distance = nearest(own, books[p])
                codes[:, p] = index[back.ravel()]
                error += distance[back.ravel()]
            text = [bytes(c).hex() for c in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    kinds = dict(kept.dtypes)
    return kept.select("vec_id", "label", "vector").mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
               parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """The codes of all usable vectors (vec_id, label, code, error) and the codebooks (parts, entries, dims).

    Rows whose vector is null, holds a null or non-finite component, or is not
    as long as that of the smallest usable vec_id (a multiple of `parts`) are
    dropped.  Repeated rows are coded one by one and weigh as often as they
    occur.  A codebook starts from the smallest vec_ids, null last, equal ones
    by their components; with fewer rows it has fewer entries.  An empty table
    has no rows and no codebooks.  Components beyond 32,768 count as that.
    """
    spark, tables = vectors.sparkSession, Stored(vectors.sparkSession)
    picked = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("raw"))
    kept = picked.where(usable(F.col("raw")) & (F.size("raw") > 0)).select("vec_id", "label", scaled(F.col("raw")).alias("vector"))
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    head = kept.orderBy(*order).limit(1).collect()
    dims = len(head[0]["vector"]) if head else 0
    if not dims or dims % parts:
        return spark.createDataFrame([], kept.drop("vector").schema).selectExpr("*", "'' AS code", "0L AS error"), None
    kept = kept.where(F.size("vector") == dims)
    first = kept.orderBy(*order).limit(entries).collect()
    books = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    stored = tables(distinct_parts(kept, dims // parts, parts), "vector-parts")
    for _ in range(rounds):
        after = refined(stored, books)
        if (after == books).all():
            break
        books = after
    tables.drop()
    return coded(kept, books), books


# Rows of one label's sum, so that the join below never sends a label's rows to one task.
SALTS = 16


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors summed over equal labels, nulls together) and
    codebooks_sha256 of every usable vector; see `compressed` for which rows are dropped."""
    rows, books = compressed(vectors, vec_id, vector, label)
    digest = hashlib.sha256(",".join(map(str, books.ravel() if books is not None else ())).encode()).hexdigest()
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("own", F.pmod(F.hash("vec_id", "code"), F.lit(SALTS)))
    joined = salted.join(sums, salted["label"].eqNullSafe(sums["of"]) & (salted["own"] == sums["salt"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


ship_by_value(__name__)
