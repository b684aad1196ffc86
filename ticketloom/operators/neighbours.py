"""A stored neighbour index: vectors lie in cells around coarse centres, queries look into the nearest cells only.

What is found there is scored exactly.  Centres and the number of cells to
look into come from a bounded sample; every row is in the index.  With as many
probes as cells the search is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ticketloom.operators import vectors as V
from ticketloom.session import materialise, ship_by_value

ship_by_value(__name__)

# Rows that the centres and the probes are fitted on.
SAMPLE_ROWS = 8192
SAMPLE_QUERIES = 512
MAX_CELLS = 4096
# Rows of a cell, or of a group of neighbouring cells, that one task holds, and the most and the fewest queries that it meets.
CELL_ROWS = 50_000
QUERY_ROWS = 16_384
LEAST_QUERY_ROWS = 1024
# Distances, and (query, group) rows, that a task makes at once.
DISTANCES = 1 << 20
# Candidates that a task holds before it keeps the best ones.
HELD = 1 << 20


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances; on prepared (unit) vectors they order as cosines do."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def fitted_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Coarse centres: means of what is nearest to them; empty cells keep theirs."""
    centres = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(rounds):
        own = distances(sample, centres).argmin(1)
        total, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(total, own, sample)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def needed_probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """The smallest of the doubled numbers of cells that hold `target` of the k nearest sample rows of sample queries."""
    queries = sample[: min(SAMPLE_QUERIES, len(sample))]
    near = distances(queries, sample)
    near[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    wanted = np.argpartition(near, k - 1, axis=1)[:, :k]
    home = distances(sample, centres).argmin(1)
    # The place of every neighbour's cell among the query's cells, nearest first.
    place = np.argsort(np.argsort(distances(queries, centres), axis=1), axis=1)
    places = np.take_along_axis(place, home[wanted], axis=1)
    probes = 1
    while probes < len(centres) and (places < probes).mean() < target:
        probes *= 2
    return min(probes, len(centres))


def grouped_cells(centres: np.ndarray, sizes: dict[int, int]) -> tuple[int, ...]:
    """Number of each cell's group: neighbours along the widest direction, together no larger than a large cell."""
    centred = centres - centres.mean(0)
    along = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    groups, group, held = [0] * len(centres), 0, 0
    for cell in along.tolist():
        n = sizes.get(cell, 0)
        if held and held + n > CELL_ROWS:
            group, held = group + 1, 0
        groups[cell] = group
        held += n
    return tuple(groups)


@dataclass(frozen=True)
class NeighbourIndex:
    """Rows (id, vec) in cells; `blocks` has the number of blocks of each cell, `groups` the group that it is read with."""

    cells: DataFrame
    centres: np.ndarray
    blocks: tuple[int, ...]
    groups: tuple[int, ...]
    probes: int
    metric: str
    corpus_id: str
    vec: str

    @classmethod
    def build(
        cls, corpus: DataFrame, corpus_id: str = "id", vec: str = "vec", metric: str = "cosine", k: int = 10, target: float = 0.98,
        cells: int | None = None, probes: int | None = None,
    ) -> NeighbourIndex:
        """Index of all rows with a vector; rows of another length than the longest are never found.

        `target`: share of a sample's k nearest rows that the probes must hold.
        """
        rows = corpus.select(corpus_id, vec)
        shape = rows.agg(F.max(F.size(vec)), F.count(vec)).first()
        dim, n = shape[0] or 0, shape[1]
        drawn = rows.orderBy(F.xxhash64(corpus_id), corpus_id).limit(SAMPLE_ROWS).toArrow()
        sample = V._prepare(V._matrix(_usable(drawn, vec, dim).column(vec)), metric)
        if not len(sample):
            empty = rows.select(corpus_id, vec, F.lit(0).alias("cell")).limit(0)
            return cls(empty, np.zeros((1, max(dim, 1))), (1,), (0,), 1, metric, corpus_id, vec)
        wanted = cells or max(1, min(MAX_CELLS, round(n**0.5), len(sample)))
        centres = fitted_centres(sample, wanted)
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, DISTANCES // len(shared.value))
            for whole in batches:
                whole = _usable(whole, vec, dim)
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    home = distances(V._prepare(V._matrix(batch.column(vec)), metric), shared.value).argmin(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], [corpus_id, vec, "cell"])

        schema = ST.StructType([*rows.schema.fields, ST.StructField("cell", ST.IntegerType())])
        stored = materialise(rows.mapInArrow(place, schema), "neighbour-cells")
        # One row per cell.
        sizes = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}
        blocks = [max(1, -(-sizes.get(c, 0) // CELL_ROWS)) for c in range(len(centres))]
        groups = grouped_cells(centres, sizes)
        return cls(
            stored, centres, tuple(blocks), groups, probes or needed_probes(sample, centres, k, target), metric, corpus_id, vec
        )

    def search(self, queries: DataFrame, k: int = 5, query_id: str = "qid", exclude_self: bool = False) -> DataFrame:
        """(query_id, corpus_id, score, rank): the best k rows of the nearest cells, scored exactly, ties by corpus id.

        A cell meets only the queries that look into it.  A query travels once
        to each group of cells that holds one of its own; a large cell and the
        queries of a group are met in blocks.  Queries without a usable vector
        find nothing.
        """
        corpus_id, vec, metric, probes = self.corpus_id, self.vec, self.metric, self.probes
        rows = queries.select(F.col(query_id).alias(query_id), F.col(vec).alias(vec))
        group_of = np.array(self.groups)
        shared = rows.sparkSession.sparkContext.broadcast((self.centres, group_of))
        dim = self.centres.shape[1]

        def look(batches: Iterator[pa.RecordBatch], ids_only: bool) -> Iterator[pa.RecordBatch]:
            centres, groups = shared.value
            step = max(1, min(DISTANCES // len(centres), DISTANCES // 8 // probes))
            for whole in batches:
                whole = _usable(whole, vec, dim)
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    far = distances(V._prepare(V._matrix(batch.column(vec)), metric), centres)
                    near = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(far), 1))
                    row, cell = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                    order = np.lexsort((cell, groups[cell], row))
                    row, cell, group = row[order], cell[order], groups[cell][order]
                    first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(group) != 0)])
                    met = pa.array(group[first], pa.int32())
                    if ids_only:
                        yield pa.RecordBatch.from_arrays([met], ["group"])
                        continue
                    cells = pa.ListArray.from_arrays(pa.array(np.r_[first, len(cell)], pa.int32()), pa.array(cell, pa.int32()))
                    own = batch.take(pa.array(row[first]))
                    yield pa.RecordBatch.from_arrays([*own.columns, met, cells], [query_id, vec, "group", "cells"])

        def of_group(values: dict[int, int]):
            return F.element_at(F.array(*[F.lit(values.get(g, 1)) for g in range(int(group_of.max()) + 1)]), F.col("group") + 1)

        # One row per group.
        met = rows.mapInArrow(lambda batches: look(batches, True), "group int").groupBy("group").count().collect()
        cores = rows.sparkSession.sparkContext.defaultParallelism
        most = min(QUERY_ROWS, max(LEAST_QUERY_ROWS, sum(r["count"] for r in met) // (2 * cores)))
        parts = of_group({r["group"]: -(-r["count"] // most) for r in met})
        # A cell of several blocks is a group of its own.
        blocks = of_group({g: b for g, b in zip(self.groups, self.blocks) if b > 1})
        schema = ST.StructType([*rows.schema.fields, ST.StructField("group", ST.IntegerType()), ST.StructField("cells", ST.ArrayType(ST.IntegerType()))])
        looking = rows.mapInArrow(lambda batches: look(batches, False), schema)
        looking = looking.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        looking = looking.withColumn("part", F.pmod(F.xxhash64(query_id), parts).cast("int"))
        group = F.element_at(F.array(*[F.lit(g) for g in self.groups]), F.col("cell") + 1)
        lying = self.cells.select(*[F.col(c).alias(c) for c in self.cells.columns], group.alias("group"))
        lying = lying.withColumn("block", F.pmod(F.xxhash64(corpus_id), blocks).cast("int"))
        lying = lying.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        fields = [rows.schema[query_id], self.cells.schema[corpus_id], ST.StructField("score", ST.DoubleType())]

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            ids = left.column(query_id).to_numpy(), right.column(corpus_id).to_numpy()
            best = (np.empty(0, np.int64), ids[1][:0], np.empty(0))
            if left.num_rows and right.num_rows:
                qm, cm = (V._prepare(V._matrix(t.column(vec)), metric) for t in (left, right))
                lists = left.column("cells").combine_chunks()
                asked = np.repeat(np.arange(left.num_rows), lists.value_lengths().to_numpy())
                wanted, home = lists.flatten().to_numpy(), right.column("cell").to_numpy()
                asked, lying = asked[np.argsort(wanted, kind="stable")], np.argsort(home, kind="stable")
                wanted, home = np.sort(wanted), home[lying]
                held, n = [best], 0
                for cell in np.unique(home):
                    qi = asked[slice(*np.searchsorted(wanted, [cell, cell + 1]))]
                    ci = lying[slice(*np.searchsorted(home, [cell, cell + 1]))]
                    q, found, s = V._top_candidates(qm[qi], ids[0][qi], None, cm[ci], ids[1][ci], None, k, metric, exclude_self)
                    held.append((qi[q], found, s))
                    n += len(q)
                    if n > HELD:
                        held = [V._best(*(np.concatenate(x) for x in zip(*held)), k)]
                        n = 0
                best = V._best(*(np.concatenate(x) for x in zip(*held)), k)
            return pa.table({query_id: ids[0][best[0]], corpus_id: best[1], "score": best[2]})

        keys = ["group", "block", "part"]
        found = looking.groupBy(*keys).cogroup(lying.groupBy(*keys)).applyInArrow(meet, ST.StructType(fields))
        order = W.partitionBy(query_id).orderBy(F.desc("score"), corpus_id)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _usable(rows, vec: str, dim: int):
    """Arrow rows with a vector of this length and no missing or non-finite component."""
    rows = V._of_length(rows, vec, dim)
    if not rows.num_rows:
        return rows
    good = np.isfinite(V._matrix(rows.column(vec))).all(1)
    return rows.filter(pa.array(good))


def recall(exact: DataFrame, found: DataFrame, query_id: str = "qid", corpus_id: str = "id") -> DataFrame:
    """(possible, found, recall): how many of the exact results another search has."""
    hit = found.select(query_id, corpus_id, F.lit(1).alias("_hit"))
    both = exact.join(hit, [query_id, corpus_id], "left")
    share: Column = F.round(F.count("_hit") / F.nullif(F.count("*"), F.lit(0)), 6)
    return both.agg(F.count("*").alias("possible"), F.count("_hit").alias("found"), share.alias("recall"))
