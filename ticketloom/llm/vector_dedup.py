"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one vector of each group.

A vector lives in the cell of its nearest centre and also visits every cell
of a smaller number whose border it is near to.  The border of two cells is
the plane midway between their centres; a vector at sine s above that plane
is at least that far from everything behind it, so with s beyond the sine of
the link angle it has no partner there.  Every linked pair thus meets in
exactly one cell: the home of the one that the other visits, or their common
home.  Cells are joined in blocks; a block sends each vector's number of
links and a representative, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import Stored, store
from ticketloom.llm.jaccard_join import components
from ticketloom.session import ship_by_value

COSINE = 0.95
# Vectors from which the centres are fitted; links do not depend on the centres.
SAMPLE = 1 << 13
# Visits a vector makes on average at most, on the sample: more cells are only taken while they stay below.
VISITS = 2.0
MOST_CELLS = 1 << 12
# Vectors of one side of a block, and of one tile inside it.
BLOCK = 1 << 15
TILE = 1 << 9
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; no row may be zero."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fitted(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Centres of spherical k-means, from vectors spread over the sample; empty cells keep theirs."""
    centres = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        length = np.sqrt((total * total).sum(1))
        centres[length > 0] = total[length > 0] / length[length > 0, None]
    return centres


def reach(vectors: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and a mask of the cells of smaller numbers that it visits."""
    near = vectors @ centres.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))
    sine = (near[np.arange(len(home)), home][:, None] - near) / apart[home]
    return home, (sine <= np.sqrt(1 - cosine * cosine) + SLACK) & (np.arange(len(centres)) < home[:, None])


def centres_of(sample: np.ndarray, n: int, cosine: float, visits: float) -> np.ndarray:
    """As many centres, doubled up to the root of n, as leave the sample's vectors with few enough visits."""
    best, cells = fitted(sample, 1), 2
    while cells <= min(MOST_CELLS, n**0.5, len(sample)):
        centres = fitted(sample, cells)
        if reach(sample, centres, cosine)[1].sum(1).mean() > visits:
            break
        best, cells = centres, 2 * cells
    return best


def usable_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a vector of this length, all finite and not all zero, and these vectors."""
    lengths = np.array(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dims)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(values).all(1) & (values != 0).any(1)
    return rows[good], np.ascontiguousarray(values[good])


def digests(vectors: np.ndarray) -> np.ndarray:
    """128 bits of each vector's bytes as two integers."""
    return np.array([np.frombuffer(hashlib.blake2b(v.tobytes(), digest_size=16).digest(), np.int64) for v in vectors]).reshape(-1, 2)


class Group:
    """Links among the distinct vectors of one block: how many each has, by weight, and who is joined to whom."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, cosine: float):
        self.vectors, self.weight, self.cosine = vectors, weight.astype(np.float64), cosine
        self.single, self.error = vectors.astype(np.float32), 1e-6 + 2e-7 * vectors.shape[1]
        self.links, self.root = np.zeros(len(vectors), np.int64), np.arange(len(vectors))

    def join(self, rows: np.ndarray, others: np.ndarray) -> None:
        """Links between two sets of members, given by their ascending numbers: the same set, or sets without a common one."""
        same = rows is others
        for low in range(0, len(rows), TILE):
            own = rows[low : low + TILE]
            # Single precision, less its error, tells which rows have links at all; these are taken again in double.
            maybe = self.single[own] @ self.single[others].T >= self.cosine - self.error
            if same:
                maybe[np.arange(len(own)), np.arange(low, low + len(own))] = False
            own = own[maybe.any(1)]
            if not len(own):
                continue
            linked = self.vectors[own] @ self.vectors[others].T >= self.cosine
            if same:
                linked[np.arange(len(own)), np.searchsorted(others, own)] = False
            as_number = linked.astype(np.float64)
            self.links[own] += (as_number @ self.weight[others]).astype(np.int64)
            if not same:
                self.links[others] += (self.weight[own] @ as_number).astype(np.int64)
            for k in np.flatnonzero(linked.any(1)):
                roots = np.unique(np.append(self.root[others[linked[k]]], self.root[own[k]]))
                if len(roots) > 1:
                    self.root[np.isin(self.root, roots[1:])] = roots[0]


ROWS = "cell int, i int, j int, role int, h1 long, h2 long, weight long, vector binary"
LINKS = "h1 long, h2 long, links long, r1 long, r2 long"


def block_links(table: pa.Table, dtype: str, cosine: float) -> pa.Table:
    """Links of one block: row members (role 0) among themselves or with column members (1), and with visitors (2)."""
    role = table["role"].to_numpy()
    key = np.rec.fromarrays([role, table["h1"].to_numpy(), table["h2"].to_numpy()])
    names, first, back = np.unique(key, return_index=True, return_inverse=True)
    weight = np.zeros(len(names), np.int64)
    np.add.at(weight, back.ravel(), table["weight"].to_numpy())
    raw = b"".join(table["vector"].take(pa.array(first)).to_pylist())
    vectors = unit(np.frombuffer(raw, dtype).reshape(len(names), -1))
    at = [np.flatnonzero(role[first] == r) for r in range(3)]
    group = Group(vectors, weight, cosine)
    if table["i"][0].as_py() == table["j"][0].as_py():
        group.join(at[0], at[0])
    for others in at[1:]:
        if len(at[0]) and len(others):
            group.join(at[0], others)
    found = np.flatnonzero(group.links)
    h1, h2 = np.asarray(names["f1"]), np.asarray(names["f2"])
    root = group.root[found]
    return pa.Table.from_arrays(
        [pa.array(c, pa.int64()) for c in (h1[found], h2[found], group.links[found], h1[root], h2[root])], ["h1", "h2", "links", "r1", "r2"]
    )


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                 sample: int = SAMPLE, visits: float = VISITS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two rows link when the cosine of their vectors, in double precision, is at
    least `cosine`; no link is lost.  Null, zero, empty and non-finite vectors,
    those with a null component, and those of another length than most rows
    (the longer one if equal) link with nothing.  Copies of a vector link with
    each other.  component_id is the smallest vec_id that links reach, null
    only if all are null; a null vec_id is kept if its component has no other.
    Of repeated rows with the same vec_id all have the same `kept`.  An empty
    table has no rows.  No other column is read.

    The sample only places the cells.  Vectors without structure (random ones
    in many dimensions) are near every border: then few cells are used and the
    products inside them grow with the square of the rows.
    """
    spark, tables = vectors.sparkSession, Stored(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    lengths = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dims = most[0]["size"] if most else 1
    dtype = "<f4" if "float" in dict(rows.dtypes)["vector"] else "<f8"
    rows = rows.withColumn("vector", F.col("vector").cast("array<float>" if dtype == "<f4" else "array<double>"))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, own = usable_rows(batch.column("vector"), dims)
            h = digests(own)
            columns = [np.ma.masked_all(batch.num_rows, np.int64) for _ in range(2)]
            for k, c in enumerate(columns):
                c[good] = h[:, k]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(c.data, mask=np.ma.getmaskarray(c)) for c in columns)], ["vec_id", "h1", "h2"])

    named = tables(rows.mapInArrow(identify, "vec_id long, h1 long, h2 long"), "vector-rows")
    classes = named.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # The sample: the distinct vectors of the smallest digests, so that the cells are the same in every run.
    cut = [r["h1"] for r in classes.select("h1").orderBy("h1").limit(sample).collect()]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, own = usable_rows(batch.column(0), dims)
            for v in {v.tobytes() for v, h in zip(own, digests(own), strict=True) if h[0] <= cut[-1]}:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary())], ["vector"])

    some = rows.select("vector").mapInArrow(pick, "vector binary").distinct().orderBy("vector").collect() if cut else []
    drawn = np.frombuffer(b"".join(r["vector"] for r in some), dtype).reshape(-1, dims)
    total = named.count()
    centres = centres_of(unit(drawn), total, cosine, visits) if some else np.ones((1, dims))
    shared = spark.sparkContext.broadcast(centres)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """For each batch its distinct vectors with their digests, weights, homes and visits."""
        for batch in batches:
            _, own = usable_rows(batch.column(0), dims)
            if not len(own):
                continue
            _, first, weight = np.unique(own.view(np.dtype((np.void, own.itemsize * dims))).ravel(), return_index=True, return_counts=True)
            own = own[first]
            yield own, digests(own), weight, *reach(unit(own), shared.value, cosine)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((len(shared.value), 2), np.int64)
        for own, _, _, home, visited in homes(batches):
            met[:, 0] += np.bincount(home, minlength=len(met))
            met[:, 1] += visited.sum(0)
        cell = np.flatnonzero(met[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(met[cell, 0]), pa.array(met[cell, 1])], ["cell", "own", "guests"])

    # A row per cell. Copies in one batch count once, so a large group of copies makes no blocks.
    sizes = rows.select("vector").mapInArrow(measure, "cell int, own long, guests long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("guests").alias("guests"))
    grid = np.ones((len(centres), 2), np.int64)
    for r in sizes.collect():
        grid[r["cell"]] = -(-r["own"] // block), -(-r["guests"] // block)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, h, weight, home, visited in homes(batches):
            out = []
            high = grid[home, 0]
            at = h[:, 0] % high
            wide = np.maximum(high, grid[home, 1])
            for step in range(int(wide.max())):
                # Row members meet the columns' home members from their own block on, and all blocks of visitors.
                k = np.flatnonzero((step < wide) & ((step >= at) | (step < grid[home, 1])))
                out.append((k, home[k], at[k], np.full(len(k), step), 0))
                k = np.flatnonzero(step < at)
                out.append((k, home[k], np.full(len(k), step), at[k], 1))
            who, cell = np.nonzero(visited)
            column = h[who, 0] % grid[cell, 1]
            for step in range(int(grid[cell, 0].max()) if len(cell) else 0):
                k = np.flatnonzero(step < grid[cell, 0])
                out.append((who[k], cell[k], np.full(len(k), step), column[k], 2))
            for k, cell, i, j, role in out:
                if len(k):
                    ints = [pa.array(c, pa.int32()) for c in (cell, i, j, np.full(len(k), role))]
                    longs = [pa.array(c, pa.int64()) for c in (h[k, 0], h[k, 1], weight[k])]
                    data = pa.array([v.tobytes() for v in own[k]], pa.binary())
                    yield pa.RecordBatch.from_arrays([*ints, *longs, data], ["cell", "i", "j", "role", "h1", "h2", "weight", "vector"])

    placed = rows.select("vector").mapInArrow(place, ROWS)
    found = tables(placed.groupBy("cell", "i", "j").applyInArrow(lambda t: block_links(t, dtype, cosine), LINKS), "vector-links")
    counts = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    nodes = tables(counts.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    ends = [nodes.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("node").alias(y)) for x, y in (("h", "a"), ("r", "b"))]
    edges = found.join(ends[0], ["h1", "h2"]).join(ends[1], ["r1", "r2"]).select("a", "b")
    joined = components(edges, tables).join(nodes, "node").join(classes, ["h1", "h2"])
    best = joined.groupBy("root").agg(F.min("least").alias("component"))
    linked = joined.join(best, "root").select("h1", "h2", "component", (F.col("links") + F.col("n") - 1).alias("links"))
    # Classes of one row without links are left out: their rows answer for themselves.
    alone = classes.where("n > 1").join(linked, ["h1", "h2"], "left_anti").select("h1", "h2", F.col("least").alias("component"), (F.col("n") - 1).alias("links"))
    answers = store(linked.unionByName(alone), "vector-answers")
    tables.drop("vector-links", "vector-nodes", "links", "labels")
    shared.unpersist()
    whole = named.join(answers, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"),
    )
    return whole.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def without_near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """The rows of one vector of each group, that of the smallest vec_id, with all columns; see `near_vectors`.

    Rows without a vec_id stay if one of them has no other vec_id in its group.
    """
    kept = near_vectors(vectors, vec_id, vector, cosine).where("kept").select(F.col("vec_id").alias("kept_id")).distinct()
    return vectors.join(kept, vectors[vec_id].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")


ship_by_value(__name__)
