"""Exact n-gram Jaccard join in the metric space of shingle sets, distance 1 - J.

Equal sets are one class.  Two classes within the link distance share one of
their rarest shingles (as many as sets of that size may lack), so the classes
that share such a shingle form a region around the most central of them, its
pivot; a class on the boundary of several regions is replicated to each.
Distances to the pivot settle the core of a region; what lies outside it is
joined again inside the region, pivot by pivot, and the triangle inequality
keeps a class out of every step whose window it misses.  Regions above a leaf
size are first split around their pivot and then joined in blocks.

"Rarest" needs one order of all shingles.  A sketch of fixed size, filled from
all documents, gives it; any order keeps the join exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import Stored, block_words, counted, mixed, store, text_blocks, with_row
from ticketloom.session import ship_by_value, spread

WIDTH = 5
PERCENT = 80
# Counters of the frequency sketch: 8 MB, whatever the input.
SKETCH = 1 << 20
# Bits of the filter that spares most documents without partners a second shuffle: 2 MB, whatever the input.
FILTER_BITS = 1 << 24
# Shingles of a region that one task joins.
LEAF = 1 << 18

# Factors without a pattern: a sum of words times them is the same for two arrangements of words only by chance.
ODD = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingle_lists(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Shingle hashes of each text in order; texts of fewer words have one, of all their words."""
    for _, data, offsets in text_blocks(texts):
        words, bounds = block_words(data, offsets)
        n = len(words) - width + 1
        if n > 0:
            sums = np.zeros(n, np.uint64)
            for k in range(width):
                sums += words[k : k + n] * ODD[k]
            shingles = mixed(sums)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high - low >= width:
                yield shingles[low : high - width + 1]
            elif high > low:
                few = words[low:high]
                yield mixed(np.atleast_1d((few * ODD[: len(few)]).sum(dtype=np.uint64) + np.uint64(len(few))))
            else:
                yield NONE


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for shingles in shingle_lists(texts, width):
        own = np.sort(shingles)
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


NONE = np.empty(0, np.uint64)


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (SKETCH.bit_length() - 1))).astype(np.int64)


def prefix_of(n: int, percent: int) -> tuple[int, int]:
    """How many of its rarest shingles sign a set of n, and how many of them it shares with any linked set at least.

    With n - ceil(percent * n / 100) + k shingles each, linked sets share k;
    half of what k = 1 takes is added.  The other set may be smaller, down to
    percent, and its k with it: that much is taken off what is asked for.
    """
    shortest = n + (-percent * n) // 100 + 1
    k = max(1, shortest // 2)
    return min(n, shortest + k - 1), max(1, percent * k // 100 - 1)


def class_of(shingles: np.ndarray, rarest: np.ndarray, frequency: np.ndarray) -> tuple[int, int]:
    """A set's identity.  The first number starts with its centrality: how common its rarest shingles are."""
    central = min(127, int(4 * np.log2(frequency + 1.0).mean())) if len(rarest) else 0
    digest = int(mixed(shingles * ODD[7]).sum(dtype=np.uint64))
    other = int(mixed(shingles ^ ODD[9]).sum(dtype=np.uint64) ^ np.uint64(len(shingles)))
    return (central << 56) | (digest >> 8), other - (1 << 64) if other >= 1 << 63 else other


def rarest_of(shingles: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's rarest shingles and their frequencies, by (frequency, hash)."""
    frequency = sketch[slots(shingles)]
    take = np.argsort(frequency, kind="stable")[: prefix_of(len(shingles), percent)[0]]
    return shingles[take], frequency[take]


def signatures(texts: DataFrame, sketch, width: int, percent: int) -> DataFrame:
    """A row per document (key null; n: its shingles) and a row per rarest shingle of each class that a task meets
    (n: how many of them linked classes share)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = sketch.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                docs, keys, codes, needs = [], [], [], []
                for shingles in shingle_sets(part.column(0).to_pylist(), width):
                    if not len(shingles):
                        docs.append((0, 0, 0))
                        continue
                    rarest, frequency = rarest_of(shingles, counts, percent)
                    code, other = class_of(shingles, rarest, frequency)
                    docs.append((code, other, len(shingles)))
                    if (code, other) not in met:
                        keys.append(rarest)
                        codes.append(np.full(len(rarest), code, np.int64))
                        needs.append(np.full(len(rarest), prefix_of(len(shingles), percent)[1], np.int64))
                        if len(met) < 1 << 17:
                            met.add((code, other))
                key = np.concatenate([NONE, *keys]).view(np.int64)
                n, none = len(docs), len(key)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([part.column(1), pa.nulls(none, pa.int64())]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(key, pa.int64())]),
                        pa.array(np.concatenate([np.array([d[0] for d in docs], np.int64), *codes]), pa.int64()),
                        pa.concat_arrays([pa.array([d[1] for d in docs], pa.int64()), pa.nulls(none, pa.int64())]),
                        pa.array(np.concatenate([np.array([d[2] for d in docs], np.int64), *needs]), pa.int64()),
                    ],
                    ["doc_id", "key", "code", "other", "n"],
                )

    return texts.select("text", "doc_id").mapInArrow(sign, "doc_id long, key long, code long, other long, n long")


def wanted_sets(texts: DataFrame, sketch, bits, width: int, percent: int) -> DataFrame:
    """Whole shingle sets of the classes that the filter lets through, once per task at most times memory allows."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wanted, met = sketch.value, bits.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = []
                for shingles in shingle_sets(batch.slice(at, 512).column(0).to_pylist(), width):
                    if not len(shingles):
                        continue
                    code, other = class_of(shingles, *rarest_of(shingles, counts, percent))
                    bit = code % FILTER_BITS
                    if wanted[bit >> 3] >> (bit & 7) & 1 and (code, other) not in met:
                        found.append((code, other, shingles.tobytes()))
                        if len(met) < 1 << 17:
                            met.add((code, other))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                    ["code", "other", "shingles"],
                )

    return texts.select("text").mapInArrow(fetch, "code long, other long, shingles binary")


def filter_of(codes: DataFrame) -> np.ndarray:
    """The wanted classes as FILTER_BITS bits, gathered as words of 32 of them."""
    bit = F.pmod(F.col("code"), F.lit(FILTER_BITS))
    words = codes.groupBy(F.floor(bit / 32).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int"))).alias("bits")
    )
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    # At most FILTER_BITS / 32 rows, whatever the input.
    got = words.toPandas()
    filled[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return filled.view(np.uint8)


class Region:
    """Sets of a region over a common numbering of their shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        whole = np.concatenate([NONE, *sets])
        names, self.flat = np.unique(whole, return_inverse=True)
        self.mark = np.zeros(len(names), np.int32)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Shared shingles of set i with each of the others."""
        own = self.flat[self.starts[i] : self.starts[i + 1]]
        self.mark[own] = 1
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.starts[others] - (ends - sizes), sizes)
        shared = np.add.reduceat(self.mark[self.flat[places]], ends - sizes)
        self.mark[own] = 0
        return shared

    def fits(self, i: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(self.sizes[i], self.sizes[others]), np.maximum(self.sizes[i], self.sizes[others])
        return 100 * small >= self.percent * large

    def links(self, first: np.ndarray | None = None, distance: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join the same sets as all links do: those of each set with sets it isn't joined to yet.

        `first`: the sets that are pivots here, all by default, in this order.
        `distance`: each set's distance to the region's pivot, for the windows.
        """
        n = len(self.sizes)
        joined, open_, found = np.arange(n), np.ones(n, bool), []
        for turn, i in enumerate(range(n) if first is None else first):
            open_[i] = False
            others = np.flatnonzero(open_ & (joined != joined[i]))
            if not len(others):
                continue
            if turn or distance is not None:
                others = others[self.fits(i, others)]
                if distance is not None:
                    # d(i, j) >= |d(i, pivot) - d(j, pivot)|
                    others = others[np.abs(distance[others] - distance[i]) <= 1 - self.percent / 100 + 1e-9]
                if not len(others):
                    continue
            shared = self.common(i, others)
            union = self.sizes[others] + self.sizes[i] - shared
            if not turn and distance is None:
                distance = np.zeros(n)
                distance[others] = 1 - shared / union
            for j in others[100 * shared >= self.percent * union]:
                found.append((int(i), int(j)))
                joined[joined == joined[j]] = joined[i]
        return found


EDGES = "code_a long, other_a long, code_b long, other_b long"


def region_links(group, percent: int, queries: bool = False):
    import pandas as pd

    group = group.drop_duplicates(["code", "other"]) if not queries else group.sort_values("outside", ascending=False).drop_duplicates(["code", "other"])
    group = group.sort_values(["code", "other"], ascending=False)
    region = Region([np.frombuffer(s, np.uint64) for s in group["shingles"]], percent)
    code, other = group["code"].to_numpy(), group["other"].to_numpy()
    if queries:
        links = region.links(np.flatnonzero(group["outside"].to_numpy()), group["distance"].to_numpy())
    else:
        links = region.links()
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"code_a": code[a], "other_a": other[a], "code_b": code[b], "other_b": other[b]})


def split_links(members: DataFrame, sizes: DataFrame, percent: int, leaf: int, store: Stored) -> DataFrame:
    """Links of regions above the leaf size: distances to the pivot, then the outside against all, in blocks."""
    # The most central member is the centre: the pivot itself unless it left its region.
    centres = members.groupBy("pivot").agg(F.max(F.struct("code", "other")).alias("at"))
    centres = centres.select("pivot", F.col("at.code").alias("code"), F.col("at.other").alias("other"))
    pivots = members.join(centres, ["pivot", "code", "other"]).select(
        "pivot", F.struct("code", "other", "shingles").alias("centre")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("shingles").to_pylist(), batch.column("centre").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - shared
                out.append((100 * shared >= percent * union, 1 - shared / union))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.float64())],
                ["pivot", "code", "other", "code_p", "other_p", "shingles", "linked", "distance"],
            )

    both = members.join(pivots, "pivot").select(
        "pivot", "code", "other", F.col("centre.code").alias("code_p"), F.col("centre.other").alias("other_p"), "shingles",
        F.col("centre.shingles").alias("centre"),
    )
    schema = "pivot long, code long, other long, code_p long, other_p long, shingles binary, linked boolean, distance double"
    measured = store(both.mapInArrow(measure, schema), "jaccard-distances")
    to_pivot = measured.where("linked AND NOT (code = code_p AND other = other_p)").select(
        F.col("code_p").alias("code_a"), F.col("other_p").alias("other_a"), F.col("code").alias("code_b"), F.col("other").alias("other_b")
    )
    length = F.octet_length("shingles") / 8
    outside = measured.where("NOT linked").groupBy("pivot").agg(F.sum(length).alias("out_weight"))
    blocks = F.ceil(2 * F.col("weight") / leaf).cast("int").alias("n_all"), F.ceil(2 * F.col("out_weight") / leaf).cast("int").alias("n_out")
    grid = measured.join(sizes.join(outside, "pivot").select("pivot", *blocks), "pivot")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("code", "other"), F.col(n)).cast("int")
    columns = ("pivot", "code", "other", "shingles", "distance")
    cells = grid.where("NOT linked").select(*columns, own("n_out").alias("block"), up_to("n_all").alias("cell"), F.lit(True).alias("outside"))
    cells = cells.unionByName(grid.select(*columns, own("n_all").alias("cell"), up_to("n_out").alias("block"), F.lit(False).alias("outside")))
    inner = cells.groupBy("pivot", "block", "cell").applyInPandas(lambda g: region_links(g, percent, True), EDGES)
    return to_pivot.unionByName(inner)


def components(edges: DataFrame, store: Stored) -> DataFrame:
    """node, root for every node of the edges (a, b): roots are the smallest nodes, found by doubling hops."""
    edges = store(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = store(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        step = labels.join(near, F.col("a") == F.col("node")).join(jump, "root").select(
            "node", F.least("root", "near", "jump").alias("root"), (F.least("near", "jump") < F.col("root")).alias("moved")
        )
        step = store(step, "labels")
        if not step.where("moved").limit(1).count():
            return step.drop("moved")
        labels = step.drop("moved")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                       percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`.

    Words are runs of non-white-space, A-Z in lower case.  Two rows link when
    100 * shared >= percent * all of their distinct shingles; component_id is
    the smallest doc_id that links reach.  Null, empty and blank texts have no
    shingles and are their own component; texts of fewer than `width` words
    have one shingle.  Repeated rows link with each other; a null doc_id is
    never the smallest unless all of a component are null.  No other column is
    read; an empty table has no rows.  The join is exact unless two different
    shingles or words have the same 64-bit hash.
    """
    spark = docs.sparkSession
    tables = Stored(spark)
    texts = spread(docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id")))
    sketch = spark.sparkContext.broadcast(counted(texts, SKETCH, lambda part: (slots(s) for s in shingle_lists(part, width))))
    signed = tables(signatures(texts, sketch, width, percent), "signatures")
    rows = store(signed.where("key IS NULL").drop("key"), "jaccard-rows")
    # One shuffle by shingle serves both the pivots and the members. Copies of a class met once per task, and frequent
    # shingles come last in every set's order, so a key's rows are few.
    keys = signed.where("key IS NOT NULL").select("key", "code", F.col("n").alias("need")).repartition("key")
    shared = keys.groupBy("key").agg(F.max("code").alias("pivot"), F.min("code").alias("low")).where("pivot <> low").drop("low")
    hits = keys.join(shared, "key").groupBy("pivot", "code").agg(F.count_distinct("key").alias("hits"), F.max("need").alias("need"))
    hits = tables(hits, "hits")
    tables.drop("signatures")
    # A class that shares fewer of its shingles than any link needs has none. One that shares enough can leave the
    # regions that see the fewest of them: linked classes have a shingle in common beyond what both leave out.
    own = Window.partitionBy("code")
    lowest = own.orderBy("hits", "pivot").rowsBetween(Window.unboundedPreceding, 0)
    kept = hits.withColumn("all", F.sum("hits").over(own)).withColumn("left_out", F.sum("hits").over(lowest))
    kept = kept.where("all >= need AND left_out > floor((need - 1) / 2)")
    regions = kept.select("pivot", "code")
    # The pivot of a region may have left it itself; a region of one class has no links.
    peopled = regions.groupBy("pivot").count().where("count > 1").select("pivot")
    regions = tables(regions.join(peopled, "pivot"), "regions")
    tables.drop("hits")
    # One row per class; the smallest doc_id of each.
    classes = tables(rows.where("n > 0").groupBy("code", "other").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")), "classes")
    sizes = tables(regions.join(classes, "code").groupBy("pivot").agg(F.sum("n").alias("weight")), "sizes")
    bits = spark.sparkContext.broadcast(filter_of(regions))
    sets = wanted_sets(texts, sketch, bits, width, percent).repartition("code").dropDuplicates(["code", "other"])
    large = sizes.where(F.col("weight") > leaf)
    placed = regions.join(sizes, "pivot").join(sets, "code")
    columns = ("pivot", "code", "other", "shingles")
    small = placed.where(F.col("weight") <= leaf).select(*columns)
    links = small.groupBy("pivot").applyInPandas(lambda g: region_links(g, percent), EDGES)
    if large.limit(1).count():
        wide = tables(placed.where(F.col("weight") > leaf).select(*columns), "large")
        links = links.unionByName(split_links(wide, large, percent, leaf, tables))
    links = tables(links, "found")
    tables.drop("large", "jaccard-distances")
    ends = links.select(F.col("code_a").alias("code"), F.col("other_a").alias("other"))
    ends = ends.union(links.select("code_b", "other_b")).distinct()
    nodes = tables(ends.withColumn("node", F.monotonically_increasing_id()), "nodes")
    a, b = (nodes.select(F.col("code").alias(f"code_{x}"), F.col("other").alias(f"other_{x}"), F.col("node").alias(x)) for x in "ab")
    edges = links.join(a, ["code_a", "other_a"]).join(b, ["code_b", "other_b"]).select("a", "b")
    rooted = components(edges, tables).join(nodes, "node").select("code", "other", "root")
    linked = classes.join(rooted, ["code", "other"])
    best = linked.groupBy("root").agg(F.min("least").alias("component"))
    # Classes with links, or with more than one row; all other rows are alone.
    named = linked.join(best, "root").select("code", "other", F.col("component").alias("component_id"))
    alone = classes.join(rooted, ["code", "other"], "left_anti").select("code", "other", F.col("least").alias("component_id"))
    named = store(named.unionByName(alone), "jaccard-components")
    tables.drop()
    return rows.join(named, ["code", "other"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group of linked ones, all columns kept: the smallest doc_id, null last, then the first row.

    Null, empty and blank texts all stay.  Columns of any name are carried
    along; an empty table stays empty.
    """
    rows = with_row(docs, "jaccard-documents", doc_id, text)
    groups = jaccard_components(rows, "row", "text", width, percent).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", F.col("doc_id").isNull().alias("no_id"), "doc_id")
    best = groups.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("no_id", "doc_id", "row")).alias("best"))
    stay = rows.join(best.select("best.row"), "row", "left_semi")
    return stay.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(docs.columns)])


ship_by_value(__name__)
