"""Decision trees on sparse rows: nodes of many rows meet as sums by feature, smaller ones are grown where their rows meet.

The same trees as MLlib's (Gini, up to 32 quantile bins, first of equal splits),
which keeps a bin of every feature for every row and a full table of features
and bins for every node.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.boosting import _all_thresholds, _entries
from ticketloom.session import ship_by_value

ship_by_value(__name__)

# Most rows of one task, while there are tasks for all cores: each task sends the cells that its rows touch.
ROWS_PER_TASK = 50_000
# Nodes of up to so many rows, and of about so many entries, are grown to their leaves by one task.
LOCAL_ROWS = 20_000
LOCAL_ENTRIES = 2_000_000
# Features of one part of a histogram, and most cells (of nodes, bins and classes) that one task sums.
PART_FEATURES = 256
PART_CELLS = 4_000_000
# Entries that a task handles at a time when it grows nodes to their leaves.
ENTRIES_AT_A_TIME = 500_000


@dataclass
class Bins:
    """Split points of all features, and the bin of zero of each; a code is feature * width + bin."""

    points: np.ndarray

    def __post_init__(self):
        self.size, self.width = len(self.points), self.points.shape[1] + 1
        self.zero = (self.points < 0).sum(axis=1)
        self.code = np.int32 if self.size * self.width < 1 << 31 else np.int64


@dataclass
class Rows:
    """Labels, and the entries out of the bin of zero in order of code; between tasks, a tuple of the three."""

    labels: np.ndarray
    codes: np.ndarray
    row: np.ndarray

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.labels, self.codes, self.row


@dataclass
class Tree:
    """(feature, split) and rows of each class by node; the children of node i are 2 * i + 1 and 2 * i + 2."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    counts: dict[int, np.ndarray] = field(default_factory=dict)

    def split(self, nodes: Sequence[int], best: Best, depth: int) -> list[int]:
        """Split the nodes that gain by it; the children that may be split again."""
        grown = []
        for slot in np.flatnonzero(best.gain > 0):
            node = nodes[slot]
            self.splits[node] = int(best.feature[slot]), int(best.split[slot])
            left = best.left[slot].copy()
            for child, own in ((2 * node + 1, left), (2 * node + 2, self.counts[node] - left)):
                self.counts[child] = own
                if _open(child, own, depth):
                    grown.append(child)
        return grown


def _open(node: int, counts: np.ndarray, depth: int) -> bool:
    return (node + 1).bit_length() - 1 < depth and np.count_nonzero(counts) > 1


def _rows(part: Iterator, bins: Bins) -> Rows:
    labels, features, values = [], [], []
    for vector, label in part:
        feature, value = _entries(vector)
        labels.append(int(label))
        features.append(feature)
        values.append(value)
    if not labels:
        return Rows(np.empty(0, np.int64), np.empty(0, bins.code), np.empty(0, np.int32))
    row = np.repeat(np.arange(len(labels), dtype=np.int32), [len(f) for f in features])
    feature, value = np.concatenate(features), np.concatenate(values)
    del features, values
    if not np.isfinite(value).all():
        raise ValueError("features must be finite")
    order = np.argsort(feature, kind="stable")
    feature, value, row = feature[order], value[order], row[order]
    starts = np.flatnonzero(np.diff(feature, prepend=-1))
    level = np.empty(len(feature), np.int64)
    for start, end in zip(starts, [*starts[1:], len(feature)]):
        level[start:end] = np.searchsorted(bins.points[feature[start]], value[start:end])
    away = level != bins.zero[feature]
    codes, row = (feature[away].astype(np.int64) * bins.width + level[away]).astype(bins.code), row[away]
    order = np.argsort(codes, kind="stable")
    return Rows(np.array(labels, np.int64), codes[order], row[order])


def _slots(place: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
    """Position of each row's node among the sorted nodes, -1 where it is not one of them."""
    if not len(nodes):
        return np.full(len(place), -1)
    known = np.asarray(nodes, np.int64)
    at = np.minimum(np.searchsorted(known, place), len(known) - 1)
    return np.where(known[at] == place, at, -1)


def _moved(rows: Rows, place: np.ndarray, splits: list[tuple[int, int, int]], bins: Bins) -> np.ndarray:
    """Nodes of the rows after (node, feature, split) have been split, in order of node."""
    slot = _slots(place, [node for node, _, _ in splits])
    with_zero = np.array([bins.zero[feature] > split for _, feature, split in splits], bool)
    inside = slot >= 0
    after = place.copy()
    # Rows without an entry go where zero goes; entries on the other side of the split send theirs there.
    after[inside] = 2 * place[inside] + 1 + with_zero[slot[inside]]
    for k, (node, feature, split) in enumerate(splits):
        edges = [0, split + 1] if with_zero[k] else [split + 1, bins.width]
        other = rows.row[slice(*np.searchsorted(rows.codes, [feature * bins.width + e for e in edges]))]
        after[other[slot[other] == k]] = 2 * node + 1 + (not with_zero[k])
    return after


def _places(rows: Rows, levels: list, bins: Bins) -> np.ndarray:
    place = np.zeros(len(rows.labels), np.int64)
    for splits in levels:
        place = _moved(rows, place, splits, bins)
    return place


def _cells(rows: Rows, slot: np.ndarray, part: slice, bins: Bins, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (slot, code) as one number, and rows of each class, of the entries of a part of the codes."""
    codes, row = rows.codes[part], rows.row[part]
    own = slot[row]
    wanted = own >= 0
    codes, row, own = codes[wanted], row[wanted], own[wanted]
    order = np.argsort(own.astype(np.uint16) if len(own) and own.max() < 1 << 16 else own, kind="stable")
    keys = own[order] * (bins.size * bins.width) + codes[order]
    first = np.diff(keys, prepend=-1) != 0
    group = np.cumsum(first) - 1
    keys = keys[first]
    counts = np.bincount(group * classes + rows.labels[row[order]], minlength=len(keys) * classes)
    return keys, counts.reshape(-1, classes)


def _gini(counts: np.ndarray) -> np.ndarray:
    # In the order of MLlib, so that equal splits are equal in the last digit as well.
    total, impurity = counts.sum(axis=1), np.ones(len(counts))
    for own in counts.T:
        impurity -= (own / total) ** 2
    return impurity


@dataclass
class Best:
    """Best split of each of some nodes; a gain of 0 where there is none."""

    gain: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray

    @classmethod
    def none(cls, nodes: int, classes: int) -> Best:
        return cls(np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros((nodes, classes), np.int64))

    def add(self, slot: np.ndarray, gain: np.ndarray, feature: np.ndarray, split: np.ndarray, left: np.ndarray) -> None:
        """Take over what is better; of equal gains the smaller feature stays."""
        old = self.gain[slot]
        better = (gain > old) | ((gain == old) & (feature < self.feature[slot]) & (gain > 0))
        at = slot[better]
        self.gain[at], self.feature[at], self.split[at], self.left[at] = gain[better], feature[better], split[better], left[better]


def _best(keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, bins: Bins) -> tuple:
    """(slot, gain, feature, split, rows of each class on the left) of the best split of every slot with cells."""
    group = keys // bins.width
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    if len(starts):
        # Rows of a node that are in no cell of a feature are in the bin of zero.
        rest = totals[group[starts] // bins.size] - np.add.reduceat(counts, starts)
        some = rest.any(axis=1)
        own = group[starts][some]
        zeros = own * bins.width + bins.zero[own % bins.size]
        at = np.searchsorted(keys, zeros)
        keys, counts = np.insert(keys, at, zeros), np.insert(counts, at, rest[some], axis=0)
        group = keys // bins.width
    first = np.diff(group, prepend=-1) != 0
    # A split after the last bin of a feature leaves nothing on the right.
    inner = np.r_[~first[1:], False][: len(keys)]
    sums = np.cumsum(counts, axis=0)
    left = (sums - (sums - counts)[first][np.cumsum(first) - 1])[inner]
    keys, group = keys[inner], group[inner]
    slot = group // bins.size
    total = totals[slot]
    right, n = total - left, total.sum(axis=1)
    gain = _gini(totals)[slot] - left.sum(axis=1) / n * _gini(left) - right.sum(axis=1) / n * _gini(right)
    starts = np.flatnonzero(np.diff(slot, prepend=-1))
    if not len(starts):
        return slot, gain, group, keys, left
    most = np.maximum.reduceat(gain, starts)
    top = np.flatnonzero(gain == np.repeat(most, np.diff([*starts, len(slot)])))
    top = top[np.diff(slot[top], prepend=-1) != 0]
    return slot[top], gain[top], group[top] % bins.size, keys[top] % bins.width, left[top]


def _grown(rows: Rows, place: np.ndarray, tree: Tree, bins: Bins, depth: int) -> Tree:
    """All that grows from the nodes of the tree, whose rows are all here."""
    nodes, classes = sorted(tree.counts), len(next(iter(tree.counts.values())))
    edges = np.unique(rows.codes[::ENTRIES_AT_A_TIME] // bins.width * bins.width)
    cuts = np.searchsorted(rows.codes, [*edges, bins.size * bins.width])
    while nodes:
        slot, best = _slots(place, nodes), Best.none(len(nodes), classes)
        totals = np.array([tree.counts[node] for node in nodes])
        for start, end in zip(cuts, cuts[1:]):
            best.add(*_best(*_cells(rows, slot, slice(start, end), bins, classes), totals, bins))
        parents, nodes = nodes, sorted(tree.split(nodes, best, depth))
        place = _moved(rows, place, [(node, *tree.splits[node]) for node in parents if node in tree.splits], bins)
    return tree


@dataclass(frozen=True)
class SparseTree:
    """Estimator: one Gini tree, whose large nodes grow level by level on all tasks and whose small ones each in one.

    The sums of a level meet by feature, and only the best split of each large
    node goes to the driver; entries move once, when a node has become small.
    """

    features: str = "features"
    label: str = "label_index"
    depth: int = 30
    seed: int = 42

    def fit(self, df: DataFrame) -> TreeModel:
        if not 0 <= self.depth <= 30:
            raise ValueError("depth must be 0 to 30")
        context = df.sparkSession.sparkContext
        rows = df.select(self.features, self.label).rdd.map(tuple)
        size, n, last = rows.map(lambda r: (len(r[0]), 1, int(r[1]))).reduce(lambda a, b: (a[0], a[1] + b[1], max(a[2], b[2])))
        wanted = max(context.defaultParallelism, -(-n // ROWS_PER_TASK))
        rows = rows.coalesce(wanted) if rows.getNumPartitions() > wanted else rows
        found = _all_thresholds(rows, n, self.seed)
        points = np.full((size, max(map(len, found.values()), default=0)), np.inf)
        for f, p in found.items():
            points[f, : len(p)] = p
        bins, classes = Bins(points), last + 1
        shared = context.broadcast(points)
        blocks = rows.mapPartitions(lambda part: [_rows(part, Bins(shared.value)).arrays()]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sizes = blocks.map(lambda b: (np.bincount(b[0], minlength=classes), len(b[1])))
            counts, entries = sizes.reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
            tree = self._grow(blocks, shared, bins, counts, min(LOCAL_ROWS, int(LOCAL_ENTRIES * n / max(entries, 1)) + 1))
        finally:
            blocks.unpersist()
        return TreeModel.of(tree, points, self.features)

    def _grow(self, blocks, shared, bins: Bins, counts: np.ndarray, local_rows: int) -> Tree:
        tree, levels, small = Tree(counts={0: counts}), [], []
        nodes = [0] if _open(0, counts, self.depth) else []
        while nodes:
            large = [node for node in nodes if tree.counts[node].sum() > local_rows]
            small += [node for node in nodes if tree.counts[node].sum() <= local_rows]
            if not large:
                break
            totals = np.array([tree.counts[node] for node in large])
            best = Best.none(len(large), len(counts))
            for found in self._summed(blocks, shared, bins, levels, large, totals).collect():
                best.add(*found)
            nodes = sorted(tree.split(large, best, self.depth))
            levels.append([(node, *tree.splits[node]) for node in large if node in tree.splits])
        if small:
            for grown in self._finished(blocks, shared, levels, tree, sorted(small), local_rows).collect():
                tree.splits |= grown[0]
                tree.counts |= grown[1]
        return tree

    @staticmethod
    def _summed(blocks, shared, bins: Bins, levels: list, large: list[int], totals: np.ndarray):
        """Best splits of the large nodes, by part of the features and group of nodes."""
        classes, cells, n_parts = totals.shape[1], PART_FEATURES * bins.width, -(-bins.size // PART_FEATURES)
        together = max(1, PART_CELLS // (cells * totals.shape[1]))
        n_groups = -(-len(large) // together)

        def send(block):
            rows, bins = Rows(*block), Bins(shared.value)
            slot = _slots(_places(rows, levels, bins), large)
            for part in range(n_parts):
                low = part * cells
                near = slice(*np.searchsorted(rows.codes, [low, low + cells]))
                keys, counts = _cells(rows, slot, near, bins, classes)
                own, codes = np.divmod(keys, bins.size * bins.width)
                counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))
                cuts = np.searchsorted(own, np.arange(n_groups + 1) * together)
                for group, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    if start < end:
                        cell = (own[start:end] - group * together) * cells + codes[start:end] - low
                        yield group * n_parts + part, (cell.astype(np.int32), counts[start:end])

        def meet(pairs):
            bins, met = Bins(shared.value), {}
            for index, (cell, counts) in pairs:
                if index not in met:
                    nodes = min(together, len(totals) - index // n_parts * together)
                    met[index] = np.zeros((nodes * cells, classes), np.int64)
                met[index][cell] += counts
            for index, sums in met.items():
                group, part = divmod(index, n_parts)
                cell = np.flatnonzero(sums.any(axis=1))
                keys = cell // cells * (bins.size * bins.width) + part * cells + cell % cells
                slot, *found = _best(keys, sums[cell], totals[group * together :][:together], bins)
                yield slot + group * together, *found

        return blocks.flatMap(send).partitionBy(n_groups * n_parts, lambda index: index).mapPartitions(meet)

    def _finished(self, blocks, shared, levels: list, tree: Tree, small: list[int], local_rows: int):
        """What grows from the small nodes, those of a group in one task."""
        sizes = np.array([tree.counts[node].sum() for node in small])
        groups, filled, last = np.zeros(len(small), np.int64), 0, 0
        for i in np.argsort(-sizes, kind="stable"):
            if filled and filled + sizes[i] > local_rows:
                filled, last = 0, last + 1
            groups[i], filled = last, filled + sizes[i]
        starts, depth = [tree.counts[node] for node in small], self.depth

        def send(block):
            rows = Rows(*block)
            place = _places(rows, levels, Bins(shared.value))
            slot = _slots(place, small)
            group = np.where(slot < 0, -1, groups[slot])
            own = group[rows.row]
            by_row, by_entry = np.argsort(group, kind="stable"), np.argsort(own, kind="stable")
            rank = np.empty(len(group), np.int32)
            row_cuts = np.searchsorted(group[by_row], np.arange(last + 2))
            entry_cuts = np.searchsorted(own[by_entry], np.arange(last + 2))
            for g in range(last + 1):
                here = by_row[row_cuts[g] : row_cuts[g + 1]]
                if len(here):
                    rank[here] = np.arange(len(here))
                    entries = by_entry[entry_cuts[g] : entry_cuts[g + 1]]
                    yield g, (place[here], rows.labels[here], rows.codes[entries], rank[rows.row[entries]])

        def finish(pairs):
            met = {}
            for g, piece in pairs:
                met.setdefault(g, []).append(piece)
            for g, pieces in met.items():
                places, labels, codes, row = zip(*pieces)
                offsets = np.cumsum([0, *map(len, places)])
                codes, row = np.concatenate(codes), np.concatenate([own + at for own, at in zip(row, offsets)])
                order = np.argsort(codes, kind="stable")
                rows = Rows(np.concatenate(labels), codes[order], row[order])
                begun = Tree(counts={small[i]: starts[i] for i in np.flatnonzero(groups == g)})
                grown = _grown(rows, np.concatenate(places), begun, Bins(shared.value), depth)
                yield grown.splits, grown.counts

        return blocks.flatMap(send).partitionBy(last + 1, lambda g: g).mapPartitions(finish)


NODES = "node int, feature int, threshold double, left int, right int, counts array<double>"


class TreeModel(Model, MLWritable, MLReadable):
    """Nodes in order from the root; adds ``rawPrediction`` (training rows of the leaf), ``probability`` and ``prediction``."""

    def __init__(self, nodes: Sequence[tuple] = (), features: str = "features"):
        super().__init__()
        # (feature or -1, threshold, left, right, rows of each class)
        self.nodes, self.features = list(nodes), features

    @classmethod
    def of(cls, tree: Tree, points: np.ndarray, features: str) -> TreeModel:
        """Children of one mind become one leaf, as in MLlib."""
        whole = {}
        for node in sorted(tree.counts, reverse=True):
            children = (2 * node + 1, 2 * node + 2)
            prediction = int(np.argmax(tree.counts[node]))
            alike = node in tree.splits and whole[children[0]] == whole[children[1]] != -1
            whole[node] = (whole[children[0]] if alike else -1) if node in tree.splits else prediction
        found, waiting = [], [(0, None)]
        while waiting:
            node, parent = waiting.pop()
            if parent is not None:
                found[parent][3 if found[parent][2] >= 0 else 2] = len(found)
            counts = [float(c) for c in tree.counts[node]]
            if whole[node] >= 0:
                found.append([-1, 0.0, -1, -1, counts])
            else:
                feature, split = tree.splits[node]
                waiting += [(2 * node + 2, len(found)), (2 * node + 1, len(found))]
                found.append([feature, float(points[feature, split]), -1, -1, counts])
        return cls([tuple(node) for node in found], features)

    @property
    def numNodes(self) -> int:
        return len(self.nodes)

    @property
    def toDebugString(self) -> str:
        lines, waiting = [], [(0, 1, "")]
        while waiting:
            node, indent, said = waiting.pop()
            feature, threshold, left, right, counts = self.nodes[node]
            if said:
                lines.append(" " * (indent - 1) + said)
            if feature < 0:
                lines.append(" " * indent + f"Predict: {float(np.argmax(counts))}")
            else:
                waiting += [(right, indent + 1, f"Else (feature {feature} > {threshold})")]
                waiting += [(left, indent + 1, f"If (feature {feature} <= {threshold})")]
        return "\n".join(lines)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.nodes)

        def leaf(vector):
            nodes = shared.value
            feature, threshold, left, right, counts = nodes[0]
            while feature >= 0:
                feature, threshold, left, right, counts = nodes[left if vector[feature] <= threshold else right]
            return counts

        counted = dataset.withColumn("_counts", F.udf(leaf, "array<double>")(self.features))
        counts = F.col("_counts")
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return counted.withColumns({
            "rawPrediction": array_to_vector(counts),
            "probability": array_to_vector(F.transform(counts, lambda x: x / total)),
            "prediction": (F.array_position(counts, F.array_max(counts)) - 1).cast("double"),
        }).drop("_counts")

    def write(self) -> MLWriter:
        return TreeModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return TreeModelReader()


class TreeModelWriter(MLWriter):
    def __init__(self, model: TreeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"features": self.model.features})
        rows = [(i, *node) for i, node in enumerate(self.model.nodes)]
        self.sparkSession.createDataFrame(rows, NODES).write.parquet(os.path.join(path, "data"))


class TreeModelReader(MLReader):
    def load(self, path: str) -> TreeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.schema(NODES).parquet(os.path.join(path, "data")).orderBy("node").collect()
        model = TreeModel([tuple(row)[1:] for row in rows], metadata["features"])
        return model._resetUid(metadata["uid"])
