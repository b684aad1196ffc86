"""Quality classifier: a convolutional network over bytes, in numpy.

A document is cut into overlapping chunks that cover all of it.  Learned
filters over six neighbouring bytes run over each chunk; every filter keeps
its largest answer per chunk, and a document's chunks are combined by mean and
maximum into one probability.  The network is fitted on a bounded sample of
labelled rows; scoring is one pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import text_of
from ticketloom.session import ship_by_value, spread

CHUNK = 512
STEP = 448
WIDTH = 6
STRIDE = 2
FILTERS = 24
# Labelled rows of each class to learn from, by all of their chunks.
SAMPLE_ROWS = 2000
EPOCHS = 8


def chunks_of(data: bytes) -> np.ndarray:
    """A text's overlapping chunks, the last one filled up with zeros."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return padded[np.arange(n)[:, None] * STEP + np.arange(CHUNK)]


@dataclass
class Network:
    """`filters` holds, per byte offset and byte value, what each filter adds."""

    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    shift: float

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        return cls(filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.05, 2 * FILTERS).astype(np.float32), 0.0)

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """The largest answer of every filter per chunk, and the place of it."""
        n = (CHUNK - WIDTH) // STRIDE + 1
        best, places = [], []
        for at in range(0, len(chunks), 64):
            part = chunks[at : at + 64]
            answer = np.take(self.filters[0], part[:, 0 : STRIDE * n : STRIDE], axis=0)
            for k in range(1, WIDTH):
                answer += np.take(self.filters[k], part[:, k : k + STRIDE * n : STRIDE], axis=0)
            if where:
                places.append(answer.argmax(1))
            best.append(answer.max(1))
        return np.maximum(np.concatenate(best) + self.bias, 0), np.concatenate(places) if where else None

    def combined(self, pooled: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean and maximum of each document's chunks."""
        counts = np.diff(bounds)[:, None]
        return np.hstack([np.add.reduceat(pooled, bounds[:-1], axis=0) / counts, np.maximum.reduceat(pooled, bounds[:-1], axis=0)])

    def scores(self, chunks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        logits = self.combined(self.pooled(chunks)[0], bounds) @ self.weights + self.shift
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))


def fitted(documents: list[np.ndarray], labels: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Network:
    """Adam on the log loss, both classes with the same weight; a network without examples of both gives the labels' share."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0
        net.shift = 3.0 if len(labels) and labels[0] else 0.0 if not len(labels) else -3.0
        return net
    share = labels.mean()
    weight_of = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = {"filters": net.filters, "bias": net.bias, "weights": net.weights, "shift": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(documents))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            chunks = np.concatenate([documents[i] for i in batch])
            bounds = np.concatenate([[0], np.cumsum([len(documents[i]) for i in batch])])
            net.shift = float(params["shift"][0])
            pooled, places = net.pooled(chunks, where=True)
            combined = net.combined(pooled, bounds)
            p = 1 / (1 + np.exp(-np.clip(combined @ net.weights + net.shift, -30, 30)))
            g = ((p - labels[batch]) * weight_of[batch] / len(batch)).astype(np.float32)
            owner = np.repeat(np.arange(len(batch)), np.diff(bounds))
            top = np.maximum.reduceat(pooled, bounds[:-1], axis=0)[owner] == pooled
            into = g[owner][:, None] * (net.weights[:FILTERS] / np.diff(bounds)[owner][:, None] + net.weights[FILTERS:] * top)
            into *= pooled > 0
            grads = {"weights": combined.T @ g + 1e-4 * net.weights, "shift": np.array([g.sum()], np.float32), "bias": into.sum(0)}
            filters = np.zeros_like(net.filters)
            rows, cols = np.nonzero(into)
            begin = places[rows, cols] * STRIDE
            for k in range(WIDTH):
                np.add.at(filters[k], (chunks[rows, begin + k], cols), into[rows, cols])
            grads["filters"] = filters
            step += 1
            rate = 0.01 * (1 - 0.9 * step / (epochs * (len(order) // 64 + 1)))
            for k, v in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    net.shift = float(params["shift"][0])
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str, text: str) -> tuple[list[np.ndarray], np.ndarray]:
    """All chunks and the labels of at most `rows` labelled rows of each class that aren't held out, the same ones every time."""
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    order = (F.xxhash64("doc_id"), "doc_id")
    some = own.where("label = 1").orderBy(*order).limit(rows).union(own.where("label = 0").orderBy(*order).limit(rows))
    # At most 2 * rows ids.
    picked = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).join(F.broadcast(some), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [chunks_of(t.encode()).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(cuts, pa.binary())], ["doc_id", "label", "chunks"])

    got = picked.mapInArrow(cut, "doc_id long, label int, chunks binary").orderBy("doc_id", "chunks").limit(2 * rows).collect()
    return [np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in got], np.array([r["label"] for r in got], np.float32)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, doc_id: str = "doc_id",
                  text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Learns from the whole texts of at most `rows` labelled rows of each class
    whose crc32(doc_id) mod 5 isn't 0; null ids and null labels teach nothing, a null id is not held out.  Null and empty
    texts are one chunk of zeros.  Repeated rows score alike; other columns
    are not read.  With labels of one class only, every score leans to it.
    """
    net = fitted(*training_rows(docs, labels, label, rows, doc_id, text))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                scores = []
                cuts, bounds = [], [0]
                for t in [*part.column("text").to_pylist(), None]:
                    if cuts and (t is None or bounds[-1] > 512):
                        scores.append(network.scores(np.concatenate(cuts), np.array(bounds)))
                        cuts, bounds = [], [0]
                    if t is not None:
                        cuts.append(chunks_of(t.encode()))
                        bounds.append(bounds[-1] + len(cuts[-1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.concatenate(scores), pa.float64())], ["doc_id", "score"])

    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    scored = spread(lean).mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


ship_by_value(__name__)
