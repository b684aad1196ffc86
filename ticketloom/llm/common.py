"""What the corpus operators share: word patterns, stored intermediate tables and hashed words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.session import ship_by_value, work_path

# White space of all word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text between white space; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


# Paths of the tables that `store` has written; a caller that knows they are read no more may delete them.
LEFT: list[str] = []


def store(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    LEFT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)


class Stored:
    """Stored tables of one operator's run, which go as soon as what was made from them is stored itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = work_path(self.spark, f"llm-{name}")
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, all by default; no DataFrame that still reads them may be used again."""
        for name in names or list(self.paths):
            delete(self.spark, self.paths.pop(name, []))


def with_row(docs: DataFrame, name: str, doc_id: str, text: str) -> DataFrame:
    """Every column of `docs` as own_0, own_1, ... under a stored row number, with doc_id and text by these names."""
    stored = numbered(docs, name, **{f"own_{k}": F.col(f"`{c}`") for k, c in enumerate(docs.columns)})
    named = {"doc_id": doc_id, "text": text}
    return stored.withColumns({k: F.col(f"own_{docs.columns.index(c)}") for k, c in named.items()})


def numbered(docs: DataFrame, name: str, **columns: Column) -> DataFrame:
    """The given columns of every row under a row number, stored so that the number never changes."""
    picked = docs.select(*[c.alias(k) for k, c in columns.items()])
    return store(picked.withColumn("row", F.monotonically_increasing_id()), name)


def in_document_order(doc_id: str = "doc_id", row: str = "row") -> list[Column]:
    """Smallest doc_id first, null last, equal ids by row number."""
    return [F.col(doc_id).isNull(), F.col(doc_id), F.col(row)]


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        for name, base in (("up", MULTIPLIER), ("down", inverse)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.multiply.accumulate(powers)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hashed_words(data: np.ndarray, is_word: np.ndarray, stem: int = 0) -> tuple[np.ndarray, ...]:
    """Start positions and 64-bit hashes of the maximal runs of word bytes; with `stem`, also of their first bytes."""
    if not len(data):
        return np.empty(0, np.int64), *[np.empty(0, np.uint64)] * (2 if stem else 1)
    edges = np.flatnonzero(np.diff(is_word.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])

    def of(stops: np.ndarray) -> np.ndarray:
        return mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * MULTIPLIER)

    return (starts, of(ends), of(np.minimum(ends, starts + stem))) if stem else (starts, of(ends))


SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_blocks(texts: list[str | None], most: int = 4 << 20):
    """Runs of texts as lower-case bytes: (first index, bytes, start of each text), each text followed by a space."""
    block, first, size = [], 0, 0
    for i, text in enumerate([*texts, None]):
        if block and (i == len(texts) or size >= most):
            data = LOWER[np.frombuffer(b" ".join([*block, b""]), np.uint8)]
            yield first, data, np.cumsum([0] + [len(b) + 1 for b in block])
            block, first, size = [], i, 0
        if i < len(texts):
            block.append((text or "").encode())
            size += len(block[-1])


def block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, and the bounds of each text's words in them."""
    starts, hashes = hashed_words(data, ~SPACE_BYTES[data])
    return hashes, np.searchsorted(starts, offsets)


# Counters of one row when counts of a fixed number of slots are gathered.
SLOT_PART = 1 << 14


def counted(texts: DataFrame, slots: int, slots_of: Callable[[list[str | None]], Iterable[np.ndarray]]) -> np.ndarray:
    """How often each of a fixed number of slots occurs over all texts; `slots_of` gives the slots of each of a list.

    Tasks count for themselves and send only the slots that they met, sums go
    through two levels of tasks, and the driver gets the same few rows
    whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lane = np.zeros(slots, np.int64), 0
        for batch in batches:
            lane = batch.column(1)[0].as_py()
            for at in range(0, batch.num_rows, 512):
                total += np.bincount(np.concatenate([np.zeros(0, np.int64), *slots_of(batch.slice(at, 512).column(0).to_pylist())]), minlength=slots)
        met = np.flatnonzero(total)
        if len(met):
            parts, first = np.unique(met // SLOT_PART, return_index=True)
            own = np.split(met, first[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(parts, pa.int32()),
                    pa.array([lane] * len(parts), pa.int32()),
                    pa.array([(x % SLOT_PART).astype(np.uint16).tobytes() for x in own], pa.binary()),
                    pa.array([total[x].tobytes() for x in own], pa.binary()),
                ],
                ["part", "lane", "places", "counts"],
            )

    def add(group):
        import pandas as pd

        total = np.zeros(SLOT_PART, np.int64)
        for places, counts in zip(group["places"], group["counts"], strict=True):
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int64)
        met = np.flatnonzero(total)
        return pd.DataFrame(
            {"part": group["part"][:1], "lane": group["lane"][:1], "places": [met.astype(np.uint16).tobytes()], "counts": [total[met].tobytes()]}
        )

    schema = "part int, lane int, places binary, counts binary"
    parts = texts.select("text", (F.spark_partition_id() % 32).alias("lane")).mapInArrow(count, schema)
    sums = parts.groupBy("part", "lane").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema)
    found = np.zeros(slots, np.int64)
    for row in sums.collect():
        found[row["part"] * SLOT_PART + np.frombuffer(row["places"], np.uint16).astype(np.int64)] = np.frombuffer(row["counts"], np.int64)
    return found


ship_by_value(__name__)
