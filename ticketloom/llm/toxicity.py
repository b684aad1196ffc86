"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary text.

Each class has a word bigram model that backs off to the continuation counts
of words, these to the continuation counts of word stems, and both classes
back off to the same exact counts of all documents: a rare expression that
neither class knows weighs nothing.  A document's score comes from the difference of
its two log-likelihoods per word, over the whole text and over its strongest
words, so that a few toxic words count in a long text as well; labelled rows
that the models did not learn from map both to a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import counted, hashed_words, mixed, text_blocks, text_of
from ticketloom.session import ship_by_value, spread

# Labelled rows of each class that the models and the map to probabilities learn from.
MODEL_ROWS = 20000
SCALE_ROWS = 4000
STEM = 5
# Counts far below this one leave nearly all their mass to the shared counts, counts far above it nearly none.
RARE = 14.0
# Words of a text whose differences are also summed by themselves, the largest ones.
STRONGEST = 3

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
# Counts of the sample are gathered in so many parts, after so many words of a task.
PART_BITS = 6
HELD = 1 << 21


def tokens_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of words and of their stems, and each text's bounds, for one block of texts after the other.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.
    """
    for _, data, offsets in text_blocks(texts):
        starts, words, stems = hashed_words(data, WORD_BYTES[data], STEM)
        yield words, stems, np.searchsorted(starts, offsets)


def discount(n):
    """What a count loses to its backoff: nearly all of a small one, never the whole of it; of an array or a column."""
    return n / ((n / RARE) ** 4 + 1)


def find(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted hashes in a sorted array, and whether they are there."""
    if not len(names):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


def count_shared(texts: DataFrame, words: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """How often each of the sorted words and stems occurs in all texts, exactly, and the number of all words."""
    names = texts.sparkSession.sparkContext.broadcast((words, stems))

    def places(part: list[str | None]) -> Iterator[np.ndarray]:
        own_words, own_stems = names.value
        for met, met_stems, _ in tokens_of(part):
            at, known = find(own_words, met)
            yield np.where(known, at, len(own_words))
            at, known = find(own_stems, met_stems)
            yield np.where(known, at, len(own_stems)) + len(own_words) + 1

    counts = counted(texts, len(words) + len(stems) + 2, places)
    return counts[: len(words)], counts[len(words) + 1 : -1], int(counts[: len(words) + 1].sum())


def ids_before(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The id of the word before each word of a block; `start` before a text's first."""
    before = np.concatenate([[start], ids[:-1]])[: len(ids)].astype(np.int64)
    before[bounds[:-1][np.diff(bounds) > 0]] = start
    return before


def pair_of(keys: np.ndarray) -> np.ndarray:
    """Bigram numbers in an even order; different numbers stay different."""
    return mixed(keys.view(np.uint64))


class Models:
    """Both models as sorted arrays: every word, stem, bigram and context of the labelled texts, none left out.

    A word that neither class knows needs no shared count: it is the same factor in both probabilities.
    """

    def __init__(self, words: np.ndarray, stem_of: np.ndarray, pairs: np.ndarray, counts: list, seen: list, taken: list, types: list):
        """Sorted words and their stems; sorted bigrams; of both classes the counts of the bigrams, for every context (the
        last one is the start) their sums and the sums of their discounts, and the words' continuation counts.
        """
        self.words, self.pairs, self.bigrams = words, pairs, counts
        self.stems, stem_of_word = np.unique(stem_of, return_inverse=True)
        self.stem_of_word = stem_of_word.astype(np.int32)
        self.stem_part, self.stem_rest, self.word_part, self.word_rest = ([] for _ in range(4))
        for k in (0, 1):
            everything = max(types[k].sum(), 1)
            of_stems = np.bincount(self.stem_of_word, types[k], minlength=len(self.stems))
            for own, part_of, rest in ((of_stems, self.stem_part, self.stem_rest), (types[k], self.word_part, self.word_rest)):
                lost = discount(own)
                part_of.append((own - lost) / everything)
                rest.append(lost.sum() / everything if own.any() else 1.0)
        self.left = [np.where(n > 0, lost / np.maximum(n, 1), 1.0) for n, lost in zip(seen, taken, strict=True)]
        self.seen = [smallest(np.maximum(n, 1)) for n in seen]
        self.share_counts(np.ones(len(self.words)), np.ones(len(self.stems)), 1)

    def share_counts(self, word_counts: np.ndarray, stem_counts: np.ndarray, total: int) -> None:
        """The counts of all documents that both models back off to."""
        counts = np.maximum(stem_counts, 1)
        self.stem_share = counts / max(total, 1)
        self.within = np.maximum(word_counts, 1) / (counts[self.stem_of_word] if len(self.words) else 1)

    def differences(self, words: np.ndarray, stems: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the sum of log P(word | word before, toxic) - log P(word | word before, ordinary), and its largest terms' sum."""
        at, known = find(self.words, words)
        at_stem, known_stem = find(self.stems, stems)
        before = ids_before(np.where(known, at, -1), bounds, len(self.words))
        known_context = before >= 0
        context = np.maximum(before, 0)
        pair = np.flatnonzero(known & known_context)
        place, hit = find(self.pairs, pair_of(before[pair] * (len(self.words) + 1) + at[pair]))
        # Factors of 1 stand for shares that both probabilities have in common.
        stem_share, within = np.ones(len(words)), np.ones(len(words))
        stem_share[known_stem] = self.stem_share[at_stem[known_stem]]
        within[known] = self.within[at[known]]
        logs = []
        for k in (0, 1):
            p = self.stem_rest[k] * stem_share
            if len(self.stems):
                p = p + np.where(known_stem, self.stem_part[k][at_stem], 0)
            p = self.word_rest[k] * p * within
            if len(self.words):
                p = p + np.where(known, self.word_part[k][at], 0)
            p = p * np.where(known_context, self.left[k][context], 1)
            if len(self.pairs):
                n = self.bigrams[k][place[hit]].astype(np.float64)
                p[pair[hit]] += (n - discount(n)) / self.seen[k][context[pair[hit]]]
            logs.append(np.log(p))
        terms = logs[1] - logs[0]
        sums = np.concatenate([[0], np.cumsum(terms)])
        strongest = np.zeros(len(bounds) - 1)
        for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own = terms[low:high]
            strongest[i] = own.sum() if len(own) <= STRONGEST else np.partition(own, -STRONGEST)[-STRONGEST:].sum()
        return sums[bounds[1:]] - sums[bounds[:-1]], strongest


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers as planes of bytes of their differences: what is alike lies together for the shuffle's compression."""
    return np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel().cumsum()


def smallest(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs: tasks read them from a broadcast."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """One array of all parts; each part is freed as soon as it is copied."""
    whole = np.empty(sum(map(len, parts)), np.result_type(*parts))
    at = len(whole)
    while parts:
        last = parts.pop()
        whole[at - len(last) : at] = last
        at -= len(last)
    return whole


def first_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_index=True)
    return found, values[at]


def sum_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values, minlength=len(found)).astype(np.int64)


def gathered(rows: DataFrame, entries: Callable, merge: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Part, keys and values of the entries of labelled texts, merged by key; rows has text and label.

    Tasks merge what they hold before the shuffle; the driver takes one
    partition after the other.  A key's part are the first bits of `pair_of(key >> 1)`.
    """

    def parts_of(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, values = merge(*map(np.concatenate, zip(*held, strict=True)))
        part = (pair_of(keys >> 1) >> np.uint64(64 - PART_BITS)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        parts, first = np.unique(part[order], return_index=True)
        own = np.split(order, first[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array(parts), *[pa.array([packed(x[places]) for places in own], pa.binary()) for x in (keys, values)]], ["part", "keys", "counts"]
        )

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            labels, done = batch.column("label").to_numpy(), 0
            for words, stems, bounds in tokens_of(batch.column("text").to_pylist()):
                n = len(bounds) - 1
                held.append(entries(words, stems, bounds, np.repeat(labels[done : done + n], np.diff(bounds))))
                done, size = done + n, size + len(words)
                if size >= HELD:
                    yield parts_of(held)
                    held, size = [], 0
        if size:
            yield parts_of(held)

    def together(group):
        import pandas as pd

        keys, values = merge(*[np.concatenate([unpacked(x) for x in group[c]]) for c in ("keys", "counts")])
        return pd.DataFrame({"part": group["part"][:1], "keys": [packed(keys)], "counts": [packed(values)]})

    schema = "part int, keys binary, counts binary"
    found = rows.select("text", "label").mapInArrow(collect, schema).groupBy("part").applyInPandas(together, schema)
    for row in found.toLocalIterator():
        yield row["part"], unpacked(row["keys"]), unpacked(row["counts"])


def models_of(rows: DataFrame, texts: DataFrame) -> Models:
    """Models of a bounded sample of labelled texts, which comes to the driver as counted bigrams; shared counts of all texts.

    Words are numbered first, so that a bigram is one number, whose class is the last bit.
    """
    found = list(gathered(rows, lambda words, stems, *_: (words.view(np.int64), stems.view(np.int64)), first_of))
    words, stem_of = (np.concatenate([np.zeros(0, np.int64), *[x[c] for x in found]]).view(np.uint64) for c in (1, 2))
    order = np.argsort(words)
    words, stem_of = words[order], stem_of[order]
    names, start = rows.sparkSession.sparkContext.broadcast(words), len(words)

    def bigrams(own: np.ndarray, _, bounds: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, _ = find(names.value, own)
        return (ids_before(ids, bounds, start) * (start + 1) + ids) * 2 + labels, np.ones(len(ids), np.int64)

    seen, taken = ([np.zeros(start + 1) for _ in (0, 1)] for _ in range(2))
    types = [np.zeros(start) for _ in (0, 1)]
    pairs = [np.zeros(0, np.uint64)] * (1 << PART_BITS)
    counts = [[np.zeros(0, np.uint8)] * (1 << PART_BITS) for _ in (0, 1)]
    for part, codes, n in gathered(rows, bigrams, sum_of):
        keys, at = np.unique(codes >> 1, return_inverse=True)
        before, word = np.divmod(keys, start + 1)
        pair = pair_of(keys)
        order = np.argsort(pair)
        pairs[part] = pair[order]
        for k in (0, 1):
            own = np.bincount(at, n * (codes & 1 == k), minlength=len(keys))
            seen[k] += np.bincount(before, own, minlength=start + 1)
            taken[k] += np.bincount(before, discount(own), minlength=start + 1)
            types[k] += np.bincount(word, own > 0, minlength=start)
            counts[k][part] = smallest(own[order])
    names.destroy()
    seen = [n.astype(np.int64) for n in seen]
    models = Models(words, stem_of, joined(pairs), [joined(n) for n in counts], seen, taken, types)
    models.share_counts(*count_shared(texts, models.words, models.stems))
    return models


def with_features(texts: DataFrame, models, columns: dict[str, str]) -> DataFrame:
    """`columns` (name, type) of texts, words (how many), difference and strongest."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = models.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lengths, sums = [np.zeros(0, np.int64)], [np.zeros((2, 0))]
                for words, stems, bounds in tokens_of(part.column("text").to_pylist()):
                    lengths.append(np.diff(bounds))
                    sums.append(np.stack(own.differences(words, stems, bounds)))
                difference, strongest = np.concatenate(sums, 1)
                found = [pa.array(np.concatenate(lengths), pa.int64()), pa.array(difference), pa.array(strongest)]
                names = [*columns, "words", "difference", "strongest"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *found], names)

    schema = ", ".join([*[f"{c} {k}" for c, k in columns.items()], "words long", "difference double", "strongest double"])
    return texts.select("text", *columns).mapInArrow(measure, schema)


def features(words: np.ndarray, difference: np.ndarray, strongest: np.ndarray) -> np.ndarray:
    """A constant, the difference per word, and that of the strongest words."""
    return np.stack([np.ones(len(words)), difference / np.maximum(words, 1), strongest / STRONGEST], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps on scaled features."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, weights = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
        step = np.linalg.solve(hessian, z.T @ (y - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights / scale


def sampled(labelled: DataFrame, rows: int) -> DataFrame:
    """At most so many ids of each class, the same ones every time."""
    order = (F.xxhash64("doc_id"), "doc_id")
    return labelled.where("label = 1").orderBy(*order).limit(rows).union(labelled.where("label = 0").orderBy(*order).limit(rows))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, doc_id: str = "doc_id",
                   text: str = "text", model_rows: int = MODEL_ROWS, scale_rows: int = SCALE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Labelled rows whose crc32(doc_id) mod 5 is 0 are held out; those with 1
    map differences to probabilities, the others make the models, at most
    `scale_rows` and `model_rows` of each class; of their texts no word or
    bigram is left out.  The shared counts cover all documents.  Null and empty texts have a difference of 0 and score like
    it.  Null ids and null labels teach nothing; a null id is not held out.
    Repeated rows score alike; other columns are not read.  With labels of one
    class only, every score leans to it.
    """
    spark = docs.sparkSession
    texts = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & (fold != 0))
    # Bounded lists of ids.
    teach = texts.join(F.broadcast(sampled(own.where(fold != 1), model_rows)), "doc_id")
    models = spark.sparkContext.broadcast(models_of(teach, texts))
    check = texts.join(F.broadcast(sampled(own.where(fold == 1), scale_rows)), "doc_id")
    got = with_features(check, models, {"label": "int"}).toPandas()
    # Classes as rare as they are among the labels.
    share = own.agg(F.avg("label")).first()[0]
    y = got["label"].to_numpy().astype(float)
    weights = np.array([-2.0, 0.0, 0.0])
    if share is not None and 0 < y.sum() < len(y):
        weights = logistic(features(*(got[c].to_numpy() for c in ("words", "difference", "strongest"))), y)
        weights[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    elif share is not None:
        weights[0] = 2.0 if share > 0.5 else -2.0
    a, b, c = (float(x) for x in weights)
    n = F.greatest("words", F.lit(1)).cast("double")
    logit = F.lit(a) + b * F.col("difference") / n + c * F.col("strongest") / STRONGEST
    score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    scored = with_features(texts, models, {"doc_id": "long"}).withColumn("score", score)
    return scored.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


ship_by_value(__name__)
