"""SentencePiece encoding and decoding over a relational lattice.

Texts fall into units that no piece reaches across: a run of spaces with what
follows it, line feeds and tabs by themselves, and letters apart from other
characters where the table allows it.  The frequent distinct units are
exploded into substrings of bounded length, which an equi-join with the piece
table turns into edges; edges are grouped by unit, and a higher-order
aggregate folds them into the unit's pieces: Viterbi for unigram tables (best
sum of scores), best merge first for BPE tables, whose scores are ranks and
not additive.  The folded units, a table of bounded size, travel to the texts,
which are read in place and encoded there in order; a unit that is not among
them is folded on the spot by a small helper, once per task as a rule.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm.common import let, store
from ticketloom.session import ship_by_value

SPACE = "▁"
# Longest unit that is folded: its cuts are the bits of a long.
LONGEST = 62
# Units that travel to the texts, the most frequent ones of at most LONGEST characters.
FREQUENT = 1 << 17
# Times a unit must occur in a task to be counted at all; this only picks the units that travel.
SEEN = 3
# Counters, and helped units, that a task holds at a time.
HELD = 1 << 19
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


@dataclass(frozen=True)
class Pieces:
    """A piece table: (id, piece, score) of the pieces that text can turn into, the ids of single bytes, and the kind."""

    rows: tuple[tuple[int, str, float], ...]
    bytes_at: int | None
    size: int
    kind: str = "bpe"
    unknown: int = 0

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        rows = tuple(
            (i, model.id_to_piece(i), model.get_score(i))
            for i in range(n)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        )
        found = [i for i in range(n) if model.is_byte(i)]
        return cls(rows, found[0] if found else None, n, kind, model.unk_id())

    @property
    def longest(self) -> int:
        return max((len(p) for _, p, _ in self.rows), default=1)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i, float(s)) for i, p, s in self.rows], "piece string, id int, score double")

    def bytes_of(self) -> list[bytes]:
        """UTF-8 of every id; the sign for spaces as a space."""
        text = {i: p.replace(SPACE, " ").encode() for i, p, _ in self.rows}
        if self.bytes_at is not None:
            text |= {self.bytes_at + b: bytes([b]) for b in range(256)}
        return [text.get(i, b"") for i in range(self.size)]

    def singles(self) -> Column:
        """The id of every one-character piece by code point, as far as the last; empty where there is none."""
        ids = {ord(p): str(i) for i, p, _ in self.rows if len(p) == 1}
        return F.split(F.lit(",".join(ids.get(c, "") for c in range(max(ids, default=0) + 1))), ",")


def unit_pattern(pieces: Pieces) -> str:
    """A pattern whose matches are the units of a text, in order: its parts are never joined by a piece."""
    words = re.compile(f"{SPACE}*([{LATIN}]+|[^{SPACE}{LATIN}]*)")
    if all(SPACE not in p.lstrip(SPACE) and words.fullmatch(p) for _, p, _ in pieces.rows):
        return f"{SPACE}*[{LATIN}]+|{SPACE}*[^{SPACE}{LATIN}\n\t]+|{SPACE}+|[\n\t]"
    return f"{SPACE}+[^{SPACE}\n\t]*|[\n\t]|[^{SPACE}\n\t]+"


def signed(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """The columns of `units`, and edges (rank, from, to, id) of two characters or more, best score first.

    A unit stays with its edges where it was: the table is broadcast and the
    grouping follows the units' own partitioning.  Units too long to fold get
    no edges.
    """
    size = F.char_length("unit")
    last = F.when(size <= LONGEST, size - 2).otherwise(-1)
    # A start beyond the unit keeps units without edges.
    starts = units.withColumn("from", F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))))
    ends = F.when(F.col("from") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.col("from") + 2, F.least(size, F.col("from") + longest)))
    spans = starts.withColumn("to", F.explode(ends))
    piece = F.when(F.col("from") >= 0, F.substring("unit", F.col("from") + 1, F.col("to") - F.col("from")))
    found = spans.withColumn("piece", piece).join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR from < 0")
    edge = F.when(F.col("id").isNotNull(), F.struct((-F.col("score")).alias("rank"), "from", "to", "id"))
    return found.groupBy(*units.columns).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def spans_by_merges(edges: Column, size: Column) -> Column:
    """The edges that best-merge-first leaves: the cuts of a unit are bits, a merge clears the one between two parts."""
    within = lambda e: bit(e["to"]) - bit(e["from"] + 1)
    ends = lambda e: bit(e["to"]) + bit(e["from"])
    masked = F.transform(edges, lambda e: F.struct(ends(e).alias("ends"), within(e).alias("within")))

    def merged(masks: Column) -> Column:
        def step(cuts: Column, _: Column) -> Column:
            fits = F.filter(
                masks, lambda m: (cuts.bitwiseAND(m["ends"]) == m["ends"]) & (F.bit_count(cuts.bitwiseAND(m["within"])) == 1)
            )
            return F.coalesce(let(F.get(fits, F.lit(0)), lambda m: cuts.bitwiseAND(F.bitwise_not(m["within"]))), cuts)

        most = F.least(size - 1, F.size(masks))
        return F.when(
            most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), bit(size + 1) - 1, step)
        ).otherwise(bit(size + 1) - 1)

    def left(cuts: Column) -> Column:
        return F.filter(edges, lambda e: (cuts.bitwiseAND(ends(e)) == ends(e)) & (cuts.bitwiseAND(within(e)) == 0))

    return let(let(masked, merged), left)


def spans_by_viterbi(edges: Column, size: Column, single: float) -> Column:
    """The edges of the path with the best sum of scores; single characters without an edge score `single`."""

    def step(best: Column, to: Column) -> Column:
        """best[k]: score of the best path to place k, and the start, end and id of its last edge."""
        alone = F.struct((F.get(best, to - 1)["rank"] - single).alias("rank"), (to - 1).alias("from"), to.alias("to"), F.lit(-1).alias("id"))
        ending = F.transform(
            F.filter(edges, lambda e: e["to"] == to),
            lambda e: F.struct((F.get(best, e["from"])["rank"] + e["rank"]).alias("rank"), e["from"].alias("from"), to.alias("to"), e["id"].alias("id")),
        )
        return F.concat(best, F.array(F.array_min(F.concat(F.array(alone), ending))))

    start = F.array(F.struct(F.lit(0.0).alias("rank"), F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(-1).alias("id")))
    best = F.aggregate(F.sequence(F.lit(1), size), start, step)

    def back(path: Column) -> Column:
        """Walk from the end; at[0] is the place reached."""
        none = F.slice(path, 1, 0)
        walked = F.aggregate(
            F.sequence(F.lit(1), size),
            F.struct(size.alias("at"), none.alias("taken")),
            lambda s, _: F.when(s["at"] <= 0, s).otherwise(
                let(F.get(path, s["at"]), lambda e: F.struct(e["from"].alias("at"), F.concat(s["taken"], F.array(e)).alias("taken")))
            ),
            lambda s: s["taken"],
        )
        return F.filter(walked, lambda e: e["id"] >= 0)

    return let(best, back)


def ids_of(unit: Column, spans: Column, pieces: Pieces) -> Column:
    """Ids in order: those of the spans, and between them characters by themselves, as pieces or as bytes."""

    def char_ids(at: Column, singles: Column) -> Column:
        char = F.substring(unit, at + 1, F.lit(1))

        def alone(known: Column) -> Column:
            hexed = F.hex(F.encode(char, "utf-8"))
            if pieces.bytes_at is None:
                fallback = F.array(F.lit(pieces.unknown))
            else:
                fallback = F.transform(
                    F.sequence(F.lit(1), F.length(hexed), F.lit(2)),
                    lambda k: F.conv(F.substring(hexed, k, F.lit(2)), 16, 10).cast("int") + pieces.bytes_at,
                )
            return F.when(F.coalesce(known, F.lit("")) == "", fallback).otherwise(F.array(known.cast("int")))

        return let(F.get(singles, F.ascii(char)), alone)

    def joined(own: Column) -> Column:
        parts = F.transform(own, lambda e: F.struct(e["from"].alias("at"), F.array(e["id"]).alias("ids")))
        covered = F.aggregate(own, F.lit(0).cast("long"), lambda a, e: a.bitwiseOR(bit(e["to"]) - bit(e["from"])))
        rest = let(
            covered, lambda c: F.filter(F.sequence(F.lit(0), F.char_length(unit) - 1), lambda k: c.bitwiseAND(bit(k)) == 0)
        )
        alone = let(
            pieces.singles(), lambda singles: F.transform(rest, lambda k: F.struct(k.alias("at"), char_ids(k, singles).alias("ids")))
        )
        return F.flatten(F.transform(F.sort_array(F.concat(parts, alone)), lambda p: p["ids"]))

    return let(spans, joined)


def merged(unit: str, ranks: dict[str, tuple[float, int]]) -> list[str]:
    """Best merge first: of the neighbours that make a piece, the best and first of them join, until none do."""
    parts = list(unit)
    if len(parts) > LONGEST:
        return merged_by_queue(parts, ranks)
    none = (float("inf"), -1)
    waiting = [ranks.get(a + b, none)[0] for a, b in zip(parts, parts[1:], strict=False)]
    while waiting and (best := min(waiting)) < none[0]:
        i = waiting.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del waiting[i]
        if i:
            waiting[i - 1] = ranks.get(parts[i - 1] + parts[i], none)[0]
        if i < len(waiting):
            waiting[i] = ranks.get(parts[i] + parts[i + 1], none)[0]
    return parts


def merged_by_queue(parts: list[str], ranks: dict[str, tuple[float, int]]) -> list[str]:
    """The same for long units: neighbours wait in a queue by rank and place."""
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    queue: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if 0 <= i and j < len(parts) and (whole := parts[i] + parts[j]) in ranks:
            heapq.heappush(queue, (ranks[whole][0], i, j, whole))

    for i in range(len(parts) - 1):
        offer(i)
    while queue:
        _, i, j, whole = heapq.heappop(queue)
        if not parts[i] or after[i] != j or not parts[j] or parts[i] + parts[j] != whole:
            continue
        parts[i], parts[j], after[i] = whole, "", after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p]


def best_path(unit: str, ranks: dict[str, tuple[float, int]], longest: int, single: float) -> list[str]:
    """Viterbi: the parts of the path with the best sum of scores; unknown characters score `single`."""
    best = [(0.0, 0)]
    for to in range(1, len(unit) + 1):
        found = [(best[to - 1][0] - single, to - 1)]
        for at in range(max(0, to - longest), to):
            if (piece := ranks.get(unit[at:to])) is not None:
                found.append((best[at][0] + piece[0], at))
        best.append(min(found))
    parts, to = [], len(unit)
    while to:
        parts.append(unit[best[to][1] : to])
        to = best[to][1]
    return parts[::-1]


def helper(pieces: Pieces) -> Callable[[str], bytes]:
    """The ids of a unit of any length, as 32-bit numbers in a row."""
    ranks, at, unknown = {p: (-s, i) for i, p, s in pieces.rows}, pieces.bytes_at, pieces.unknown
    longest, single, bpe = pieces.longest, lowest_score(pieces), pieces.kind == "bpe"

    def fold(unit: str) -> bytes:
        ids = []
        for p in merged(unit, ranks) if bpe else best_path(unit, ranks, longest, single):
            if p in ranks:
                ids.append(ranks[p][1])
            else:
                ids += [at + b for b in p.encode()] if at is not None else [unknown]
        return np.array(ids, "<i4").tobytes()

    return fold


def lowest_score(pieces: Pieces) -> float:
    return min((s for _, _, s in pieces.rows), default=0.0) - 10


def with_singles(edges: Column, pieces: Pieces) -> Column:
    """Edges with those of one character as well, for Viterbi."""
    single = [(i, p, s) for i, p, s in pieces.rows if len(p) == 1]
    if not single:
        return edges
    names = F.create_map(*[x for i, p, s in single for x in (F.lit(p), F.struct(F.lit(-s).alias("rank"), F.lit(i).alias("id")))])

    def edge(k: Column) -> Column:
        return let(
            F.try_element_at(names, F.substring(F.col("unit"), k + 1, F.lit(1))),
            lambda x: F.when(
                x.isNotNull(), F.struct(x["rank"].alias("rank"), k.alias("from"), (k + 1).alias("to"), x["id"].alias("id"))
            ),
        )

    return F.concat(edges, F.array_compact(F.transform(F.sequence(F.lit(0), F.char_length("unit") - 1), edge)))


def folded_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """`units` with the ids of distinct units; null for those too long to fold."""
    size = F.char_length("unit")
    placed = lattice(units, pieces.table(units.sparkSession), pieces.longest)
    if pieces.kind == "bpe":
        spans = spans_by_merges(F.col("edges"), size)
    else:
        spans = spans_by_viterbi(with_singles(F.col("edges"), pieces), size, lowest_score(pieces))
    return placed.withColumn("ids", F.when(size <= LONGEST, ids_of(F.col("unit"), spans, pieces))).drop("edges")


def unit_counts(texts: DataFrame, pieces: Pieces) -> DataFrame:
    """unit and times of the units that some task meets often enough; counted inside the tasks first."""
    pattern = unit_pattern(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(pattern).findall, Counter()

        def sent() -> pa.RecordBatch:
            often = [(u, n) for u, n in held.items() if n >= SEEN and len(u) <= LONGEST]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["unit", "times"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(find(signed(text or "")))
                if len(held) >= HELD:
                    yield sent()
        yield sent()

    found = texts.mapInArrow(count, "unit string, times long")
    return found.groupBy("unit").agg(F.sum("times").alias("times"))


def frequent_units(texts: DataFrame, pieces: Pieces, most: int = FREQUENT) -> dict[str, bytes]:
    """The ids of the most frequent units, folded over their lattice; at most `most` units of at most LONGEST characters."""
    top = unit_counts(texts, pieces).orderBy(F.desc("times"), "unit").limit(most)
    # The lattice is spread by unit; the limit leaves one partition.
    folded = folded_units(store(top, "units").repartition("unit"), pieces)
    return {r["unit"]: np.array(r["ids"], "<i4").tobytes() for r in folded.select("unit", "ids").collect()}


def encoded_texts(docs: DataFrame, pieces: Pieces, doc_id: str, text: str, frequent: int) -> DataFrame:
    """doc_id, n_units, the ids in order, the text that they decode to, and whether it is the text, of every row."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast((pieces, frequent_units(texts.select("text"), pieces, frequent)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, travelled = known.value
        find, fold, spelled = re.compile(unit_pattern(pieces)).findall, helper(pieces), pieces.bytes_of()

        class Units(dict):
            def __missing__(self, unit: str) -> bytes:
                if len(self) > len(travelled) + HELD:
                    self.clear()
                    self.update(travelled)
                ids = self[unit] = fold(unit)
                return ids

        ids_of = Units(travelled).__getitem__
        for batch in batches:
            # Long texts go in few rows at a time.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                counts, ids, back = [], [], []
                for text in texts:
                    units = find(signed(text or ""))
                    counts.append(len(units))
                    ids.append(np.frombuffer(b"".join(map(ids_of, units)), "<i4"))
                    whole = b"".join([spelled[i] for i in ids[-1].tolist()])
                    back.append(whole.removeprefix(b" ").decode("utf-8", "replace"))
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32)),
                        pa.array(back, pa.string()),
                        pa.array([a == (b or "") for a, b in zip(back, texts, strict=True)], pa.bool_()),
                        pa.array([t is not None for t in texts], pa.bool_()),
                    ],
                    ["doc_id", "n_units", "ids", "decoded", "same", "present"],
                )

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(encode, f"doc_id {kind}, n_units long, ids array<int>, decoded string, same boolean, present boolean")


def encode_documents(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, ids and the text that they decode to, of every row: null text: null, empty text: no ids, and empty text."""
    encoded = encoded_texts(docs, pieces, doc_id, text, frequent)
    return encoded.select("doc_id", *[F.when(F.col("present"), F.col(c)).alias(k) for c, k in (("ids", "ids"), ("decoded", "text"))])


def encoding_digest(
    docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """doc_id, n_units, n_pieces, pieces_hash and round_trip of every row.

    `pieces_hash` is the hash of the ids in order; `round_trip` says that they
    decode to the text, which fails only where the text holds the sign for
    spaces itself.  Null texts count as empty: no pieces, hash 0, true.  Every
    row is encoded by itself, repeated ones too; null ids are ids like any
    other; other columns are not read; an empty table has no rows.
    `frequent` bounds the units that travel and leaves the rows as they are.
    """
    encoded = encoded_texts(docs, pieces, doc_id, text, frequent)
    return encoded.select(
        "doc_id",
        "n_units",
        F.size("ids").cast("long").alias("n_pieces"),
        F.when(F.size("ids") > 0, F.xxhash64("ids")).otherwise(F.lit(0).cast("long")).alias("pieces_hash"),
        F.col("same").alias("round_trip"),
    )


ship_by_value(__name__)
