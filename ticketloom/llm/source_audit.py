"""How far each source's words diverge from the other sources of its language, and which words do it.

A price (p - q)^2 / (p + q) depends on a term only through its counts in the
two groups, their *levels*.  A block of terms is a one-hot matrix with an
indicator column per (group, level); its transpose times itself holds the
joint table of every pair of groups at once: how many terms have level a in
the one and b in the other.  Joint tables are priced cell by cell, in whole
numbers, and the blocks' sums are added by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import Stored
from ticketloom.session import ship_by_value

# Documents of a language that must hold a term.
LEAST_DOCUMENTS = 10
# Ranks of the term part.
TOP = 10
# Terms of one task's block, and indicator columns of one matrix product inside it.
BLOCK_TERMS = 1 << 13
BLOCK_COLUMNS = 1 << 10
# Counters that a counting task holds before it sends them.
HELD = 1 << 18

# A-Z in lower case; every other ASCII byte that is no letter parts words; all bytes of other characters are kept.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(named: DataFrame) -> DataFrame:
    """lang, source, term, n and documents, summed inside the reading tasks as far as their memory goes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, documents) in held.items():
                n = len(times)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(times.keys(), pa.binary()).cast(pa.string())]
                columns += [pa.array(times.values(), pa.int64()), pa.array((documents[t] for t in times), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                times, documents = held.setdefault((lang, source), (Counter(), Counter()))
                words = text.encode().translate(LETTERS).split()
                before = len(times)
                times.update(words)
                documents.update(set(words))
                size += len(times) - before
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return named.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, documents long")


def share(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)) in 64 bits: three digits at a time."""
    below = total + 2 * terms
    quotient, rest = np.divmod(count.astype(np.int64) + 2, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        quotient = quotient * 1000 + digits
    return quotient + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint_price(counts: np.ndarray, totals: list[int], terms: int, columns: int = BLOCK_COLUMNS) -> np.ndarray:
    """Summed prices of every pair of groups over the terms (rows) whose counts by group are given."""
    groups = counts.shape[1]
    value = np.zeros((groups, groups), np.int64)
    # Terms of like counts have few levels together.
    counts = counts[np.lexsort((counts.sum(1), counts.max(1)))]
    at = 0
    while at < len(counts):
        # As many terms as have at most `columns` levels in all groups; one at least.
        step = max(1, columns // groups)
        while at + step < len(counts):
            wider = counts[at : at + 2 * step]
            if sum(len(np.unique(wider[:, g])) for g in range(groups)) > columns:
                break
            step *= 2
        part = counts[at : at + step]
        at += step
        levels, places, group_of = [], [], []
        for g in range(groups):
            own, place = np.unique(part[:, g], return_inverse=True)
            places.append(place.ravel() + sum(map(len, levels)))
            levels.append(own)
            group_of.append(np.full(len(own), g))
        p = np.concatenate([share(own, totals[g], terms) for g, own in enumerate(levels)])
        group = np.concatenate(group_of)
        joint = np.zeros((len(p), len(p)), np.float32)
        # Counts of a joint table stay below 2^24, where single precision is exact; rows go in runs to bound memory.
        for low in range(0, len(part), 1 << 12):
            rows = np.arange(min(1 << 12, len(part) - low))
            one_hot = np.zeros((len(rows), len(p)), np.float32)
            for place in places:
                one_hot[rows, place[low : low + len(rows)]] = 1
            joint += one_hot.T @ one_hot
        a, b = np.nonzero(np.triu(joint, 1))
        apart = group[a] != group[b]
        a, b = a[apart], b[apart]
        np.add.at(value, (group[a], group[b]), joint[a, b].astype(np.int64) * price(p[a], p[b]))
    return value + value.T


AUDIT = "lang string, source string, part string, item string, value long"


def audited(block: pa.Table, top: int) -> pa.Table:
    """Prices of one block of terms: rows of terms, and rows without a term that hold every group's total."""
    is_term = pc.is_valid(block["term"])
    head, rows = block.filter(pc.invert(is_term)), block.filter(is_term)
    sources = head["source"].to_pylist()
    totals, terms = head["total"].to_pylist(), head["terms"][0].as_py()
    counts = np.zeros((rows.num_rows, len(sources)), np.int64)
    if rows.num_rows:
        lists = rows["by_source"].combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
        found = lists.flatten()
        place = pc.index_in(found.field("source"), value_set=pa.array(sources, pa.string())).to_numpy(zero_copy_only=False)
        counts[row, place] = found.field("n").to_numpy()
    names = np.array([t.encode() for t in rows["term"].to_pylist()], object)
    value = joint_price(counts, totals, terms)
    out = [(sources[g], "pair", sources[h], int(value[g, h])) for g in range(len(sources)) for h in range(len(sources)) if g != h]
    if len(names):
        whole = share(counts.sum(1), sum(totals), terms)
        for g, source in enumerate(sources):
            p = share(counts[:, g], totals[g], terms)
            over = np.flatnonzero((counts[:, g] > 0) & (p > whole))
            f = price(p[over], whole[over])
            if len(over) > top:
                least = np.partition(f, -top)[-top]
                over, f = over[f >= least], f[f >= least]
            out += [(source, "term", name.decode(), -int(minus)) for minus, name in sorted(zip(-f, names[over], strict=True))[:top]]
    lang = [block["lang"][0].as_py()] * len(out)
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
    return pa.Table.from_arrays([pa.array(lang, pa.string()), *columns], ["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                      least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank.

    Null text, lang and source count as ''.  A term is a run of letters A-Z
    (in lower case) and non-ASCII characters; each lang keeps the terms that
    at least `least` of its rows hold, repeated rows counted one by one.  Part
    `pair` has a row for every other source of the lang, part `term` the `top`
    terms that the source uses more often than its lang, ties by their UTF-8
    bytes.  Sources without terms take part; a lang of one source has no
    pairs; an empty table has no rows.  No other column is read.  The pairs
    grow with the square of a lang's sources, as the result does.
    """
    tables = Stored(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    # One shuffle by term: what the tasks have counted is added, then a term's sources are gathered, in the same place.
    found = term_counts(named).repartition("lang", "term")
    by_source = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    kept = by_source.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = tables(kept.where(F.col("documents") >= least).drop("documents"), "audit-terms")
    by_group = kept.select("lang", F.inline("by_source")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = groups.join(sizes, "lang", "left").na.fill(0, ["total", "terms"])
    groups = tables(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / block)).cast("int")), "audit-groups")
    blocks = groups.select("lang", "blocks").distinct()
    placed = kept.join(blocks, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "by_source",
        F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"),
    )
    heads = groups.select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"),
        F.lit(None).cast(kept.schema["by_source"].dataType).alias("by_source"), "source", "total", "terms",
    )
    prices = placed.unionByName(heads).groupBy("lang", "block").applyInArrow(lambda g: audited(g, top), AUDIT)
    summed = prices.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


ship_by_value(__name__)
