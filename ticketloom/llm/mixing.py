"""Mixing sources to target weights, block by block, with DataFrame operations only.

Each source's words form one stream, packed into blocks of a fixed length.
A source takes as many slots as its target needs; every slot falls into one of
the output shards by a pseudorandom draw, so the counts of a shard are
multinomial, given the totals.  A pass over a source visits its blocks in the
order of a pseudorandom permutation of their indices, so no block is visited
twice before all were; slots and blocks meet in a join by index.
`mixed_shards` returns the shards themselves, `mixture` how much of every
document they hold, `mixed_documents` the same as documents again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import let, numbered, store, text_of, words_of

# Words of a block, output shards, and the largest share of a source that may be taken, as multiples of its size.
BLOCK = 64
SHARDS = 64
MOST = 3
# Ranges of a source's stream whose sizes are summed apart: the running sum never meets in one task.
RANGES = 4096
# Slots that one row unfolds to, and rows of one task.
STRETCH = 4096
STRETCHES = 16
ROUNDS = 4


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1: a Feistel network over an a by b grid that barely holds n.

    Places outside 0..n-1 walk on until they are inside; at most a - 1 places
    are outside, so 24 steps do for n up to 484, and beyond that more than 24
    are needed with a probability under 22 ** -24.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(y: Column) -> Column:
        def round_(s: Column, k: Column) -> Column:
            by_b = (k % 2) == 1
            other = F.when(by_b, s["l"]).otherwise(s["r"])
            size = F.when(by_b, b).otherwise(a)
            shift = F.pmod(F.xxhash64(key, k, other), size)
            own = F.when(by_b, s["r"]).otherwise(s["l"])
            moved = F.pmod((own - shift) if inverse else (own + shift), size)
            return F.struct(F.when(by_b, s["l"]).otherwise(moved).alias("l"), F.when(by_b, moved).otherwise(s["r"]).alias("r"))

        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        begin = F.struct(F.floor(y / b).cast("long").alias("l"), F.pmod(y, b).alias("r"))
        return F.aggregate(rounds, begin, round_, lambda s: s["l"] * b + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), once(x), lambda y, _: F.when(y < n, y).otherwise(once(y)))


def source_key(source: Column) -> Column:
    """Sources as text that sorts by code point, null last and apart from every name."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """key, source_size, weight and target; sizes has one row per source and is all that one task sees.

    Sources share the words of all by weight, no one above `most` times its
    size.  A common level times the weight, cut at that bound, gives it; the
    level is the largest of those that cap only the sources up to each one.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("key")) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int")))
    bound = (most * F.col("source_size")).cast("double")
    before = Window.orderBy(bound / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(bound / F.col("weight"), "key").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(bound).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return ranked.withColumn("level", level).select(
        "key", "source_size", "weight", F.least(bound, F.max("level").over(everything) * F.col("weight")).alias("target")
    )


def placed(rows: DataFrame) -> DataFrame:
    """Rows with `start`, the place of their first word in the source's stream; the order depends on the rows alone."""
    ranges = rows.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(RANGES)))
    by_range = ranges.groupBy("key", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_range.select("key", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "range").orderBy("doc_id", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    own = ranges.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(bases, ["key", "range"]).withColumn("start", F.col("base") + F.col("inside")).drop("range", "base", "inside")


def slots_of(sources: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """key, pass, block, shard and words of every slot: how many words of which block the mix takes, and where to."""
    whole = F.col("source_size")
    plan = sources.where("source_size > 0").select(
        "key",
        "source_size",
        F.ceil(whole / block).cast("long").alias("n"),
        F.least(F.round("target").cast("long"), whole * MOST).alias("want"),
    )
    plan = plan.withColumn("passes", F.floor(F.col("want") / whole).cast("long"))
    plan = plan.withColumn("rest", F.col("want") - F.col("passes") * whole)
    plan = plan.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    plan = plan.withColumn("quota", F.when(F.col("pass") < F.col("passes"), whole).otherwise(F.col("rest"))).where("quota > 0")
    seeded = F.xxhash64(F.lit(seed), "key", "pass")
    plan = plan.withColumn("seed", seeded)
    # The stream's last block may be short; its slot shifts what the slots after it have to take.
    plan = plan.withColumn("short", block * F.col("n") - whole)
    plan = plan.withColumn("short_slot", permuted(F.col("n") - 1, F.col("n"), F.col("seed"), inverse=True))
    stretches = plan.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH))))
    # The rows are tiny and unfold to many: a number of tasks by their count, which adaptive execution leaves alone.
    slots = sources.agg(F.sum(F.ceil(F.col("target") / block))).first()[0] or 0
    stretches = stretches.repartition(int(slots // (STRETCH * STRETCHES)) + 1, "key", "pass", "stretch")
    first = F.col("stretch") * STRETCH
    slots = stretches.withColumn("slot", F.explode(F.sequence(first, F.least(first + STRETCH, F.col("n")) - 1)))
    begin = F.col("slot") * block - F.when(F.col("slot") > F.col("short_slot"), F.col("short")).otherwise(0)
    length = block - F.when(F.col("slot") == F.col("short_slot"), F.col("short")).otherwise(0)
    slots = slots.withColumn("words", F.least(length, F.col("quota") - begin)).where("words > 0")
    return slots.select(
        "key",
        "pass",
        permuted(F.col("slot"), F.col("n"), F.col("seed")).alias("block"),
        F.pmod(F.xxhash64("seed", "slot", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"),
        "words",
    )


def mix_plan(docs: DataFrame, doc_id: str, source: str, text: str, weights: tuple[int, ...], block: int,
             shards: int, seed: int, **keep: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered rows with their sizes, the sources, and the pieces of rows that the mix takes (row, pass, block, shard, from, to)."""
    rows = numbered(
        docs,
        "mix-rows",
        doc_id=F.col(doc_id),
        key=source_key(F.col(source)),
        size=F.size(words_of(F.col(text))).cast("long"),
        tie=F.xxhash64(text_of(text)),
        **keep,
    )
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    sources = store(targets(sizes, weights, MOST), "mix-sources")
    streams = placed(rows.select("row", "doc_id", "key", "size", "tie")).where("size > 0")
    last = F.col("start") + F.col("size") - 1
    pieces = streams.select(
        "row", "key", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))).alias("block")
    )
    at = F.col("block") * block
    # Unfolded slots look as small as the sources they come from; they grow with the words, so they never travel whole.
    taken = pieces.join(slots_of(sources, block, shards, seed).hint("merge"), ["key", "block"]).select(
        "row",
        "pass",
        "block",
        "shard",
        F.greatest(F.col("start"), at).alias("low"),
        F.least(F.col("start") + F.col("size"), at + F.col("words")).alias("high"),
        "start",
    )
    within = (F.col("low") - F.col("start")).alias("from"), (F.col("high") - F.col("start")).alias("to")
    taken = taken.where("high > low").select("row", "pass", "block", "shard", *within)
    return rows, sources, taken


def mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
            weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) and n_shards of every row.

    A source's target is its share, by weight, of all words, at most three
    times its own; the words taken from it are its target, rounded.  No row
    gives more than three times its size.  n_shards: output shards, 64 at most
    here, that hold some of the row's words.  Null and blank texts have size 0;
    a null source is a source of its own; null ids and repeated rows are rows
    like any other; an empty table has no rows.  Reruns agree: a row's place
    depends on its id and text.
    """
    if shards > 64:
        raise ValueError("n_shards counts 64 shards at most")
    rows, sources, taken = mix_plan(docs, doc_id, source, text, weights, block, shards, seed)
    held = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shard"))
    words = taken.groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.bit_or(held).alias("held"))
    return rows.join(sources, "key").join(words, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.bit_count(F.coalesce("held", F.lit(0).cast("long"))).cast("long").alias("n_shards"),
    )


def mixed_shards(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                 weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """shard, source, pass, block, doc_id, words and text of every piece of the output shards.

    A piece is what a block of its source's stream holds of one row; a block
    that the mix visits goes to the shard of its slot, whole.  Words stand
    between single spaces.  Nulls and ties as in `mixture`; rows without words
    are in no shard.
    """
    own = {"own_source": F.col(source), "own_text": F.col(text)}
    rows, _, taken = mix_plan(docs, doc_id, source, text, weights, block, shards, seed, **own)
    size = (F.col("to") - F.col("from")).cast("int")
    cut = F.slice(words_of(F.col("own_text")), (F.col("from") + 1).cast("int"), size)
    return taken.join(rows, "row").select(
        "shard", F.col("own_source").alias("source"), "pass", "block", "doc_id", size.cast("long").alias("words"), F.array_join(cut, " ").alias("text")
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                    length: str | None = "n_chars", weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK,
                    shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """The documents of the mix: each text reduced to the words that the mix takes, a line per pass over it.

    A pass that takes the whole text keeps it as it is; else its words stand
    between single spaces.  Rows of which the mix takes nothing go, rows
    without words stay as they are, null texts null.  Null sources and ids and
    repeated rows are as in `mixture`; an empty table stays empty.  `length`, if it is a column, is set anew.
    Other columns are carried along.
    """
    own = {f"own_{k}": F.col(f"`{c}`") for k, c in enumerate(docs.columns)}
    rows, _, taken = mix_plan(docs, doc_id, source, text, weights, block, shards, seed, **own)
    pieces = taken.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pass", "from", "to"))).alias("pieces"))
    whole = f"own_{docs.columns.index(text)}"

    def line(words: Column, pieces: Column) -> Callable[[Column], Column]:
        def of_pass(p: Column) -> Column:
            def joined(own: Column) -> Column:
                n = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
                cut = F.array_join(
                    F.flatten(F.transform(own, lambda x: F.slice(words, (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")))), " "
                )
                return F.when(n == F.size(words), F.col(whole)).otherwise(cut)

            return let(F.filter(pieces, lambda x: x["pass"] == p), joined)

        return of_pass

    passes = F.array_distinct(F.transform(F.col("pieces"), lambda x: x["pass"]))
    text_taken = let(words_of(F.col(whole)), lambda w: F.array_join(F.transform(passes, line(w, F.col("pieces"))), "\n"))
    mixed = rows.join(pieces, "row", "left").where("size = 0 OR pieces IS NOT NULL")
    mixed = mixed.withColumn("mixed", F.when(F.col("size") > 0, text_taken).otherwise(F.col(whole)))
    values = {c: F.col(f"own_{k}") for k, c in enumerate(docs.columns)} | {text: F.col("mixed")}
    if length in docs.columns:
        values[length] = F.char_length("mixed").cast(docs.schema[length].dataType)
    return mixed.select(*[v.alias(c) for c, v in values.items()])
