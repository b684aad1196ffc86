"""Line dedup over a suffix array of line sequences, built by prefix doubling.

Every document is a sequence of line ids (lines without a word are left out).
Doubling ranks the suffixes by their first 1, 2, 4, ... lines: the rank of
2k lines is the order of the pairs (rank of k lines, rank of k lines k later).
Suffixes of equal rank are an interval of the suffix array with a common
prefix of at least that depth, the maximal repeated runs.  Only suffixes whose
interval holds two or more go on to the next depth; the others are unique.

A run counts from `min_words` words on.  Every repeated run is the union of
its shortest parts that hold so many words, each beginning or ending at one
of its lines, so doubling stops at their depth, `min_words` lines at most:
deeper intervals add nothing.  Two overlapping ranks name a part of any
length.  A part that stands earlier as well, in the order of doc_id and line,
is deleted; the first copy of every line thus stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import SPACES, Stored, in_document_order, let, numbered, store, text_of, with_row

MIN_WORDS = 50


def worded(text: Column) -> Column:
    """(line, words, digest) of the lines that hold a word, in order."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(i.alias("line"), F.size(F.filter(F.split(x, SPACES), lambda w: w != "")).alias("words"), x.alias("text")),
    )
    return F.transform(
        F.filter(lines, lambda x: x["words"] > 0),
        lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), F.unhex(F.md5(x["text"])).alias("digest")),
    )


def ranked(pairs: DataFrame, keys: list[str], name: str, store: Stored) -> DataFrame:
    """`pairs` that occur twice or more, with the rank of their keys in sorted order."""
    twice = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # Ranges are sorted one after the other, so the number grows with the key.
    ranks = store(twice.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), f"{name}-ranks")
    return pairs.join(ranks, keys).drop(*keys)


def parts(lines: DataFrame, min_words: int) -> DataFrame:
    """row, at, length of the shortest runs of repeated lines with enough words, from and up to every line."""
    own = Window.partitionBy("row").orderBy("at")
    # Every line holds a word, so min_words lines are enough.
    ahead = F.collect_list(F.struct("at", "words")).over(own.rowsBetween(0, min_words - 1))
    behind = F.collect_list(F.struct("at", "words")).over(own.rowsBetween(1 - min_words, 0))

    def reach(run: Column, way: int) -> Column:
        """Lines until the words suffice, without a gap; 0 if they don't."""
        return F.aggregate(
            run,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(False).alias("over")),
            lambda s, x: F.when(s["over"] | (s["words"] >= min_words), s)
            .when(x["at"] != F.col("at") + way * s["n"], F.struct(s["n"].alias("n"), s["words"].alias("words"), F.lit(True).alias("over")))
            .otherwise(F.struct((s["n"] + 1).alias("n"), (s["words"] + x["words"]).alias("words"), F.lit(False).alias("over"))),
            lambda s: F.when(s["words"] >= min_words, s["n"]).otherwise(0),
        )

    windows = lines.select("row", "at", ahead.alias("ahead"), behind.alias("behind"))
    both = windows.select("row", "at", reach(F.col("ahead"), 1).alias("to"), reach(F.reverse("behind"), -1).alias("back"))
    begin = both.where("to > 0").select("row", "at", F.col("to").alias("length"))
    end = both.where("back > 0").select("row", (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("length"))
    return begin.union(end).distinct()


def repeated_lines(texts: DataFrame, min_words: int) -> DataFrame:
    """row and the lines (numbers from 0) of its text that are later copies; texts has row, doc_id and text."""
    tables = Stored(texts.sparkSession)
    # Only the line numbers stay stored.
    found = store(later_copies(texts, min_words, tables), "lines-removed")
    tables.drop()
    return found


def later_copies(texts: DataFrame, min_words: int, store: Stored) -> DataFrame:
    lines = texts.select("row", "doc_id", F.posexplode(worded(text_of())).alias("at", "x"))
    lines = store(lines.select("row", "doc_id", "at", "x.line", "x.words", "x.digest"), "lines")
    # Depth 1; `place` numbers the repeated lines in the order of documents and lines.
    first = ranked(lines, ["digest"], "lines-1", store).orderBy(*in_document_order(), "at")
    first = store(first.withColumn("place", F.monotonically_increasing_id()), "lines-placed")
    store.drop("lines", "lines-1-ranks")
    windows = store(parts(first, min_words), "lines-parts")
    longest = windows.agg(F.max("length")).first()[0] or 0
    levels, depth, level = [], 1, first.select("row", "at", "rank")
    while depth <= longest:
        levels.append(level.withColumn("depth", F.lit(depth)))
        if 2 * depth > longest:
            break
        later = level.select("row", (F.col("at") - depth).alias("at"), F.col("rank").alias("rank_b"))
        pairs = level.withColumnRenamed("rank", "rank_a").join(later, ["row", "at"])
        depth *= 2
        level = store(ranked(pairs, ["rank_a", "rank_b"], f"lines-{depth}", store), f"lines-{depth}")
        store.drop(f"lines-{depth}-ranks")
    if not levels:
        return texts.select("row", F.array().cast("array<int>").alias("removed")).limit(0)
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)
    depths = F.element_at(F.array_compact(F.array(*[F.when(F.col("length") >= 2**k, F.lit(2**k)) for k in range(len(levels))])), -1)
    named = windows.withColumn("depth", depths).join(ranks.withColumnRenamed("rank", "rank_a"), ["row", "at", "depth"])
    named = named.withColumn("end", F.col("at") + F.col("length") - F.col("depth"))
    ends = ranks.select("row", F.col("at").alias("end"), "depth", F.col("rank").alias("rank_b"))
    placed = first.select("row", "at", "place")
    named = store(named.join(ends, ["row", "end", "depth"]).join(placed, ["row", "at"]), "lines-named")
    key = ["length", "rank_a", "rank_b"]
    origin = store(named.groupBy(*key).agg(F.min("place").alias("origin"), F.max("place").alias("last")).where("origin < last"), "lines-origins")
    doomed = named.join(origin, key).where("place > origin")
    gone = doomed.select("row", F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("at")).distinct()
    numbers = gone.join(first.select("row", "at", "line"), ["row", "at"])
    return numbers.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def without(text: Column, removed: Column) -> Column:
    """A text without the lines of the given numbers."""

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n"), rest)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_worded_left and the text without later copies of repeated line runs, per row.

    Lines end at a line feed and are equal when identical.  A run is a row of
    lines that follow each other in a document, lines without a word aside;
    runs of `min_words` words or more that stood earlier (smaller doc_id, null
    last, equal ids in a fixed order; or further up in the same text) go.
    Null and empty texts stay as they are.
    """
    rows = numbered(docs, "line-texts", doc_id=F.col(doc_id), text=F.col(text))
    gone = repeated_lines(rows, min_words)
    none = F.array().cast("array<int>")
    marked = rows.join(gone.hint("merge"), "row", "left").withColumn("removed", F.coalesce("removed", none))
    left = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))) - F.size("removed")
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.when(F.col("text").isNull(), 0).otherwise(left).cast("long").alias("n_worded_left"),
        F.when(F.size("removed") > 0, without(F.col("text"), F.col("removed"))).otherwise(F.col("text")).alias("text"),
    )


def deduped_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars",
                      min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with deduplicated texts, `length` set anew; documents that lose their last line with a word go."""
    rows = with_row(docs, "line-documents", doc_id, text)
    gone = repeated_lines(rows.select("row", "doc_id", "text"), min_words)
    marked = rows.join(gone.hint("merge"), "row", "left").withColumn("cut", F.when(F.col("removed").isNotNull(), without(F.col("text"), F.col("removed"))))
    marked = marked.where(F.col("cut").isNull() | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    values = {c: F.col(f"own_{k}") for k, c in enumerate(docs.columns)} | {text: F.coalesce("cut", "text")}
    if length in docs.columns:
        values[length] = F.when(F.col("cut").isNull(), values[length]).otherwise(F.char_length("cut").cast(docs.schema[length].dataType))
    return marked.select(*[v.alias(c) for c, v in values.items()])
