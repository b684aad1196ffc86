"""The corpus pipeline: quality rules, line dedup, near-duplicate join, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents`.  Every stage takes nulls in any
column, empty, blank and long texts, repeated rows, columns of any name and
an empty table; what becomes of them is stated with the operator it calls.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketloom.llm import common, jaccard_join, line_dedup, mixing, quality_rules, sentencepieces

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Tables that the stages before have stored.
EARLIER: list[str] = []


def tidy(stage: Stage) -> Stage:
    """A stage that first deletes what the stages before it stored: their results have been written, or `docs` still reads them."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if EARLIER else []
        done = [path for path in EARLIER if not any(path.split(":")[-1].strip("/") in file for file in read)]
        if len(done) == len(EARLIER):
            common.delete(spark, done)
            EARLIER.clear()
        before = len(common.LEFT)
        result = stage(spark, docs, sf_dir)
        EARLIER.extend(common.LEFT[before:])
        return result

    return run_stage


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null and blank texts among them (too few words)."""
    return quality_rules.quality_filter(docs)


@tidy
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; a document that loses its last line goes. Null texts stay null."""
    return line_dedup.deduped_documents(docs)


@tidy
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; texts without words all stay."""
    return jaccard_join.without_near_copies(docs)


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become what the mix takes of them, by the weights of their sources, null among these; texts without words stay."""
    return mixing.mixed_documents(docs)


@tidy
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text: how many, their hash, and whether they decode to the text. Null texts count as empty."""
    import public_tokenizers

    pieces = sentencepieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepieces.encoding_digest(docs, pieces)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("mix", mix), ("pieces", tokens)]

# Source permutations and merges have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again as the next one's input."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.Stored(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
            # The input of this stage, the result of the one before, is read no more.
            if k:
                written.drop(STAGES[k - 1][0])
    return docs
