"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

A batch is reduced to one row per digest, a sort-merge anti-join drops the
digests that the index already holds, and the rest is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm.common import SPACES, numbered, text_of
from ticketloom.session import work_path

# A digest with more than one row in so many is joined apart; there are fewer such digests than this.
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(text_of(text), SPACES, "")


class DigestIndex:
    """Digests of all texts seen so far, kept in a table with buckets sorted by digest.

    `table` names it in the catalog, `path` is its folder; a later session opens
    the same folder again.  `buckets` is fixed when the index is made.
    """

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = path or work_path(spark, table)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, batch STRING, keep_row BIGINT, keep_id BIGINT,"
            f" group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            f" LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Append the new texts of a batch; label every row of the batch.

        A job that may be started again names its batch: the same rows under the
        same name, after a run that failed before, in the middle of or after the
        append, add what is missing of them and get the same labels.

        Returns row, doc_id, keep_id, group_size, kept and text_sha256, one row
        per row of `docs`.  Of equal texts of a batch the row with the most code
        points stays, then the smallest doc_id (null last), then the first row;
        a text that an earlier batch brought is never kept, and its keep_id and
        group_size are those of that batch.  Null texts count as empty, empty
        texts are equal, other columns are not read.
        """
        again, batch = batch is not None, batch or uuid.uuid4().hex
        rows = numbered(
            docs,
            "digests",
            doc_id=F.col(doc_id).cast("long"),
            length=F.char_length(text_of(text)).cast("long"),
            digest=F.unhex(F.sha2(normalised(F.col(text)), 256)),
        )
        best = F.min(F.struct((-F.col("length")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
        groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        fresh = groups.join(self.read().hint("merge"), "digest", "left_anti").select(
            "digest", F.lit(batch).alias("batch"), F.col("best.row").alias("keep_row"),
            F.col("best.doc_id").alias("keep_id"), "group_size",
        )
        # One task per bucket, so that a batch adds one sorted file to each.
        (
            fresh.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
            .saveAsTable(self.table)
        )
        index = self.read()
        if again:
            # An earlier run may have numbered the rows in another way.
            index = index.drop("keep_row").join(groups.select("digest", F.col("best.row").alias("keep_row")), "digest")
        # A very large group would land in one task of the sort-merge join; its digest travels instead.
        # Groups of more than n / HOT_SHARE rows are fewer than HOT_SHARE, whatever n is.
        counts = rows.count()
        large = F.col("group_size") > counts / HOT_SHARE
        hot = F.broadcast(index.where(large & (F.col("batch") == batch)))
        plain = rows.join(hot.select("digest"), "digest", "left_anti").join(index.hint("merge"), "digest")
        labelled = rows.join(hot, "digest").unionByName(plain)
        return labelled.select(
            "row",
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("batch") == batch) & (F.col("keep_row") == F.col("row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Label every row of `docs` against a new index; see `DigestIndex.add`."""
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    return index.add(docs, doc_id, text)
