"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest. New rows are digested, reduced to one
row a digest before they move, and anti-joined (sort-merge) with the index; what is new is
appended. Only digests, ids and counts are shuffled, never texts.

Defined cases: a null text counts as empty; runs of the six ASCII blanks count as one space; of
equal texts the smallest id stays, or the one that an earlier batch put into the index; rows that
repeat an id and a text share one decision; a row without an id stays only if no copy has an id
(``keep_id`` is then null). An empty batch gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, remove, shared_dir

BLANKS = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256: SHA-256 of the text with each run of blanks as one space."""
    text = F.regexp_replace("text", BLANKS, " ")
    return documents(docs, id_col, text_col).select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"))


class DigestIndex:
    """A bucketed, sorted table (text_sha256, keep_id) at a path that all executors share.

    A path that an earlier session filled is used as it is. ``close`` forgets the table's name;
    the files at a path that was given stay for the next session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.own = path is None
        self.path = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id BIGINT) USING parquet"
            f" CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.own:
            remove(self.spark, self.path)

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append the new digests of a batch and return a decision for each of its rows.

        doc_id, keep_id (the row that stays), group_size (copies in this batch), kept, text_sha256.
        """
        with Scratch(self.spark, "exact-dedup") as scratch:
            rows = scratch.table(digests(docs, id_col, text_col), "rows")
            groups = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size"))
            groups = scratch.table(groups, "groups")
            fresh = groups.select("text_sha256", F.col("first_id").alias("keep_id")).join(
                self.table().hint("merge").select("text_sha256"), "text_sha256", "left_anti"
            )
            (
                fresh.repartition(self.buckets, "text_sha256")
                .write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
                .mode("append").format("parquet").option("path", self.path).saveAsTable(self.name)
            )
            known = groups.join(self.table().hint("merge"), "text_sha256").select("text_sha256", "keep_id", "group_size")
            known = scratch.table(known, "known")
            decided = rows.join(known.hint("merge"), "text_sha256").select(
                "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
            )
            return scratch.keep(decided)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decisions for one table against an index that begins empty."""
    index = DigestIndex(docs.sparkSession)
    try:
        return index.dedup(docs, id_col, text_col)
    finally:
        index.close()
