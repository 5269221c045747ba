"""Shared folders and intermediate tables for the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.shared import shared_dir


#: Arrow batches between the JVM and Python hold at most so many bytes: a task's memory follows neither long texts nor many rows.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Smaller Arrow batches for this session than Spark's own 64 MB, unless it has smaller ones already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        spark.conf.set(key, str(most))


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _fs(spark, path)
    fs.delete(hadoop, True)


class Scratch:
    """Intermediate Parquet tables in the shared folder; they cut lineage and outlive executors.

    ``table`` writes and reads back a table that goes when the block ends. ``keep`` does the same
    for a result, which stays until the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, f"{self.path}/work")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := f"{self.path}/work/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.path}/work/{name}")

    def folder(self, name: str) -> str:
        """A kept folder for files of another format; it goes at the end of the session."""
        fs, hadoop = _fs(self.spark, f"{self.path}/{name}")
        fs.mkdirs(hadoop)
        fs.deleteOnExit(_fs(self.spark, self.path)[1])
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        df.write.parquet(path := f"{self.path}/{name}")
        fs, hadoop = _fs(self.spark, self.path)
        fs.deleteOnExit(hadoop)
        return self.spark.read.schema(df.schema).parquet(path)


def smallest_hashes(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most n rows, those with the smallest hashes of some columns.

    Rows whose hash can hardly be among them are dropped where they are read, so that what tasks send to
    the driver follows n, not the number of tasks.
    """
    share = min(1.0, 4 * n / max(1, rows.count()))
    order = F.xxhash64(*columns)
    return rows.where(order <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).orderBy(order, *columns).limit(n)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as an empty one; other columns may have any name."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
