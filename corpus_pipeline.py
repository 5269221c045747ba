"""A corpus pipeline: each stage reads what the one before it wrote.

Quality classifier, line dedup, n-gram Jaccard join (one document of each group stays), secret scan
(values are replaced), best-fit packing. All stages but the last return the columns of documents.

Defined cases, for every stage: an empty table gives an empty table; a null text counts as empty and
stays null; equal rows, rows that repeat an id and rows without one are documents of their own and
share decisions only where a stage says so; other columns pass through and may have any name that
does not begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, bounded_batches
from tallyspark.llm.line_dedup import drop_lines
from tallyspark.llm.ngram_join import ngram_join, without
from tallyspark.llm.packing import best_fit_packing
from tallyspark.llm.quality import keep_good
from tallyspark.llm.secret_scan import redact_secrets


#: The vocabulary file whose tokens are packed.
VOCABULARY = "byte_bpe_50k.json"
#: Arrow batches of all stages, smaller than a single operator's: stages leave memory in executors and Python workers for one another.
BATCH_BYTES = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Rows are judged one by one; without usable labels all stay."""
    bounded_batches(spark, BATCH_BYTES)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; every document stays.

    Rows that repeat an id are one document here. Rows without an id come before all others and lose no line.
    """
    bounded_batches(spark, BATCH_BYTES)
    return drop_lines(docs, min_chars=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, the one with the smallest id stays.

    A row goes if it has an id whose group has a smaller one. Of rows that repeat an id all stay or go
    together: an id is one document. Rows without an id stay, as nothing tells them apart; texts
    without words have no copies.
    """
    bounded_batches(spark, BATCH_BYTES)
    groups = ngram_join(docs, words=5, pct=80)
    return without(docs, groups.where("doc_id != component_id").select(F.col("doc_id").alias("id")).distinct())


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced, each row by its own findings; every document stays."""
    bounded_batches(spark, BATCH_BYTES)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, in tokens. A text without tokens has one piece of size 0."""
    import public_tokenizers

    bounded_batches(spark, BATCH_BYTES)
    return best_fit_packing(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("lines", lines), ("near duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: The quality classifier is fitted and packing is sequential: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = Scratch(spark, f"pipeline-{i}").keep(stage(spark, docs, sf_dir))
    return docs
