"""Events as a stream: tumbling counts with a watermark, sessions, and a run over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.shared import new_folder


def read_events(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """A stream over Parquet files that arrive in a folder (or match a path)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    stream = stream.option("pathGlobFilter", name) if name.endswith(".parquet") else stream
    return stream.parquet(folder if name.endswith(".parquet") else path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, value: rows later than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, end, n: events of a user no further apart than the gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(result: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming result over all data that are there, into Parquet with checkpointed state, and read it back."""
    spark = result.sparkSession
    folder = new_folder(spark, f"stream-{name}")
    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
