"""Runs and their result tables, each a table of versioned manifests.

A run's rows are parts with its key: replacing or deleting them is a new version of a table, so readers see all of
a change or nothing of it, and a lost executor's task simply runs again. Reads of a run read its parts only, and the
columns asked for.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schema import FIELDS

from .manifest import ManifestTable

# Fixed vocabulary of the store.
STATES = ["created", "cleaning", "analysing", "finished", "failed"]
DELETED = "deleted"  # only by drop_run
ANALYSIS_TABLES = {
    "kpi_results": ["kpi", "value", "numerator", "denominator", "rows_used"], "campaign_analysis": ["campaign", "metric", "value"], "channel_analysis": ["channel", "metric", "value"],
    "segment_analysis": ["dimension", "segment", "metric", "value"], "funnel_analysis": ["scope", "stage", "value", "rate", "drop_off"], "trend_analysis": ["grain", "period", "metric", "value"],
    "anomalies": ["entity_type", "entity", "metric", "start", "end", "value", "baseline", "score", "pct"],
}

# Fixed vocabulary of the logs: table and columns beside the run.
LOG_TABLES = {
    "data_quality_logs": ["source_row", "column_name", "original_value", "cleaned_value", "action", "reason", "severity"],
    "field_mappings": ["source_column", "canonical_field", "status", "score", "reason"],
    "ai_calls": ["purpose", "model", "status", "input_tokens", "output_tokens", "at"],
    "insight_logs": ["section", "text", "evidence_ids", "status"],
    "reports": ["kind", "path", "at"],
    "run_snapshots": ["snapshot", "at"],
}
#: What the cleaning log calls its columns, and the store's names.
QUALITY_NAMES = {"column": "column_name", "original": "original_value", "cleaned": "cleaned_value"}


def layout_key(columns: Column) -> Column:
    """A key for a file's set of columns, whatever their order."""
    return F.sha2(F.to_json(F.array_sort(columns)), 256)


def melted(table: DataFrame, ids: list[str]) -> DataFrame:
    """A wide result as rows (ids, metric, value)."""
    values = [c for c, t in table.dtypes if c not in ids and t in ("double", "bigint", "int", "float")]
    return table.select(*ids, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(ids, values, "metric", "value")


class RunStore:
    """Tables under one path of a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> ManifestTable:
        return ManifestTable(self.spark, f"{self.path}/{name}")

    def exists(self, table: str) -> bool:
        return self.table(table).exists()

    def read(self, table: str) -> DataFrame:
        return self.table(table).read()

    def _of_run(self, table: str, run_id: str) -> DataFrame:
        return self.table(table).read(run_id).drop("run_id")

    def _replace(self, table: str, df: DataFrame, column: str, key: str) -> None:
        self.table(table).replace(df.withColumn(column, F.lit(key)), key)

    # records and results

    def save_records(self, run_id: str, df: DataFrame) -> None:
        """Replace a run's clean records; columns without a field are refused."""
        known = [*FIELDS, "week_start", "dq_flags", "source_row"]
        if unknown := sorted(set(df.columns) - set(known)):
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        self._replace("marketing_records", df, "run_id", run_id)

    def load_records(self, run_id: str, columns: list[str] | None = None) -> DataFrame:
        rows = self._of_run("marketing_records", run_id)
        return rows.select(*columns) if columns else rows

    def save_analysis(self, run_id: str, table: str, df: DataFrame) -> None:
        if table not in ANALYSIS_TABLES:
            raise ValueError(f"no analysis table {table}")
        if unknown := sorted(set(df.columns) - set(ANALYSIS_TABLES[table])):
            raise ValueError(f"{table} has no columns {', '.join(unknown)}")
        self._replace(table, df, "run_id", run_id)

    def load_analysis(self, run_id: str, table: str) -> DataFrame:
        return self._of_run(table, run_id)

    def append(self, table: str, df: DataFrame, key: str | None = None) -> None:
        """Add rows; with a key they go when it is dropped."""
        self.table(table).append(df, key)

    # logs of a run

    def save_log(self, run_id: str, table: str, df: DataFrame) -> None:
        """Replace a run's rows of a log table; other columns than the table's are refused."""
        if table not in LOG_TABLES:
            raise ValueError(f"no log table {table}")
        if unknown := sorted(set(df.columns) - set(LOG_TABLES[table])):
            raise ValueError(f"{table} has no columns {', '.join(unknown)}")
        self._replace(table, df, "run_id", run_id)

    def save_quality_log(self, run_id: str, log: DataFrame) -> None:
        self.save_log(run_id, "data_quality_logs", log.withColumnsRenamed(QUALITY_NAMES))

    def save_mappings(self, run_id: str, matches: dict) -> None:
        """One row a source column, as ``map_fields`` judged it."""
        rows = [(c, m.field, m.status, float(m.score), m.reason) for c, m in matches.items()]
        self.save_log(run_id, "field_mappings", self.spark.createDataFrame(rows, "source_column string, canonical_field string, status string, score double, reason string"))

    def append_log(self, run_id: str, table: str, df: DataFrame) -> None:
        """Add rows to a run's log: calls, insights and reports come one after the other."""
        if unknown := sorted(set(df.columns) - set(LOG_TABLES[table])):
            raise ValueError(f"{table} has no columns {', '.join(unknown)}")
        self.append(table, df.withColumn("run_id", F.lit(run_id)), run_id)

    def load_log(self, run_id: str, table: str) -> DataFrame:
        return self._of_run(table, run_id)

    def save_snapshot(self, run_id: str, values: dict, at: int) -> None:
        """The figures that a finished run opens with, as one JSON text."""
        made = self.spark.createDataFrame([(json.dumps(values, sort_keys=True), at)], "snapshot string, at long")
        self.save_log(run_id, "run_snapshots", made)

    def reopen(self, sha256: str) -> tuple[str, dict] | None:
        """Run and snapshot of the newest finished run of a file with this content; nothing is computed anew."""
        done = self.runs().where((F.col("sha256") == sha256) & (F.col("status") == "finished")).select("run_id").first()
        if done is None:
            return None
        kept = self.load_log(done["run_id"], "run_snapshots").select("snapshot").first() if self.exists("run_snapshots") else None
        return done["run_id"], json.loads(kept["snapshot"]) if kept else {}

    # datasets and runs

    def register_datasets(self, files: DataFrame) -> DataFrame:
        """Append files (sha256, name) whose hash is new; returns the registered row of each."""
        fresh = files.groupBy("sha256").agg(F.min("name").alias("name"))
        if self.exists("datasets"):
            fresh = fresh.join(self.read("datasets"), "sha256", "left_anti")
        self.append("datasets", fresh)
        return files.select("sha256").distinct().join(self.read("datasets"), "sha256")

    def set_status(self, run_id: str, sha256: str, status: str, at: int) -> None:
        """The log of a run's states; the latest counts."""
        if status not in STATES:
            raise ValueError(f"no state {status}")
        self.append("run_log", self.spark.createDataFrame([(run_id, sha256, status, at)], "run_id string, sha256 string, status string, at long"))

    def runs(self) -> DataFrame:
        """run_id, sha256, name, status, created, updated of every run that is not deleted, newest first."""
        log = self.read("run_log").groupBy("run_id", "sha256").agg(F.max_by("status", "at").alias("status"), F.min("at").alias("created"), F.max("at").alias("updated"))
        log = log.where(F.col("status") != DELETED)
        return log.join(self.read("datasets"), "sha256").orderBy(F.desc("created"), F.desc("run_id"))

    def upsert(self, table: str, df: DataFrame, keys: list[str], version: str) -> DataFrame:
        """Append versions; the current rows are the latest of each key."""
        self.table(table).upsert(df, keys)
        return self.current(table, keys, version)

    def current(self, table: str, keys: list[str], version: str) -> DataFrame:
        return self.table(table).current(keys, version)

    def compact(self, table: str, keys: list[str], version: str) -> None:
        """Leave the latest row of each key, in one file a bucket."""
        self.table(table).compact(keys, version)

    def save_targets(self, layout: str, targets: DataFrame) -> None:
        self._replace("targets", targets, "layout_key", layout)

    # housekeeping

    def drop_run(self, run_id: str) -> None:
        """A run's rows of every table. Its states are kept, with ``deleted`` as the last."""
        for table in ["marketing_records", *ANALYSIS_TABLES, *LOG_TABLES]:
            self.table(table).delete(run_id)
        if self.exists("run_log"):
            of = self.read("run_log").where(F.col("run_id") == run_id).select("run_id", "sha256").distinct()
            self.append("run_log", self.spark.createDataFrame([(r["run_id"], r["sha256"], DELETED, 2**62) for r in of.collect()], "run_id string, sha256 string, status string, at long"))  # a run has one file

    def apply_retention(self, keep: int, oldest: int | None = None) -> list[str]:
        """Delete the runs that are not among the newest, or began before a time; returns them."""
        gone = [r["run_id"] for r in self.beyond_retention(keep, oldest).collect()]  # a few runs a session
        for run_id in gone:
            self.drop_run(run_id)
        return gone

    def beyond_retention(self, keep: int, oldest: int | None = None) -> DataFrame:
        """run_id of runs that are not among the newest, or began before a time."""
        from pyspark.sql import Window

        ranked = self.runs().withColumn("_n", F.row_number().over(Window.orderBy(F.desc("created"), F.desc("run_id"))))
        return ranked.where((F.col("_n") > keep) | (F.lit(oldest is not None) & (F.col("created") < F.lit(oldest or 0)))).select("run_id")
