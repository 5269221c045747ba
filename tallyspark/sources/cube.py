"""Measures of a run as an additive cube: filters and groupings are answered from sums, not from rows.

A state is what sums can be put together from: the number of rows, the sum of each additive measure and, for each
ratio, the sums of both parts over the rows where both are known. States of two sets of rows add up to
those of both. They are kept by day and dimensions, and in smaller rollups by day and some dimensions, each made
from the states of the one above it. A question goes to the smallest rollup that has its dimensions; rows that
come later add states to all rollups.

Missing dimension values stay missing in the cube and are named like in ``group_kpis`` when asked. Ratios that need
a field that no row had at first stay out: the fields are those of the first rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.kpi import RATIOS, both_known, parts, presence, with_gross_profit
from tallyspark.schema import ADDITIVE

_MANIFEST = "run_id string, rollup string, dims array<string>, rows long, fields array<string>"


def _additive(fields: set[str]) -> list[str]:
    return [m for m in ADDITIVE if m in fields]


def _ratios(fields: set[str]) -> list[str]:
    return [k for k in RATIOS if parts(k, fields) is not None]


def states_of(df: DataFrame, keys: list[str], fields: set[str]) -> DataFrame:
    """States of rows by some columns. One aggregate, combined before the shuffle."""
    sums = [F.sum(F.col(m).cast("double")).alias(f"sum_{m}") for m in _additive(fields)]
    for k in _ratios(fields):
        upper, lower, _ = parts(k, fields)
        n, d = both_known(upper, lower)
        sums += [F.sum(n).alias(f"upper_{k}"), F.sum(d).alias(f"lower_{k}")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *sums)


def added(states: DataFrame, keys: list[str | Column]) -> DataFrame:
    """States by fewer keys."""
    return states.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in states.columns if c == "rows" or c.split("_", 1)[0] in ("sum", "upper", "lower")))


def measures_of(states: DataFrame, keys: list[str], fields: set[str]) -> DataFrame:
    """Sums and ratios of states, under the names that ``group_kpis`` gives them."""
    ratios = [(F.try_divide(f"upper_{k}", f"lower_{k}") * parts(k, fields)[2]).alias(k) for k in _ratios(fields)]
    return states.select(*keys, "rows", *(F.col(f"sum_{m}").alias(m) for m in _additive(fields)), *ratios)


class Cube:
    """Cubes of many runs in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, run_id: str, rollup: str) -> str:
        return f"{self.path}/states/run_id={run_id}/{rollup}"

    def build(self, run_id: str, df: DataFrame, dims: list[str], rollups: list[list[str]] = ()) -> None:
        """The cube of a run's rows by all dims, and rollups by some of them."""
        df, fields = with_gross_profit(df, presence(df))
        self._add(run_id, df, [dims, *rollups], fields)

    def add(self, run_id: str, df: DataFrame) -> None:
        """More rows of a run that has a cube."""
        known = self.rollups(run_id)
        fields = set(known[0]["fields"])
        df, _ = with_gross_profit(df, fields - {"gross_profit"} if "gross_profit" not in df.columns else fields)
        self._add(run_id, df, sorted((r["dims"] for r in known), key=len, reverse=True), fields)

    def _add(self, run_id: str, df: DataFrame, rollups: list[list[str]], fields: set[str]) -> None:
        whole, rows = None, []
        for dims in rollups:
            name = "-".join(dims) or "all"
            states = states_of(df, ["date", *dims], fields) if whole is None else added(whole, ["date", *dims])
            part = f"{self._folder(run_id, name)}/{uuid.uuid4().hex}"  # a part that failed isn't in the manifest
            states.write.parquet(part)
            written = self.spark.read.schema(states.schema).parquet(part)
            whole = written if whole is None else whole
            rows.append((run_id, f"{name}/{part.rsplit('/', 1)[1]}", dims, written.count(), sorted(fields)))
        # all rollups of an addition become visible at once
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def rollups(self, run_id: str) -> list:
        """Rows (dims, parts, rows, fields) of a run's rollups, the smallest first: a few."""
        of = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").where(F.col("run_id") == run_id)
        return of.groupBy("dims").agg(F.collect_list("rollup").alias("parts"), F.sum("rows").alias("rows"), F.first("fields").alias("fields")).orderBy("rows", F.size("dims")).collect()

    def choose(self, run_id: str, needed: set[str]):
        """The smallest rollup that has all the dimensions."""
        for r in self.rollups(run_id):
            if needed <= set(r["dims"]):
                return r
        raise ValueError(f"no rollup of {run_id} has {', '.join(sorted(needed))}")

    def kpis(self, run_id: str, by: list[str] = (), values: dict[str, list[str]] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """The keys with rows, sums and ratios, like ``group_kpis`` over the rows that pass the filters.

        by: dimensions, or date, week, month. values: dimension -> allowed values, none of them if empty. start, end: inclusive.
        """
        spans = {"date": F.col("date"), "week": F.to_date(F.date_trunc("week", "date")), "month": F.date_format("date", "yyyy-MM")}
        values = {k: v for k, v in (values or {}).items() if v}
        chosen = self.choose(run_id, {b for b in by if b not in spans} | set(values))
        fields = set(chosen["fields"])
        states = self.spark.read.parquet(*(f"{self.path}/states/run_id={run_id}/{p}" for p in chosen["parts"]))
        for k, allowed in values.items():
            states = states.where(F.col(k).isin(allowed))
        if start is not None:
            states = states.where(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            states = states.where(F.col("date") <= F.lit(end).cast("date"))
        keys = [spans[b].alias(b) if b in spans else F.coalesce(F.col(b), F.lit("(none)")).alias(b) if dict(states.dtypes)[b] == "string" else F.col(b) for b in by]
        return measures_of(added(states, keys), list(by), fields)
