"""Monthly actuals against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.kpi import BETTER, presence

from .group import group_kpis

TOLERANCE, SPEND_ON, SPEND_NEAR = 10.0, 5.0, 10.0


def gap_pct(actual: Column, target: Column) -> Column:
    return F.try_divide(actual - target, F.abs(target)) * 100


def target_status(kpi: Column, better: Column, actual: Column, target: Column) -> Column:
    """On target, Within 10%, Off target; for spend On target, Within range, Over or Under."""
    gap = F.round(gap_pct(actual, target), 9)
    wrong = F.when(better == "down", gap).otherwise(-gap)
    spend = F.when(F.abs(gap) <= SPEND_ON, "On target").when(F.abs(gap) <= SPEND_NEAR, "Within 10%").when(gap > 0, "Over").otherwise("Under")
    other = F.when(wrong <= 0, "On target").when(wrong <= TOLERANCE, "Within 10%").otherwise("Off target")
    zero = F.when(F.when(better == "down", actual <= 0).otherwise(actual >= 0), "On target").otherwise("Off target")
    return F.when(actual.isNull() | target.isNull(), "Not available").when(target == 0, zero).when(kpi == "spend", spend).otherwise(other)


def monthly_actuals(df: DataFrame, present: set[str] | None = None) -> DataFrame:
    """Measures by month, with the days that have data and whether the month is complete."""
    dated = df.where("date is not null").withColumn("month", F.date_format("date", "yyyy-MM"))
    days = dated.groupBy("month").agg(F.countDistinct("date").alias("days"), F.max(F.day(F.last_day("date"))).alias("_of"))
    table = group_kpis(dated, "month", presence(df) if present is None else present).join(days, "month")
    return table.withColumn("complete", F.col("days") == F.col("_of")).drop("_of")


def against(actuals: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, kpi, actual) joined with targets (keys, kpi, target): gap and status."""
    better = F.create_map(*(F.lit(x) for k, b in BETTER.items() for x in (k, b)))[F.col("kpi")]
    joined = actuals.join(targets, [*keys, "kpi"], "left")
    return joined.select(*keys, "kpi", "actual", "target", gap_pct(F.col("actual"), F.col("target")).alias("gap_pct"), target_status(F.col("kpi"), better, F.col("actual"), F.col("target")).alias("status"))


def by_month(df: DataFrame, targets: DataFrame, kpis: list[str], present: set[str] | None = None) -> DataFrame:
    """Each month and measure against the monthly target; partial months are not rated."""
    long = monthly_actuals(df, present).unpivot(["month", "complete"], kpis, "kpi", "actual")
    rated = against(long.drop("complete"), targets.crossJoin(long.select("month").distinct()) if "month" not in targets.columns else targets, ["month"])
    complete = long.select("month", "complete").distinct()
    return rated.join(complete, "month").withColumn("status", F.when(F.col("complete"), F.col("status")).otherwise("Partial month")).drop("complete")


def scorecard(df: DataFrame, targets: DataFrame, kpis: list[str], present: set[str] | None = None) -> DataFrame:
    """The latest complete month against the targets, in the order of kpis."""
    rated = by_month(df, targets, kpis, present).where("status != 'Partial month'")
    latest = rated.agg(F.max("month").alias("month"))
    order = F.array_position(F.array(*map(F.lit, kpis)), F.col("kpi"))
    return rated.join(F.broadcast(latest), "month").orderBy(order)


def by_channel(df: DataFrame, targets: DataFrame, kpis: list[str], channel: str = "channel", present: set[str] | None = None) -> DataFrame:
    """Each channel's measures against targets (kpi, target) for the whole period."""
    long = group_kpis(df, channel, presence(df) if present is None else present).unpivot([channel], kpis, "kpi", "actual")
    return against(long, long.select(channel).distinct().crossJoin(F.broadcast(targets)), [channel])
