"""Measures by day, week and month, with changes, rolling means and seasonality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.kpi import presence
from tallyspark.schema import ADDITIVE

from .group import group_kpis

ROLLING = 4


def period(grain: str):
    if grain == "week":
        return F.to_date(F.date_trunc("week", "date"))
    return F.date_format("date", "yyyy-MM") if grain == "month" else F.col("date")


def time_series(df: DataFrame, grain: str, metrics: list[str] | None = None) -> DataFrame:
    """period, days and measures, with the change to the row before in percent and the mean of four rows."""
    present = presence(df)
    dated = df.where("date is not null").withColumn("period", period(grain))
    table = group_kpis(dated, "period", present).join(dated.groupBy("period").agg(F.countDistinct("date").alias("days")), "period")
    metrics = metrics or [m for m in ("spend", "revenue", "leads", "conversions", "roas", "cpl") if m in table.columns]
    order = Window.orderBy("period")  # one row a period
    rolling = order.rowsBetween(1 - ROLLING, 0)
    changes = [(F.try_divide(F.col(m) - F.lag(m).over(order), F.lag(m).over(order)) * 100).alias(f"{m}_change") for m in metrics]
    means = [F.when(F.count(m).over(rolling) == ROLLING, F.avg(m).over(rolling)).alias(f"{m}_rolling") for m in metrics if grain == "week"]
    return table.select("*", *changes, *means)


def full_months(df: DataFrame) -> DataFrame:
    """month, days and sums, for months in which every day has data."""
    monthly = df.withColumn("month", F.date_format("date", "yyyy-MM")).groupBy("month")
    table = monthly.agg(F.countDistinct("date").alias("days"), F.max(F.day(F.last_day("date"))).alias("of"), *(F.sum(F.col(m).cast("double")).alias(m) for m in ADDITIVE if m in df.columns))
    return table.where("days = of").drop("of")


def seasonality_index(df: DataFrame, metric: str = "revenue", least: int = 12) -> DataFrame:
    """month_of_year, mean, months and the index to the mean of the means; nothing under 12 full months."""
    months = full_months(df).where(F.col(metric).isNotNull())
    enough = F.count(F.lit(1)).over(Window.partitionBy()) >= least
    months = months.withColumn("_enough", enough).where("_enough")
    by_month = months.groupBy(F.substring("month", 6, 2).cast("int").alias("month_of_year")).agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("months"))
    return by_month.withColumn("index", F.try_divide(F.col("mean"), F.avg("mean").over(Window.partitionBy())) * 100)


def full_weeks(trend: DataFrame) -> DataFrame:
    """A weekly trend without a partial first or last week, if two weeks remain."""
    whole = Window.partitionBy()
    edge = (F.col("period") == F.min("period").over(whole)) | (F.col("period") == F.max("period").over(whole))
    partial = edge & (F.col("days") < 7)
    marked = trend.withColumn("_partial", partial).withColumn("_left", F.count(F.when(~F.col("_partial"), 1)).over(whole))
    return marked.where("not _partial or _left < 2").drop("_partial", "_left")


def sparkline(trend: DataFrame, keys: list[str], last: int = 12) -> DataFrame:
    """The last full weeks of some measures as rows."""
    rows = full_weeks(trend).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("period")))).where(F.col("_n") <= last)
    return rows.select("period", *keys).unpivot(["period"], keys, "kpi", "value")

