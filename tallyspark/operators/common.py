"""Rules that many operators share: keys, presence, recent change, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.kpi import presence
from tallyspark.schema import OUTCOMES

WINDOW_DAYS, FLAT = 28, 0.05


def campaign_key(present: set[str]) -> str | None:
    return next((c for c in ("campaign_name", "campaign_id") if c in present), None)


def channel_key(present: set[str]) -> str | None:
    return next((c for c in ("channel", "platform") if c in present), None)


def primary_outcome(present: set[str]) -> str | None:
    return next((c for c in OUTCOMES if c in present), None)


def direction(change: Column, flat: float = FLAT) -> Column:
    """up, down or flat by a relative change; n/a without one."""
    return F.when(change.isNull(), "n/a").when(F.abs(change) <= flat, "flat").when(change > 0, "up").otherwise("down")


def recent_change(df: DataFrame, by: str, metric: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Sums of the last days and of the days before them for each known key, in one aggregate."""
    last = df.agg(F.max("date")).first()[0]
    since = F.date_sub(F.lit(last), days)
    value = F.col(metric).cast("double")
    recent = F.sum(F.when(F.col("date") > since, value))
    previous = F.sum(F.when((F.col("date") <= since) & (F.col("date") > F.date_sub(since, days)), value))
    sums = df.where(F.col(by).isNotNull()).groupBy(by).agg(recent.alias("recent"), previous.alias("previous"))
    change = F.try_divide(F.col("recent") - F.col("previous"), F.col("previous"))
    return sums.select(by, "recent", "previous", (change * 100).alias("change_pct"), direction(change).alias("trend"))


def add_shares(table: DataFrame, metrics: tuple[str, ...] = ("spend", "revenue", "conversions", "leads")) -> DataFrame:
    """Share of the column's total in percent; tables here have one row an entity."""
    whole = Window.partitionBy()
    return table.select("*", *((F.try_divide(F.col(m), F.sum(m).over(whole)) * 100).alias(f"{m}_share") for m in metrics if m in table.columns))


__all__ = ["add_shares", "campaign_key", "channel_key", "direction", "presence", "primary_outcome", "recent_change"]
