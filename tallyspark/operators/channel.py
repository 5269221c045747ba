"""Channels, campaigns and segments: grouped measures with shares, indexes, ranks and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.kpi import BETTER, DOWN, channel_type, presence

from .common import add_shares, primary_outcome, recent_change
from .group import group_kpis

INDEXED = ["ctr", "cpc", "cpl", "lead_to_conversion_rate", "roas", "cac"]


def paid_only(df: DataFrame, channel: str = "channel") -> DataFrame:
    return df.where(channel_type(F.col(channel)) == "paid")


def owned_only(df: DataFrame, channel: str = "channel") -> DataFrame:
    return df.where(channel_type(F.col(channel)) == "owned")


def channel_table(df: DataFrame, by: str = "channel") -> DataFrame:
    """Measures and shares by channel, its type, and for paid ones each measure as an index to all paid media (100)."""
    present = presence(df)
    table = add_shares(group_kpis(df, by, present)).withColumn("type", channel_type(F.col(by)))
    overall = group_kpis(paid_only(df, by).withColumn("all_paid", F.lit("paid")), "all_paid", present)
    keys = [k for k in INDEXED if k in table.columns]
    overall = overall.select(*(F.col(k).alias(f"_{k}") for k in keys))  # one row
    index = [F.when(F.col("type") == "paid", F.try_divide(F.col(k), F.col(f"_{k}")) * 100).alias(f"{k}_index") for k in keys]
    return table.join(F.broadcast(overall)).select(*table.columns, *index)


def campaign_table(df: DataFrame, by: str = "campaign_name", channel: str = "channel") -> DataFrame:
    """Measures and shares by campaign with its main channel, first and last day, active days and 28-day trend."""
    present = presence(df)
    table = add_shares(group_kpis(df, by, present))
    facts = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.mode(channel, True).alias("main_channel"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("active_days")
    )
    trend = recent_change(df, by, primary_outcome(present) or "spend")
    return table.join(facts, by, "left").join(trend.select(by, "change_pct", "trend"), by, "left")


def segment_table(df: DataFrame, dimension: str) -> DataFrame:
    present = presence(df)
    table = add_shares(group_kpis(df, dimension, present))
    growth = recent_change(df, dimension, primary_outcome(present) or "spend").select(dimension, "change_pct", "trend")
    return table.join(growth, dimension, "left")


def rank_campaigns(table: DataFrame, metric: str, by: str = "campaign_name", top: int | None = None, min_spend_share: float = 0.0, worst: bool = False) -> DataFrame:
    """Rank by a measure in the direction that is better for it, ties by name."""
    rows = table.where(F.col(metric).isNotNull())
    if min_spend_share:
        rows = rows.where(F.col("spend_share") >= min_spend_share)
    low_first = (BETTER.get(metric) == DOWN) != worst
    order = Window.orderBy(F.asc(metric) if low_first else F.desc(metric), F.asc(by))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def group_other(df: DataFrame, category: str, additive: list[str], sort_by: str, most: int = 7) -> DataFrame:
    """The largest categories and one row 'Other' for the rest; additive columns only."""
    totals = df.groupBy(category).agg(*(F.sum(c).alias(c) for c in additive))
    ranked = totals.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(sort_by), F.asc(category))))
    many = F.count(F.lit(1)).over(Window.partitionBy())
    name = F.when((F.col("_rank") <= most) | (many <= most + 1), F.col(category)).otherwise("Other")
    return ranked.select(name.alias(category), *additive).groupBy(category).agg(*(F.sum(c).alias(c) for c in additive))
