"""Margins, break-even, contribution and profit status, each from an entity's own sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 0.10


def profit_status(roas: Column, break_even: Column, contribution: Column, band: float = BAND) -> Column:
    """By ROAS over break-even ROAS; without that ratio a negative contribution is a loss."""
    ratio = F.round(F.try_divide(roas, break_even), 9)
    return (
        F.when(ratio >= 1 + band, "Profitable").when(ratio >= 1 - band, "Near break-even").when(ratio.isNotNull(), "Loss-making")
        .when(contribution < 0, "Loss-making").otherwise("Not available")
    )


def profit_table(df: DataFrame, by: str, assumed_margin_pct: float | None = None, band: float = BAND) -> DataFrame:
    """entity and its profit measures; gross profit may be assumed as a share of revenue where it is missing."""
    profit = F.col("gross_profit") if "gross_profit" in df.columns else F.lit(None).cast("double")
    if assumed_margin_pct is not None:
        profit = F.coalesce(profit, F.col("revenue") * (assumed_margin_pct / 100))
    rows = df.withColumn("_gp", profit.cast("double"))

    def both(value: Column, other: Column) -> Column:
        return F.sum(F.when(value.isNotNull() & other.isNotNull(), value))

    gp, revenue, spend = F.col("_gp"), F.col("revenue").cast("double"), F.col("spend").cast("double")
    sums = rows.groupBy(F.coalesce(F.col(by), F.lit("(none)")).alias("entity")).agg(
        F.sum(spend).alias("spend"), F.sum(revenue).alias("revenue"), F.sum(gp).alias("gross_profit"),
        F.try_divide(both(gp, revenue), both(revenue, gp)).alias("_margin"), both(gp - spend, gp).alias("contribution"),
        both(spend, gp).alias("_spend_c"), F.try_divide(both(revenue, spend), both(spend, revenue)).alias("roas"),
    )
    break_even = F.when(F.col("_margin") > 0, 1 / F.col("_margin"))
    table = sums.select(
        "entity", "spend", "revenue", "gross_profit", "roas", (F.col("_margin") * 100).alias("gross_margin_pct"), break_even.alias("break_even_roas"),
        "contribution", F.try_divide("contribution", "_spend_c").alias("profit_per_rupee"),
    )
    headroom = (F.try_divide("roas", "break_even_roas") - 1) * 100
    return table.withColumn("roas_headroom", headroom).withColumn("status", profit_status(F.col("roas"), F.col("break_even_roas"), F.col("contribution"), band))


def loss_makers(table: DataFrame, n: int) -> DataFrame:
    """The entities with the largest losses."""
    return table.where("contribution < 0").orderBy("contribution", "entity").limit(n)
