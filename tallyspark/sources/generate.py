"""Synthetic campaign data of any size, made by Spark: date by campaign by region with planted anomalies.

All noise is a hash of (seed, day, campaign, region), so the same arguments give the same rows however
they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ["Paid Search", "Paid Social", "Display", "Video", "Affiliate", "Email"]
REGIONS = ["North", "South", "East", "West", "Central"]

#: kind, campaign number (None: all), region (None: all), first day, days, column and factor.
PLANTED = [
    ("spend_spike", 1, None, 120, 7, "spend", 3.0),
    ("revenue_drop", None, "South", 160, 7, "revenue", 0.4),
    ("tracking_outage", 2, None, 200, 2, "clicks", 0.0),
    ("conversion_surge", 3, None, 240, 7, "conversions", 2.5),
    ("lead_quality_collapse", 4, None, 270, 7, "qualified_leads", 0.2),
    ("cost_rise", 5, None, 300, 7, "leads", 0.35),
]


def noise(seed: int, *keys: str) -> Column:
    """Between 0 and 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_003)) / 1_000_003.0


def campaigns(spark: SparkSession, start: str = "2025-10-01", days: int = 365, n_campaigns: int = 17, seed: int = 42, planted: bool = True) -> DataFrame:
    """One row a day, campaign and region, in canonical columns."""
    grid = spark.range(days).select(F.col("id").cast("int").alias("day")).crossJoin(spark.range(1, n_campaigns + 1).select(F.col("id").cast("int").alias("c")))
    grid = grid.select("day", "c", F.explode(F.array(*map(F.lit, REGIONS))).alias("region"))
    season = 1 + 0.15 * F.sin(F.col("day") * 2 * 3.141592653589793 / 365)
    weekend = F.when(F.col("day") % 7 >= 5, 0.8).otherwise(1.0)
    names = F.array(*map(F.lit, CHANNELS))
    base = grid.withColumn("x", noise(seed, "day", "c", "region")).withColumn("channel", names[F.col("c") % len(CHANNELS)])
    spend = F.round((400 + 150 * (F.col("c") % 5)) * season * weekend * (0.9 + 0.2 * F.col("x")), 2)
    df = base.withColumn("spend", spend).withColumn("clicks", F.floor(F.col("spend") / (8 + F.col("c") % 3)).cast("double"))
    df = df.withColumn("impressions", F.col("clicks") * 40).withColumn("reach", F.floor(F.col("impressions") * 0.7)).withColumn("leads", F.floor(F.col("clicks") * 0.2))
    df = df.withColumn("qualified_leads", F.floor(F.col("leads") * 0.6)).withColumn("conversions", F.floor(F.col("leads") * 0.3)).withColumn("revenue", F.col("conversions") * (900 + 40 * (F.col("c") % 4)))
    for _, campaign, region, first, length, column, factor in PLANTED if planted else []:
        hit = F.col("day").between(first, first + length - 1) & (F.lit(campaign is None) | (F.col("c") == F.lit(campaign or 0))) & (F.lit(region is None) | (F.col("region") == F.lit(region or "")))
        df = df.withColumn(column, F.when(hit, F.col(column) * factor).otherwise(F.col(column)))
    return df.select(
        F.date_add(F.lit(start).cast("date"), F.col("day")).alias("date"), F.concat(F.lit("Campaign "), F.col("c").cast("string")).alias("campaign_name"), F.format_string("C-%03d", "c").alias("campaign_id"), "channel",
        F.concat_ws(" ", "channel", F.lit("network")).alias("platform"), "region", F.round(F.col("spend") * 1.05, 0).alias("budget"), "spend", "impressions", F.col("reach").cast("double").alias("reach"), "clicks",
        *(F.col(c).cast("double").alias(c) for c in ("leads", "qualified_leads", "conversions", "revenue")), F.round(F.col("revenue") * 0.4, 2).alias("gross_profit"),
    )


def without(df: DataFrame, *columns: str) -> DataFrame:
    """A variant with columns missing."""
    return df.drop(*columns)


def messy_copy(df: DataFrame, seed: int = 42) -> DataFrame:
    """The rows as people edit them: every text, other spellings, spaces, separators, date formats and gaps; some rows twice, and a total."""
    x = noise(seed + 1, "date", "campaign_name", "region")
    text = df.select(
        F.when(x < 0.1, F.date_format("date", "dd/MM/yyyy")).when(x < 0.15, F.date_format("date", "d MMM yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("Day"), F.col("campaign_name").alias("Campaign"),
        F.when(x < 0.2, F.upper("channel")).when(x < 0.3, F.concat(F.lit("  "), "channel", F.lit(" "))).when(x > 0.98, F.lit("N/A")).otherwise(F.col("channel")).alias("Channel"), F.col("region").alias("Region"),
        F.when(x < 0.3, F.concat(F.lit("₹"), F.format_number("spend", 2))).when(x > 0.97, F.lit("-")).otherwise(F.format_string("%.2f", "spend")).alias("Cost"),
        *(F.format_string("%.0f", c).alias(n) for c, n in (("impressions", "Impr."), ("clicks", "Clicks"), ("leads", "Leads"), ("conversions", "Conv."), ("revenue", "Revenue"))), x.alias("_x"),
    )
    again = text.where("_x > 0.99")
    total = text.limit(1).select(*(F.lit("Grand Total" if c == "Campaign" else "").alias(c) for c in text.columns[:-1]))  # one row
    return text.drop("_x").unionByName(again.drop("_x")).unionByName(total)


def dropped_column_copies(df: DataFrame, columns: tuple[str, ...] = ("revenue", "leads", "region", "clicks")) -> dict[str, DataFrame]:
    """A copy without each of these columns in turn."""
    return {c: without(df, c) for c in columns}


def channel_slices(df: DataFrame) -> dict[str, DataFrame]:
    """The rows of each channel as an export of its own."""
    return {c: platform_export(df.where(F.col("channel") == c)) for c in CHANNELS}


def platform_export(df: DataFrame) -> DataFrame:
    """The same rows under a platform's headers, as text."""
    names = {"date": "Reporting starts", "campaign_name": "Campaign name", "spend": "Amount spent (INR)", "impressions": "Impressions", "reach": "Reach", "clicks": "Link clicks", "leads": "Leads"}
    return df.select(*(F.col(c).cast("string").alias(n) for c, n in names.items()))
