"""The orders table written as an export that people edited: the same defects at known rows.

The row's number modulo 20 decides its defect, so the expected result of every cleaning step is a
plain SQL expression over the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPING = {"date": "Day", "campaign_name": "Campaign", "channel": "Channel", "spend": "Cost", "impressions": "Impr.", "clicks": "Clicks", "leads": "Leads"}
COLUMNS = [*MAPPING.values(), "Notes"]
REPEAT, TOTAL = 97, 1009  # rows that appear twice, and rows that are totals


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_row and text columns. Row r of the orders has source_row 2r; its copy, if any, 2r + 1."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    r, k = F.col("o_orderkey"), F.col("o_orderkey") % 20
    day = F.col("o_orderdate").cast("date")
    cost = F.round(F.col("o_totalprice"), 2)
    two = F.format_string("%.2f", cost)
    clicks = r % 500 + 10
    rows = o.select(
        (r * 2).alias("source_row"),
        F.when(k < 10, F.date_format(day, "yyyy-MM-dd")).when(k < 13, F.date_format(day, "dd/MM/yyyy")).when(k < 16, F.date_format(day, "d MMM yyyy")).when(k == 16, "N/A").when(k == 17, "someday").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("Day"),
        F.concat(F.lit("Campaign "), (F.col("o_custkey") % 25).cast("string")).alias("Campaign"),
        F.when(r % TOTAL == 0, "Grand Total").when(k == 1, F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" "))).when(k == 2, F.concat("o_orderpriority", F.lit("T"))).when(k == 8, F.lit("n/a")).when(k == 9, F.concat("o_orderpriority", F.lit("  "))).otherwise(F.col("o_orderpriority")).alias("Channel"),
        F.when(k == 3, F.concat(F.lit("₹"), F.format_number(cost, 2))).when(k == 4, F.concat(F.lit("("), two, F.lit(")"))).when(k == 5, "-").when(k == 6, "free").otherwise(two).alias("Cost"),
        F.when(k == 7, clicks - 1).otherwise(clicks * 10).cast("string").alias("Impr."),
        clicks.cast("string").alias("Clicks"),
        (r % 7).cast("string").alias("Leads"),
        F.concat(F.lit("row "), r.cast("string")).alias("Notes"),
    )
    return rows.unionByName(rows.where((F.col("source_row") / 2) % REPEAT == 0).withColumn("source_row", F.col("source_row") + 1))


#: Rows that stay, with their defect number, for the SQL side.
KEPT_SQL = f"""WITH o AS (SELECT o_orderkey AS r, o_orderkey % 20 AS k, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS cost, o_orderkey % 500 + 10 AS clicks, o_orderpriority, o_custkey FROM orders WHERE o_orderkey % {TOTAL} <> 0)"""
