"""The driver's sales tables read as campaign data; the same SELECT serves Spark and the reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["lineitem", "orders", "customer", "nation", "region", "part"]

_SELECT = """
SELECT CAST(l_shipdate AS DATE) AS date, {campaign} AS campaign_name, o_orderpriority AS channel, l_returnflag AS platform,
       r_name AS region, c_mktsegment AS customer_segment, p_type AS product_category,
       l_extendedprice * l_discount AS spend, l_extendedprice * 0.06e0 AS budget,
       CAST(l_quantity * 40 AS DOUBLE) AS impressions, CAST(l_quantity AS DOUBLE) AS clicks,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(floor(l_quantity / 5) AS DOUBLE) END AS leads,
       CAST(floor(l_quantity / 10) AS DOUBLE) AS qualified_leads, CAST(floor(l_quantity / 20) AS DOUBLE) AS conversions,
       CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice * (1 - l_discount) * 0.2e0 END AS revenue,
       l_extendedprice * l_tax AS gross_profit
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
     JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey JOIN {part} ON l_partkey = p_partkey
"""


def campaign_rows(spark: SparkSession, sf_dir: str, campaign: str = "p_brand") -> DataFrame:
    """One row a line item. Only the columns that a query uses reach the Parquet scans."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(_SELECT.format(campaign=campaign, **{t: "{" + t + "}" for t in TABLES}), **frames)


def campaign_sql(campaign: str = "p_brand") -> str:
    """The same rows as the common table expression m."""
    return "m AS (" + _SELECT.format(campaign=campaign, **{t: t for t in TABLES}) + ")"
