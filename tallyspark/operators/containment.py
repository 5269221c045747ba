"""Which sets lie wholly in which others, by bitmaps.

Members get dense codes, a set is a bitmap over them in rows of 2**15 bits, so a set costs one row for each
stretch of codes that it touches, however many members it has there. A set lies in another one if, in each stretch that
it touches, the union of both has no more members than the other alone. Only stretches in which the other has at least as
many members are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.shared import new_folder

BITS = 1 << 15


def dense_codes(members: DataFrame) -> DataFrame:
    """member, code (from 0 without gaps, in order) of the distinct values of a column ``member``.

    Values are range-partitioned and numbered within their partitions, whose sizes (a small table) are added up.
    """
    spark = members.sparkSession
    path = f"{new_folder(spark, 'codes')}/members"
    members.where("member is not null").select("member").distinct().repartitionByRange("member").select("member", F.spark_partition_id().alias("part")).write.parquet(path)
    own = spark.read.parquet(path)
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy("member")) - 1
    return own.withColumn("place", place).join(sizes.select("part", before.alias("before")), "part").select("member", (F.col("before") + F.col("place")).alias("code"))


def bitmaps(sets: DataFrame, codes: DataFrame) -> DataFrame:
    """id, stretch, bits, n for rows (id, member). Bitmaps of tasks are put together by bits, so members may repeat."""
    coded = sets.where("id is not null").join(codes, "member").select("id", (F.col("code") / BITS).cast("long").alias("stretch"), (F.col("code") % BITS).alias("bit"))
    return coded.groupBy("id", "stretch").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("n", F.bitmap_count("bits"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """id, other, n: sets of ``inner`` that lie in sets of ``outer``, and their size. Both: id, member; sets without members don't come."""
    codes = dense_codes(inner.select("member").unionByName(outer.select("member")))
    a = bitmaps(inner, codes)
    b = bitmaps(outer, codes).select(F.col("id").alias("other"), "stretch", F.col("bits").alias("other_bits"), F.col("n").alias("other_n"))
    totals = a.groupBy("id").agg(F.count(F.lit(1)).alias("stretches"), F.sum("n").alias("n"))
    pairs = a.join(b, "stretch").where("other_n >= n").select("id", "other", "stretch", "other_n", F.explode(F.array("bits", "other_bits")).alias("bits"))
    union = pairs.groupBy("id", "other", "stretch", "other_n").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("union_n"))
    inside = union.where("union_n = other_n").groupBy("id", "other").agg(F.count(F.lit(1)).alias("inside"))
    return inside.join(totals, "id").where("inside = stretches").select("id", "other", "n")
