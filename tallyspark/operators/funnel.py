"""Funnel stages, rates and drop-offs, overall and by channel, from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.schema import FUNNEL_STAGES


def _stages(columns: list[str]) -> Column:
    present = [s for s in FUNNEL_STAGES if s in columns]
    return F.filter(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage"), F.col(s).alias("value")) for i, s in enumerate(present))), lambda x: x["value"].isNotNull())


def _rates(long: DataFrame, keys: list[str]) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("place"))
    rate = F.try_divide(F.col("value"), before) * 100
    return long.select(*keys, "place", "stage", "value", rate.alias("rate"), (100 - rate).alias("drop_off"))


def funnel_table(df: DataFrame) -> DataFrame:
    """place, stage, value, rate and drop_off against the stage before; revenue last, without a rate. At least two stages."""
    names = [c for c in [*FUNNEL_STAGES, "revenue"] if c in df.columns]
    totals = df.agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in names)).withColumn("scope", F.lit("all"))
    return _from_totals(totals, ["scope"])


def funnel_by_channel(df: DataFrame, by: str = "channel") -> DataFrame:
    """The same for each known channel; which stages a channel has is decided for it alone."""
    names = [c for c in [*FUNNEL_STAGES, "revenue"] if c in df.columns]
    totals = df.where(F.col(by).isNotNull()).groupBy(by).agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in names))
    return _from_totals(totals, [by])


def _from_totals(totals: DataFrame, keys: list[str]) -> DataFrame:
    some = totals.withColumn("_stages", _stages(totals.columns)).where(F.size("_stages") >= 2)
    rated = _rates(some.select(*keys, F.explode("_stages").alias("s")).select(*keys, "s.*"), keys)
    if "revenue" not in totals.columns:
        return rated
    none = F.lit(None).cast("double")
    money = some.where("revenue is not null").select(*keys, F.lit(len(FUNNEL_STAGES)).alias("place"), F.lit("revenue").alias("stage"), F.col("revenue").alias("value"), none.alias("rate"), none.alias("drop_off"))
    return rated.unionByName(money)


def biggest_drop_off(funnel: DataFrame, keys: list[str], skip_first: bool = True) -> DataFrame:
    """The stage with the lowest rate for each key; the step to clicks may be left out."""
    rows = funnel.where("rate is not null")
    if skip_first:
        rows = rows.where("stage != 'clicks'")
    lowest = F.min(F.struct("rate", "place", "stage", "drop_off")).alias("m")
    return rows.groupBy(*keys).agg(lowest).select(*keys, "m.stage", "m.rate", "m.drop_off")
