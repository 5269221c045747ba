"""Budget pacing: the daily plan of whole months, where spend stands, and where it is heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.kpi import channel_type

BAND, RECENT = 0.05, 7


def pacing_status(ratio: Column, band: float = BAND) -> Column:
    """By spend over plan; the band is inclusive."""
    return (
        F.when(ratio.isNull(), "Not available").when(F.abs(ratio - 1) <= band + 1e-9, "On pace")
        .when(ratio > 1, "Overspending").otherwise("Underspending")
    )


def daily_plan(df: DataFrame, monthly_budget: float | None = None, by: str | None = None) -> DataFrame:
    """One row a calendar day of the months that the data touch (and key): spend, planned, has_data.

    The plan is the budget column's sum; a given monthly budget is spread evenly over its days instead.
    The grid is days by keys, a small product whose size does not grow with the rows.
    """
    key = [F.coalesce(F.col(by), F.lit("(none)")).alias(by)] if by else []
    names = [by] if by else []
    dated = df.where("date is not null")
    sums = dated.groupBy(*key, "date").agg(F.sum(F.col("spend").cast("double")).alias("spend"), (F.sum(F.col("budget").cast("double")) if monthly_budget is None else F.lit(None).cast("double")).alias("planned"))
    span = sums.groupBy(*names).agg(F.trunc(F.min("date"), "month").alias("a"), F.last_day(F.max("date")).alias("b"))
    days = span.select(*names, F.explode(F.sequence("a", "b")).alias("date"))
    plan = days.join(sums.withColumn("has_data", F.lit(True)), [*names, "date"], "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))
    if monthly_budget is not None:
        plan = plan.withColumn("planned", F.lit(float(monthly_budget)) / F.day(F.last_day("date")))
    return plan.select(*names, "date", "spend", "planned", "has_data")


def pace_as_of(daily: DataFrame, as_of: str | None = None, by: str | None = None, recent: int = RECENT) -> DataFrame:
    """Planned and spent so far in the month, what remains, and the projected month end, for each key.

    as_of is clamped to the days with data. Later days without a plan count at the mean plan of the last days.
    """
    names = [by] if by else []
    whole = Window.partitionBy()
    seen = [F.max(F.when(F.col("has_data"), F.col("date"))).over(whole), F.min(F.when(F.col("has_data"), F.col("date"))).over(whole)]
    rows = daily.withColumn("_d", F.greatest(seen[1], F.least(seen[0], F.lit(as_of).cast("date"))) if as_of else seen[0])
    day, at = F.col("date"), F.col("_d")
    mtd = day.between(F.trunc("_d", "month"), at)
    rest = (day > at) & (day <= F.last_day("_d"))
    near = day.between(F.date_sub("_d", recent - 1), at)
    known = F.col("has_data") | F.col("planned").isNotNull()

    def total(c: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0.0))

    sums = rows.groupBy(*names, F.col("_d").alias("as_of")).agg(
        total("planned", mtd).alias("planned_to_date"), total("spend", mtd).alias("spend_to_date"), total("planned", rest & known).alias("_rest"), F.count(F.when(rest & ~known, 1)).alias("estimated_days"),
        total("planned", near).alias("_near_plan"), total("spend", near).alias("_near_spend"), F.count(F.when(near, 1)).alias("_near_days"),
    )
    ratio = F.try_divide("spend_to_date", "planned_to_date")
    remaining = F.col("_rest") + F.col("estimated_days") * F.coalesce(F.try_divide("_near_plan", "_near_days"), F.lit(0.0))
    pace = F.coalesce(F.try_divide("_near_spend", "_near_plan"), ratio)
    out = sums.withColumn("pacing_ratio", ratio).withColumn("_remaining", remaining)
    projected = F.when(F.col("_remaining") <= 0, F.col("spend_to_date")).otherwise(F.col("spend_to_date") + F.col("_remaining") * pace)
    budget = F.col("planned_to_date") + F.col("_remaining")
    return out.select(*names, "as_of", "planned_to_date", "spend_to_date", "pacing_ratio", "estimated_days", budget.alias("month_budget"), projected.alias("projected_spend"), (projected - budget).alias("projected_variance"), pacing_status(F.col("pacing_ratio")).alias("status"))


def monthly_table(daily: DataFrame) -> DataFrame:
    """Budget, spend, utilisation and variance by month over the days with data; unfinished months are partial."""
    months = daily.where("has_data").groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.coalesce(F.sum("planned"), F.lit(0.0)).alias("budget"), F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"), F.count(F.lit(1)).alias("days"), F.max(F.day(F.last_day("date"))).alias("calendar_days")
    )
    used = F.try_divide("spend", "budget")
    status = F.when(F.col("days") < F.col("calendar_days"), "Partial month").otherwise(pacing_status(used))
    return months.select("month", "budget", "spend", "days", "calendar_days", (used * 100).alias("budget_utilisation"), (F.col("spend") - F.col("budget")).alias("variance"), status.alias("status"))


def entity_pacing(df: DataFrame, by: str, as_of: str | None = None) -> DataFrame:
    """Pacing of each channel or campaign, paid ones first, then by budget."""
    paced = pace_as_of(daily_plan(df, by=by), as_of, by)
    owned = (channel_type(F.col(by)) == "owned") if by in ("channel", "platform") else F.lit(False)
    return paced.withColumn("owned", owned).orderBy("owned", F.desc("month_budget"), by)


def pacing_analysis(df: DataFrame, present: set[str], as_of: str | None = None, monthly_budget: float | None = None) -> dict[str, DataFrame] | None:
    """overall and monthly pacing; by channel where the data have a budget, which wins over a given one. None without dates, spend or budget."""
    column = "budget" in present
    if not {"date", "spend"} <= present or (not column and not (monthly_budget or 0) > 0):
        return None
    daily = daily_plan(df, None if column else monthly_budget)
    out = {"overall": pace_as_of(daily, as_of), "monthly": monthly_table(daily)}
    for key in ("channel", "campaign_name"):
        if column and key in present:
            out[key] = entity_pacing(df, key, as_of)
    return out
