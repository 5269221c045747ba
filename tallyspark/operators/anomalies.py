"""Weekly anomalies against a robust baseline, and tracking outages by day.

Rows are first aggregated to (entity, week). The grid of entities and weeks has the weeks near those with rows only,
stays long, and every statistic is a window over it or, for the common move of a week, a grouped median.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.anomaly import BASELINE, baseline, before, both_least, islands, rolling, spread
from tallyspark.functions.kpi import BETTER


@dataclass(frozen=True)
class Metric:
    numerator: str
    denominator: str | None
    scale: float
    least_volume: float
    count: str | None  # events behind a ratio, for the count test


# Fixed thresholds of the detector.
METRICS = {
    "spend": Metric("spend", None, 1, 10_000, None),
    "revenue": Metric("revenue", None, 1, 50_000, "conversions"),
    "clicks": Metric("clicks", None, 1, 200, "clicks"),
    "cpc": Metric("spend", "clicks", 1, 200, "clicks"),
    "cpl": Metric("spend", "leads", 1, 20, "leads"),
    "lead_qualification_rate": Metric("qualified_leads", "leads", 100, 30, "qualified_leads"),
    "lead_to_conversion_rate": Metric("conversions", "leads", 100, 50, "conversions"),
}
SCORE, PCT, FLOOR, SUSTAINED, WINDOWS = 4.0, 30.0, 0.05, 0.15, (1, 3)
HIGH_SCORE, HIGH_PCT, ENTITIES = 6.0, 50.0, 3
#: So many weeks before a week with rows, the windows of the detector look.
REACH = BASELINE + max(WINDOWS) - 1


def weekly_sums(df: DataFrame, entity: str, metrics: list[str] | None = None) -> DataFrame:
    """entity, week, full and, by metric, num, den and events: all metrics whose columns df has, in one aggregate."""
    known = df.where(F.col(entity).isNotNull() & F.col("date").isNotNull()).withColumn("week", F.to_date(F.date_trunc("week", "date")))
    sums = []
    for metric in present(df, metrics):
        spec = METRICS[metric]
        n, d = F.col(spec.numerator).cast("double"), F.col(spec.denominator).cast("double") if spec.denominator else F.lit(1.0)
        both = n.isNotNull() & d.isNotNull()
        events = F.sum(F.col(spec.count).cast("double")) if spec.count else F.lit(None).cast("double")
        sums += [F.sum(F.when(both, n)).alias(f"{metric}_num"), F.sum(F.when(both, d)).alias(f"{metric}_den"), events.alias(f"{metric}_events")]
    return known.groupBy(F.col(entity).alias("entity"), "week").agg(*sums, (F.countDistinct("date") == 7).alias("full"))


def present(df: DataFrame, metrics: list[str] | None = None) -> list[str]:
    """The metrics whose columns df has."""
    return [m for m in metrics or METRICS if METRICS[m].numerator in df.columns and (METRICS[m].denominator or "date") in df.columns]


def near_presence(rows: DataFrame, keys: list[str], weeks: DataFrame, reach: int = REACH) -> DataFrame:
    """keys and every existing week that lies within ``reach`` weeks of one in which the key has rows.

    All windows of the detector look no farther than that from a week with rows, and what lies beyond has no values. Each
    week with rows adds the weeks that the one before it didn't, so the result grows with what there is, not with
    keys times weeks. rows: keys and week; weeks: the existing weeks, a small table.
    """
    numbered = weeks.select("week", F.row_number().over(Window.orderBy("week")).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("_last"))
    own = rows.select(*keys, "week").distinct().join(numbered, "week")
    covered = F.lag("_n").over(Window.partitionBy(*keys).orderBy("_n")) + reach
    first = F.greatest(F.col("_n") - reach, F.coalesce(covered + 1, F.lit(1)), F.lit(1))
    spans = own.select(*keys, first.alias("_first"), F.least(F.col("_n") + reach, "_last").alias("_to")).where("_first <= _to")
    return spans.select(*keys, F.explode(F.sequence("_first", "_to")).alias("_n")).join(numbered.select("_n", "week"), "_n").select(*keys, "week")


def grid_of(sums: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, entity, week, num, den, events, full of the metrics, on the existing weeks near each entity's own."""
    grid = near_presence(sums, ["entity"], sums.select("week").distinct())
    whole = grid.join(sums, ["entity", "week"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"{m}_{c}").alias(c) for c in ("num", "den", "events"))) for m in metrics))
    return whole.select("entity", "week", "full", F.explode(cells).alias("e")).select("entity", "week", "e.*", "full")


def weekly_grid(df: DataFrame, entity: str, metric: str) -> DataFrame:
    """entity, week, num, den, events, full: totals on the existing weeks near each entity's own."""
    return grid_of(weekly_sums(df, entity, [metric]), [metric]).drop("metric")


def stable_composition(df: DataFrame, entity: str, campaign: str) -> DataFrame:
    """entity, week, stable: every campaign of the entity was on or off, wholly, throughout the last nine weeks."""
    rows = df.where(F.col(entity).isNotNull() & F.col(campaign).isNotNull()).withColumn("week", F.to_date(F.date_trunc("week", "date")))
    days = rows.groupBy(F.col(entity).alias("entity"), F.col(campaign).alias("campaign"), "week").agg(F.countDistinct("date").alias("days"))
    weeks = days.select("week").distinct()
    grid = near_presence(days, ["entity", "campaign"], weeks).join(days, ["entity", "campaign", "week"], "left")
    marked = grid.select("entity", "campaign", "week", (F.coalesce("days", F.lit(0)) > 0).cast("int").alias("on"), F.coalesce(F.col("days").between(1, 6), F.lit(False)).alias("part"))
    frame = rolling(["entity", "campaign"], "week", 9)
    same = (F.max("on").over(frame) == F.min("on").over(frame)) & ~F.bool_or("part").over(frame)
    return marked.withColumn("same", same).groupBy("entity", "week").agg(F.bool_and("same").alias("stable"))


def judge(grid: DataFrame, metric: str, window: int, unstable: DataFrame | None = None) -> DataFrame:
    """grid with baseline, value, score and pct for windows of so many weeks."""
    return judge_all(grid.withColumn("metric", F.lit(metric)), [metric], window, unstable).drop("metric")


def judge_all(grid: DataFrame, metrics: list[str], window: int, unstable: DataFrame | None = None) -> DataFrame:
    """judge of a grid with several metrics, each by itself, in one set of windows."""
    shift = window - 1

    def of(f: Callable[[Metric], object]) -> Column:
        return F.create_map(*(F.lit(x) for m in metrics for x in (m, f(METRICS[m]))))[F.col("metric")]

    key, frame = ["metric", "entity"], rolling(["metric", "entity"], "week", window)
    long, near = before(key, "week", shift), before(key, "week", 0)
    ratio, scale = of(lambda x: x.denominator is not None), of(lambda x: float(x.scale))
    t = grid
    if unstable is not None:
        t = t.join(unstable, ["entity", "week"], "left").withColumn("full", F.col("full") & F.coalesce("stable", F.lit(True)))
    t = t.withColumn("value1", F.when(ratio, F.try_divide("num", "den") * scale).otherwise(F.col("num")))
    t = t.withColumn("ok1", F.col("full") & F.col("value1").isNotNull()).withColumn("known", F.when(F.col("ok1"), F.col("value1")))
    volume = F.when(F.col("ok1"), F.when(ratio, F.col("den")).otherwise(F.col("num")))
    t = t.select(
        "*", baseline(F.col("known"), long).alias("base"), baseline(F.col("known"), near).alias("base1"), baseline(volume, long).alias("base_volume"),
        baseline(F.when(F.col("ok1"), F.col("events")), long).alias("base_events"), F.sum("num").over(frame).alias("_n"), F.sum("den").over(frame).alias("_d"),
        (F.count("num").over(frame) == window).alias("_whole"), ((F.count(F.when(F.col("ok1"), 1)).over(frame) == window)).alias("_ok"),
    )
    value = F.when(ratio, F.try_divide("_n", "_d") * scale).otherwise(F.col("_n") / window)
    t = t.withColumn("value", F.when(F.col("_whole"), value))
    fine = F.col("_ok") & F.col("base").isNotNull() & (F.col("base") != 0) & (F.col("base_volume") >= of(lambda x: float(x.least_volume)))
    t = t.withColumn("ok", F.coalesce(fine, F.lit(False)))
    t = t.withColumn("r", F.when(F.col("ok"), F.try_divide("value", "base"))).withColumn("r1", F.when(F.col("ok1"), F.try_divide("value1", "base1")))
    # medians of a week from counted values, combined before the shuffle; rows stay where they are
    moves = t.groupBy("metric", "week").agg(*(F.when(F.count(c) >= ENTITIES, F.percentile(c, 0.5)).otherwise(1.0).alias(name) for c, name in (("r", "common"), ("r1", "common1"))))
    t = t.join(moves, ["metric", "week"])
    t = t.withColumn("a", F.try_divide("r", "common")).withColumn("a1", F.try_divide("r1", "common1"))
    wide = spread(F.col("a1"), long) * 1.4826 / window**0.5
    t = t.withColumn("spread", F.when(wide.isNotNull(), F.greatest(wide, F.lit(FLOOR))))
    t = t.withColumn("score", (F.col("a") - 1) / F.col("spread"))
    counted = [m for m in metrics if METRICS[m].count]
    if counted:
        expected = F.col("base_events") * window
        z = 2 * (F.sqrt(F.greatest(F.col("a") * expected, F.lit(0.0))) - F.sqrt(expected))
        least = F.signum("score") * both_least(F.abs("score"), F.abs(F.when(F.col("a").isNotNull() & expected.isNotNull(), z)))
        t = t.withColumn("score", F.when(F.col("metric").isin(counted), least).otherwise(F.col("score")))
    t = t.withColumn("pct", (F.col("a") - 1) * 100)
    if window > 1:
        up, down = (F.when((s * (F.col("a1") - 1)) >= SUSTAINED, 1).otherwise(0) for s in (1, -1))
        t = t.withColumn("sustained", F.when(F.col("pct") > 0, F.sum(up).over(frame)).otherwise(F.sum(down).over(frame)) >= window - 1)
    else:
        t = t.withColumn("sustained", F.lit(True))
    flag = F.col("ok") & (F.abs("score") >= SCORE) & (F.abs("pct") >= PCT) & F.col("sustained")
    return t.select("metric", "entity", "week", "value", (F.col("base") * F.col("common")).alias("baseline"), "score", "pct", F.coalesce(flag, F.lit(False)).alias("flag"))


def weekly_anomalies(df: DataFrame, entity: str, entity_type: str, campaign: str | None = None, metrics: list[str] | None = None, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Flagged periods of an entity type, merged where they overlap or touch; the strongest one speaks for each.

    store writes a small table and gives it back, so that all metrics share one pass over the rows.
    """
    store = store or (lambda t: t)
    unstable = store(stable_composition(df, entity, campaign)) if campaign and entity_type != "campaign" else None
    sums = store(weekly_sums(df, entity, metrics))
    known = present(df, metrics)
    grid = grid_of(sums, known)
    flagged = None
    for window in WINDOWS:
        found = store(judge_all(grid, known, window, unstable).where("flag").select(
            "entity", "metric", F.date_sub("week", 7 * (window - 1)).alias("start"), F.date_add("week", 6).alias("end"),
            "value", "baseline", "score", "pct", F.signum("score").cast("int").alias("sign"),
        ))
        flagged = found if flagged is None else flagged.unionByName(found)
    return merge_periods(flagged).withColumn("entity_type", F.lit(entity_type))


def merge_periods(flagged: DataFrame) -> DataFrame:
    """One row for each run of periods of an entity, metric and sign, with the values of its peak."""
    key = ["entity", "metric", "sign"]
    runs = islands(flagged, key, "start", "end").groupBy(*key, "island")
    peak = F.max_by(F.struct("value", "baseline", "score", "pct"), F.struct(F.abs("score"), -F.unix_date("start"))).alias("peak")
    out = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), peak).select(*key, "start", "end", "peak.*")
    good = F.create_map(*(F.lit(x) for k, b in BETTER.items() for x in (k, b)))[F.col("metric")]
    up = F.col("pct") > 0
    sentiment = F.when(F.col("metric") == "spend", "check").when(good == "none", "check").when((good == "up") == up, "positive").otherwise("negative")
    severity = F.when((F.abs("score") >= HIGH_SCORE) & (F.abs("pct") >= HIGH_PCT), "high").otherwise("medium")
    return out.withColumn("direction", F.when(up, "above").otherwise("below")).withColumn("sentiment", sentiment).withColumn("severity", severity)


# outages

OUTAGE_DAYS, LOW_CLICKS, SOME_SPEND, LEAST_CLICKS, LEAST_DAYS = 28, 0.05, 0.25, 20, 7


def outage_days(df: DataFrame, campaign: str) -> DataFrame:
    """campaign, date, clicks, spend and the medians of the 28 calendar days before, for days that look like a tracking outage."""
    daily = df.where(F.col(campaign).isNotNull()).groupBy(F.col(campaign).alias("campaign"), "date").agg(F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"), F.sum("clicks").alias("clicks"))
    past = Window.partitionBy("campaign").orderBy(F.unix_date("date")).rangeBetween(-OUTAGE_DAYS, -1)

    def base(c: str):
        return F.when(F.count(c).over(past) >= LEAST_DAYS, F.percentile(c, 0.5).over(past))

    t = daily.select("*", base("clicks").alias("base_clicks"), base("spend").alias("base_spend"))
    return t.where((F.col("spend") > 0) & (F.col("base_clicks") >= LEAST_CLICKS) & (F.col("clicks") <= LOW_CLICKS * F.col("base_clicks")) & (F.col("spend") >= SOME_SPEND * F.col("base_spend")))


def tracking_outages(df: DataFrame, campaign: str, owner: str) -> DataFrame:
    """owner, start, end, days, observed, baseline, campaigns: runs of outage days by the campaigns' main owner."""
    owners = df.where(F.col(campaign).isNotNull()).groupBy(F.col(campaign).alias("campaign")).agg(F.mode(owner, True).alias("owner"))
    hits = outage_days(df, campaign).join(owners, "campaign")
    daily = hits.groupBy("owner", "date").agg(F.sum("clicks").alias("clicks"), F.sum("base_clicks").alias("base"), F.collect_set("campaign").alias("campaigns"))
    run = F.date_sub("date", F.row_number().over(Window.partitionBy("owner").orderBy("date")))
    return daily.withColumn("run", run).groupBy("owner", "run").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days"), F.avg("clicks").alias("observed"), F.avg("base").alias("baseline"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("campaigns")))).alias("campaigns"),
    ).drop("run")
