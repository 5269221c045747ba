"""Weekly forecasts with a method chosen by rolling-origin backtests and a band from its errors.

Rows are summed to weeks first. Forecasts of all methods at all origins are made by windows and, for smoothing,
one fold for each series and pair of weights; choosing and banding are joins and grouped aggregates
over them. So any number of series and origins runs side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed parameters.
LEAST_WEEKS, MOST_HORIZON, BACKTEST, BAND, REPLAY, BAND_HISTORY = 26, 8, 12, (10, 90), 26, 12
METHODS = ["last_value", "ma4", "ma4_trend", "holt"]
HOLT_GRID = (0.2, 0.4, 0.6, 0.8)


def weekly_history(df: DataFrame, metrics: list[str], channel: str | None = None, by: str = "channel") -> DataFrame:
    """week and the sums of metrics for every calendar week, zero-filled, partial first and last weeks cut.

    Whether a week is whole is decided from the whole file, also for one channel.
    """
    dated = df.where("date is not null").withColumn("week", F.to_date(F.date_trunc("week", "date")))
    span = dated.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    first = F.when(F.col("a") == F.to_date(F.date_trunc("week", "a")), F.col("a")).otherwise(F.date_add(F.to_date(F.date_trunc("week", "a")), 7))
    last = F.when(F.dayofweek("b") == 1, F.to_date(F.date_trunc("week", "b"))).otherwise(F.date_sub(F.to_date(F.date_trunc("week", "b")), 7))
    weeks = span.select(F.when(first <= last, F.sequence(first, last, F.expr("interval 7 days"))).alias("w")).select(F.explode("w").alias("week"))
    rows = dated.where(F.col(by) == channel) if channel is not None else dated
    sums = rows.groupBy("week").agg(*(F.sum(F.col(m).cast("double")).alias(m) for m in metrics))
    return weeks.join(sums, "week", "left").select("week", *(F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics))


def long_history(history: DataFrame, metrics: list[str]) -> DataFrame:
    return history.unpivot(["week"], metrics, "metric", "value")


def wape_column(actual: Column, forecast: Column) -> Column:
    return F.try_divide(F.sum(F.abs(actual - forecast)), F.sum(F.abs(actual))) * 100


def simple_forecasts(long: DataFrame, steps: int = 4) -> DataFrame:
    """metric, origin, method, step, forecast for the first three methods at every origin, by window functions only."""
    order = Window.partitionBy("metric").orderBy("week")
    n = F.row_number().over(order)
    tail = order.rowsBetween(1 - BACKTEST, 0)
    x = F.col("n").cast("double")
    rows = long.withColumn("n", n)
    slope = F.try_divide(F.covar_pop(x, F.col("value")).over(tail), F.var_pop(x).over(tail))
    rows = rows.select("metric", F.col("n").alias("origin"), F.col("value").alias("last_value"), F.avg("value").over(order.rowsBetween(-3, 0)).alias("ma4"), F.coalesce(slope, F.lit(0.0)).alias("slope"))
    each = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    made = {"last_value": F.col("last_value"), "ma4": F.col("ma4"), "ma4_trend": F.col("ma4") + F.col("slope") * (F.col("step") + 1.5)}
    return each.select("metric", "origin", "step", F.explode(F.array(*(F.struct(F.lit(k).alias("method"), F.greatest(v, F.lit(0.0)).alias("forecast")) for k, v in made.items()))).alias("f")).select("metric", "origin", "step", "f.*")


def holt_forecasts(long: DataFrame, steps: int = MOST_HORIZON) -> DataFrame:
    """The same rows for exponential smoothing of level and trend.

    One fold over a series' values keeps, for a pair of weights, the state after each value, so the fit of an origin goes
    on from that of the origin before it. At each origin the weights with the least squared one-step errors
    count, ties to the first. An origin of one value repeats it.
    """
    series = long.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("week", "value"))).alias("s")).select("metric", F.transform("s", lambda x: x["value"]).alias("y"))
    grid = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate((a, b) for a in HOLT_GRID for b in HOLT_GRID)))
    fits = series.withColumn("w", F.explode(grid))
    a, b, y = F.col("w.a"), F.col("w.b"), F.col("y")
    state = lambda level, trend, error: F.struct(level.alias("level"), trend.alias("trend"), error.alias("error"))
    begin = F.array(state(F.get(y, F.lit(0)), F.coalesce(F.get(y, F.lit(1)) - F.get(y, F.lit(0)), F.lit(0.0)), F.lit(0.0)))

    def step(states, v):
        last = F.element_at(states, -1)
        guess = last["level"] + last["trend"]
        level = a * v + (1 - a) * guess
        return F.concat(states, F.array(state(level, b * (level - last["level"]) + (1 - b) * last["trend"], last["error"] + F.pow(v - guess, 2))))

    after = fits.select("metric", "w", F.posexplode(F.aggregate(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), begin, step)).alias("at", "s"))
    best = after.groupBy("metric", (F.col("at") + 1).alias("origin")).agg(F.min_by(F.struct("s.level", "s.trend"), F.struct("s.error", "w.place")).alias("f"))
    each = best.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    trend = F.when(F.col("origin") > 1, F.col("f.trend")).otherwise(0.0)
    return each.select("metric", "origin", "step", F.lit("holt").alias("method"), F.greatest(F.col("f.level") + trend * F.col("step"), F.lit(0.0)).alias("forecast"))


def chosen_forecasts(long: DataFrame, origins: DataFrame) -> DataFrame:
    """metric, origin, horizon, method, wape, step, forecast, low, high for rows (metric, origin, horizon).

    What is known at an origin are its values and their backtests only: the method with the least error over the last
    origins, ties to the simpler, and a band from its relative errors at the step, or at all steps if it has under three.
    """
    made = simple_forecasts(long, MOST_HORIZON).unionByName(holt_forecasts(long, MOST_HORIZON))
    values = long.select("metric", F.row_number().over(Window.partitionBy("metric").orderBy("week")).alias("n"), F.col("value").alias("actual"))
    tests = made.where("origin >= 4").withColumn("n", F.col("origin") + F.col("step")).join(values, ["metric", "n"]).select("metric", F.col("origin").alias("o"), "n", "step", "method", "actual", "forecast")
    known = origins.join(tests, "metric").where("n <= origin and step <= horizon")
    order = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    error = F.coalesce(wape_column(F.col("actual"), F.col("forecast")), F.lit(float("inf")))
    keys = ["metric", "origin", "horizon"]
    scores = known.where(F.col("o") >= F.col("origin") - BACKTEST).groupBy(*keys, "method").agg(error.alias("wape"))
    best = scores.groupBy(*keys).agg(F.min_by(F.struct("method", "wape"), F.struct("wape", order)).alias("b")).select(*keys, "b.*")
    relative = (F.col("actual") - F.col("forecast")) / F.col("forecast")
    errors = known.where(F.col("o") >= BAND_HISTORY).join(best, [*keys, "method"]).where("forecast != 0").select(*keys, "step", relative.alias("e"))
    band = F.percentile("e", F.array(*(F.lit(p / 100) for p in BAND))).alias("q")
    own = errors.groupBy(*keys, "step").agg(F.count("e").alias("n"), band).where("n >= 3").select(*keys, "step", F.col("q").alias("own"))
    pool = errors.groupBy(*keys).agg(band).select(*keys, F.col("q").alias("pool"))
    ahead = best.join(made.withColumnRenamed("forecast", "p"), ["metric", "origin", "method"]).where("step <= horizon").join(own, [*keys, "step"], "left").join(pool, keys, "left")
    q = F.coalesce("own", "pool", F.array(F.lit(0.0), F.lit(0.0)))
    p = F.col("p")
    return ahead.select(*keys, "method", "wape", F.col("step").cast("long").alias("step"), p.alias("forecast"), F.greatest(F.lit(0.0), F.least(p, p * (1 + q[0]))).alias("low"), F.greatest(p, p * (1 + q[1])).alias("high"))


def forecast_analysis(history: DataFrame, metrics: list[str], horizon: int = 4) -> DataFrame:
    """metric, method, wape, step, week, forecast, low, high; nothing under 26 full weeks."""
    if not 1 <= horizon <= MOST_HORIZON:
        raise ValueError(f"horizon must be 1 to {MOST_HORIZON}")
    long = long_history(history, metrics)
    ends = long.groupBy("metric").agg(F.count(F.lit(1)).cast("int").alias("origin"), F.max("week").alias("last")).where(F.col("origin") >= LEAST_WEEKS)
    found = chosen_forecasts(long, ends.select("metric", "origin", F.lit(horizon).alias("horizon"))).join(ends.select("metric", "last"), "metric")
    return found.select("metric", "method", "wape", "step", "forecast", "low", "high", F.expr("date_add(last, CAST(7 * step AS INT))").alias("week"))


def range_coverage(history: DataFrame, metrics: list[str], horizon: int = MOST_HORIZON, weeks: int = REPLAY) -> DataFrame:
    """metric, checked, inside: how many of the last weeks lay within the band that the weeks before gave."""
    long = long_history(history, metrics)
    n = F.row_number().over(Window.partitionBy("metric").orderBy("week"))
    numbered = long.select("metric", n.alias("n"), "value", F.count(F.lit(1)).over(Window.partitionBy("metric")).cast("int").alias("size"))
    asked = numbered.select("metric", (F.col("n") - 1).alias("origin"), F.least(F.lit(horizon), F.col("size") - F.col("n") + 1).alias("horizon"), "value", "size").where((F.col("origin") >= LEAST_WEEKS) & (F.col("origin") >= F.col("size") - weeks))
    found = chosen_forecasts(long, asked.select("metric", "origin", "horizon")).where("step = 1").join(asked.select("metric", "origin", "value"), ["metric", "origin"])
    within = found.groupBy("metric").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("value").between(F.col("low"), F.col("high"))).alias("inside"))
    return long.select("metric").distinct().join(within, "metric", "left").select("metric", F.coalesce("checked", F.lit(0)).cast("long").alias("checked"), F.coalesce("inside", F.lit(0)).cast("long").alias("inside"))
