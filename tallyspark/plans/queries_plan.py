"""Pacing, targets, forecasts, response curves, scenarios, findings and answer checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.kpi import presence
from tallyspark.operators import channel as C
from tallyspark.operators import findings as FI
from tallyspark.operators import forecast as FC
from tallyspark.operators import funnel as FU
from tallyspark.operators import pacing as P
from tallyspark.operators import response as RC
from tallyspark.operators import standouts as SO
from tallyspark.operators import targets as T
from tallyspark.operators.group import group_kpis, kpi_table, period_comparison
from tallyspark.sources.shared import new_folder

from .build import PRESENT, Registry, measure_sql, rounded, totals_and_ratios
from .canonical import campaign_rows

R = Registry()
rows = campaign_rows

# pacing

_PLAN = """, dp AS (SELECT date, sum(spend) AS spend, sum(budget) AS planned FROM m GROUP BY date),
 sp AS (SELECT CAST(date_trunc('month', min(date)) AS DATE) AS a, last_day(max(date)) AS b FROM dp),
 dy AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
 pl AS (SELECT dy.date, spend, planned, dp.date IS NOT NULL AS has_data FROM dy LEFT JOIN dp USING (date))"""


@R.add("ag_17", _PLAN + " SELECT date, round(spend, 4) AS spend, round(planned, 4) AS planned, has_data FROM pl", dates=("date",))
def ag_17(spark, sf_dir):
    return rounded(P.daily_plan(rows(spark, sf_dir)))


def _pace_sql(source: str, keys: str, as_of: str) -> str:
    k = f"{keys}, " if keys else ""
    return f""", pa AS (SELECT {k}as_of, coalesce(sum(planned) FILTER (date >= date_trunc('month', as_of) AND date <= as_of), 0) AS ptd, coalesce(sum(spend) FILTER (date >= date_trunc('month', as_of) AND date <= as_of), 0) AS std,
   coalesce(sum(planned) FILTER (date > as_of AND date <= last_day(as_of) AND (has_data OR planned IS NOT NULL)), 0) AS rest, count(*) FILTER (date > as_of AND date <= last_day(as_of) AND NOT (has_data OR planned IS NOT NULL)) AS est,
   coalesce(sum(planned) FILTER (date BETWEEN as_of - 6 AND as_of), 0) AS np, coalesce(sum(spend) FILTER (date BETWEEN as_of - 6 AND as_of), 0) AS ns, count(*) FILTER (date BETWEEN as_of - 6 AND as_of) AS nd
   FROM (SELECT *, {as_of} AS as_of FROM {source}) GROUP BY {k}as_of),
 pb AS (SELECT *, std / nullif(ptd, 0) AS ratio, rest + est * coalesce(np / nullif(nd, 0), 0) AS remaining, ns / nullif(np, 0) AS near FROM pa),
 pc AS (SELECT {k}as_of, ptd AS planned_to_date, std AS spend_to_date, ratio AS pacing_ratio, est AS estimated_days, ptd + remaining AS month_budget, CASE WHEN remaining <= 0 THEN std ELSE std + remaining * coalesce(near, ratio) END AS projected_spend FROM pb)"""


_STATUS = "CASE WHEN {r} IS NULL THEN 'Not available' WHEN abs({r} - 1) <= 0.05 + 1e-9 THEN 'On pace' WHEN {r} > 1 THEN 'Overspending' ELSE 'Underspending' END"
_PACE_OUT = "round(planned_to_date, 4) AS planned_to_date, round(spend_to_date, 4) AS spend_to_date, round(pacing_ratio, 4) AS pacing_ratio, estimated_days, round(month_budget, 4) AS month_budget, round(projected_spend, 4) AS projected_spend, round(projected_spend - month_budget, 4) AS projected_variance, " + _STATUS.format(r="pacing_ratio") + " AS status"
for _name, _as_of in (("ag_18", "DATE '1998-03-10'"), ("kpi_pacing", "DATE '2000-06-20'")):

    @R.add(_name, _PLAN + _pace_sql("pl", "", _as_of) + f" SELECT as_of, {_PACE_OUT} FROM pc", dates=("as_of",))
    def _pace(spark, sf_dir, as_of=_as_of[6:-1]):
        return rounded(P.pace_as_of(P.daily_plan(rows(spark, sf_dir)), as_of))


@R.add("ag_19", _PLAN + f", mo AS (SELECT strftime(date, '%Y-%m') AS month, coalesce(sum(planned), 0) AS budget, coalesce(sum(spend), 0) AS spend, count(*) AS days, max(day(last_day(date))) AS calendar_days FROM pl WHERE has_data GROUP BY 1) SELECT month, round(budget, 4) AS budget, round(spend, 4) AS spend, days, CAST(calendar_days AS INTEGER) AS calendar_days, round(spend / nullif(budget, 0) * 100, 4) AS budget_utilisation, round(spend - budget, 4) AS variance, CASE WHEN days < calendar_days THEN 'Partial month' ELSE {_STATUS.format(r='spend / nullif(budget, 0)')} END AS status FROM mo")
def ag_19(spark, sf_dir):
    return rounded(P.monthly_table(P.daily_plan(rows(spark, sf_dir))))


_PLAN_BY = """, kp AS (SELECT channel, date, sum(spend) AS spend, sum(budget) AS planned FROM m GROUP BY 1, 2),
 ks AS (SELECT channel, CAST(date_trunc('month', min(date)) AS DATE) AS a, last_day(max(date)) AS b FROM kp GROUP BY 1),
 ky AS (SELECT channel, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM ks),
 kl AS (SELECT channel, ky.date, spend, planned, kp.date IS NOT NULL AS has_data FROM ky LEFT JOIN kp USING (channel, date))"""
for _name in ("ag_20", "srt_04"):

    @R.add(_name, _PLAN_BY + _pace_sql("kl", "channel", "DATE '1999-08-17'") + f" SELECT channel, as_of, {_PACE_OUT}, false AS owned FROM pc", dates=("as_of",))
    def _by_channel(spark, sf_dir):
        return rounded(P.entity_pacing(rows(spark, sf_dir), "channel", "1999-08-17"))


@R.add("ag_21", _PLAN + _pace_sql("pl", "", "(SELECT max(date) FROM dp)") + f" SELECT as_of, {_PACE_OUT} FROM pc", dates=("as_of",))
def ag_21(spark, sf_dir):
    return rounded(P.pacing_analysis(rows(spark, sf_dir), PRESENT, as_of="2030-01-01")["overall"])


# targets

_TARGETS = [("spend", 1_500_000.0), ("revenue", 3_000_000.0), ("roas", 4.0), ("cpl", 500.0)]
_TARGET_SQL = ", tg(kpi, target) AS (VALUES " + ", ".join(f"('{k}', {v}e0)" for k, v in _TARGETS) + ")"
_BETTER = "CASE kpi WHEN 'cpl' THEN 'down' WHEN 'spend' THEN 'none' ELSE 'up' END"
_RATED = f""", rt AS (SELECT *, round((actual - target) / nullif(abs(target), 0) * 100, 9) AS gap FROM lo JOIN tg USING (kpi)),
 rs AS (SELECT *, CASE WHEN actual IS NULL THEN 'Not available' WHEN kpi = 'spend' THEN CASE WHEN abs(gap) <= 5 THEN 'On target' WHEN abs(gap) <= 10 THEN 'Within 10%' WHEN gap > 0 THEN 'Over' ELSE 'Under' END
   ELSE CASE WHEN CASE WHEN {_BETTER} = 'down' THEN gap ELSE -gap END <= 0 THEN 'On target' WHEN CASE WHEN {_BETTER} = 'down' THEN gap ELSE -gap END <= 10 THEN 'Within 10%' ELSE 'Off target' END END AS status FROM rt)"""
_KPIS = [k for k, _ in _TARGETS]


def _targets(spark) -> DataFrame:
    return spark.createDataFrame(_TARGETS, "kpi string, target double")


def _long_sql(key: str, group: str, extra: str = "") -> str:
    return ", lo AS (" + " UNION ALL ".join(f"SELECT {group} AS {key}{extra}, '{k}' AS kpi, {measure_sql(k)} AS actual FROM m GROUP BY 1" for k in _KPIS) + ")"


_MONTH = "strftime(date, '%Y-%m')"


@R.add("ag_25", _TARGET_SQL + _long_sql("month", _MONTH, ", count(DISTINCT date) = max(day(last_day(date))) AS complete") + _RATED + " SELECT month, kpi, round(actual, 4) AS actual, target, round(gap, 4) AS gap_pct, CASE WHEN complete THEN status ELSE 'Partial month' END AS status FROM rs")
def ag_25(spark, sf_dir):
    return rounded(T.by_month(rows(spark, sf_dir), _targets(spark), _KPIS, PRESENT))


@R.add("srt_05", _TARGET_SQL + _long_sql("month", _MONTH, ", count(DISTINCT date) = max(day(last_day(date))) AS complete") + _RATED + " SELECT month, kpi, round(actual, 4) AS actual, target, round(gap, 4) AS gap_pct, status FROM rs WHERE complete AND month = (SELECT max(month) FROM rs WHERE complete)")
def srt_05(spark, sf_dir):
    return rounded(T.scorecard(rows(spark, sf_dir), _targets(spark), _KPIS, PRESENT))


@R.add("jn_05", _TARGET_SQL + _long_sql("channel", "channel") + _RATED + " SELECT channel, kpi, round(actual, 4) AS actual, target, round(gap, 4) AS gap_pct, status FROM rs")
def jn_05(spark, sf_dir):
    return rounded(T.by_channel(rows(spark, sf_dir), _targets(spark), _KPIS, present=PRESENT))


# forecasts

_METRICS = ["spend", "revenue", "leads", "conversions"]
_WEEKS = """, b AS (SELECT min(date) AS a, max(date) AS z FROM m),
 we AS (SELECT CAST(unnest(generate_series(CAST(CASE WHEN a = date_trunc('week', a) THEN a ELSE date_trunc('week', a) + INTERVAL 7 DAY END AS TIMESTAMP), CAST(CASE WHEN isodow(z) = 7 THEN date_trunc('week', z) ELSE date_trunc('week', z) - INTERVAL 7 DAY END AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week FROM b),
 ws AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, sum(spend) AS spend, sum(revenue) AS revenue, sum(leads) AS leads, sum(conversions) AS conversions FROM m {where} GROUP BY 1),
 wh AS (SELECT week, coalesce(spend, 0) AS spend, coalesce(revenue, 0) AS revenue, coalesce(leads, 0) AS leads, coalesce(conversions, 0) AS conversions FROM we LEFT JOIN ws USING (week)),
 lg AS (SELECT week, 'spend' AS metric, spend AS value FROM wh UNION ALL SELECT week, 'revenue', revenue FROM wh UNION ALL SELECT week, 'leads', leads FROM wh UNION ALL SELECT week, 'conversions', conversions FROM wh),
 ln AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY week) AS n FROM lg),
 fx AS (SELECT metric, n AS origin, value AS last_value, avg(value) OVER (PARTITION BY metric ORDER BY n ROWS 3 PRECEDING) AS ma4, coalesce(covar_pop(n, value) OVER t / nullif(var_pop(n) OVER t, 0), 0) AS slope FROM ln WINDOW t AS (PARTITION BY metric ORDER BY n ROWS 11 PRECEDING)),
 st AS (SELECT *, unnest([1, 2, 3, 4]) AS step FROM fx),
 fo AS (SELECT metric, origin, step, 'last_value' AS method, greatest(last_value, 0) AS forecast FROM st UNION ALL SELECT metric, origin, step, 'ma4', greatest(ma4, 0) FROM st UNION ALL SELECT metric, origin, step, 'ma4_trend', greatest(ma4 + slope * (step + 1.5), 0) FROM st)"""


def _history(spark, sf_dir, channel=None) -> DataFrame:
    return FC.weekly_history(rows(spark, sf_dir), _METRICS, channel)


@R.add("ag_26", _WEEKS.format(where="WHERE channel = '1-URGENT'") + " SELECT week, round(spend, 4) AS spend, round(revenue, 4) AS revenue, leads, conversions FROM wh", dates=("week",))
def ag_26(spark, sf_dir):
    return rounded(_history(spark, sf_dir, "1-URGENT"))


for _name in ("fc_01", "fc_02"):

    @R.add(_name, _WEEKS.format(where="") + " SELECT metric, origin, CAST(step AS INTEGER) AS step, method, round(forecast, 3) AS forecast FROM fo")
    def _simple(spark, sf_dir):
        return rounded(FC.simple_forecasts(FC.long_history(_history(spark, sf_dir), _METRICS)).withColumn("origin", F.col("origin").cast("long")), 3)


_BACK = ", bt AS (SELECT fo.metric, fo.origin, fo.step, fo.method, ln.value AS actual, fo.forecast FROM fo JOIN ln ON ln.metric = fo.metric AND ln.n = fo.origin + fo.step WHERE fo.origin >= greatest(4, (SELECT max(n) FROM ln) - 12))"


def _backtests(spark, sf_dir) -> DataFrame:
    """Backtest rows of the window-function methods."""
    long = FC.long_history(_history(spark, sf_dir), _METRICS)
    from pyspark.sql import Window

    numbered = long.withColumn("n", F.row_number().over(Window.partitionBy("metric").orderBy("week")))
    last = numbered.groupBy("metric").agg(F.max("n").alias("last"))
    actual = numbered.select("metric", F.col("n").alias("_n"), F.col("value").alias("actual"))
    made = FC.simple_forecasts(long).join(last, "metric").where(F.col("origin") >= F.greatest(F.lit(4), F.col("last") - FC.BACKTEST)).withColumn("_n", F.col("origin") + F.col("step"))
    return made.join(actual, ["metric", "_n"]).select("metric", F.col("origin").cast("long").alias("origin"), "step", "method", "actual", "forecast")


for _name in ("fc_03", "wn_18"):

    @R.add(_name, _WEEKS.format(where="") + _BACK + " SELECT metric, origin, CAST(step AS INTEGER) AS step, method, round(actual, 3) AS actual, round(forecast, 3) AS forecast FROM bt")
    def _back(spark, sf_dir):
        return rounded(_backtests(spark, sf_dir), 3)


@R.add("ag_29", _WEEKS.format(where="") + _BACK + " SELECT metric, method, round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100, 4) AS wape FROM bt GROUP BY 1, 2")
def ag_29(spark, sf_dir):
    return rounded(_backtests(spark, sf_dir).groupBy("metric", "method").agg(FC.wape_column(F.col("actual"), F.col("forecast")).alias("wape")))


@R.add("ag_30", _WEEKS.format(where="") + _BACK + " SELECT metric, method, CAST(step AS INTEGER) AS step, round(quantile_cont((actual - forecast) / nullif(forecast, 0), 0.1), 6) AS low, round(quantile_cont((actual - forecast) / nullif(forecast, 0), 0.9), 6) AS high FROM bt GROUP BY 1, 2, 3")
def ag_30(spark, sf_dir):
    error = F.try_divide(F.col("actual") - F.col("forecast"), F.col("forecast"))
    band = _backtests(spark, sf_dir).groupBy("metric", "method", "step").agg(F.percentile(error, F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return rounded(band.select("metric", "method", "step", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")), 6)


# every method at every origin, eight steps; smoothing by recursion from week to week
_ALL_METHODS = _WEEKS.format(where="").replace(" ln AS (", " ln AS MATERIALIZED (") + """,
 gr AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS g FROM (VALUES (0.2e0), (0.4e0), (0.6e0), (0.8e0)) x(a), (VALUES (0.2e0), (0.4e0), (0.6e0), (0.8e0)) y(b)),
 ho AS (WITH RECURSIVE hr AS (
   SELECT ln.metric, a, b, g, ln.n, ln.value AS level, later.value - ln.value AS trend, 0.0e0 AS error FROM ln JOIN ln later ON later.metric = ln.metric AND later.n = 2, gr WHERE ln.n = 1
   UNION ALL SELECT hr.metric, a, b, g, v.n, a * v.value + (1 - a) * (level + trend), b * (a * v.value + (1 - a) * (level + trend) - level) + (1 - b) * trend, error + power(v.value - (level + trend), 2) FROM hr JOIN ln v ON v.metric = hr.metric AND v.n = hr.n + 1)
   SELECT metric, n AS origin, level, trend FROM hr QUALIFY row_number() OVER (PARTITION BY metric, n ORDER BY error, g) = 1),
 s8 AS (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS step FROM fx),
 f8 AS MATERIALIZED (SELECT metric, origin, step, 1 AS i, 'last_value' AS method, greatest(last_value, 0) AS forecast FROM s8 UNION ALL SELECT metric, origin, step, 2, 'ma4', greatest(ma4, 0) FROM s8 UNION ALL SELECT metric, origin, step, 3, 'ma4_trend', greatest(ma4 + slope * (step + 1.5), 0) FROM s8
   UNION ALL SELECT metric, origin, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS step, 4, 'holt', greatest(level + trend * unnest([1, 2, 3, 4, 5, 6, 7, 8]), 0) FROM ho),
 er AS MATERIALIZED (SELECT f8.metric, origin AS o, n, step, i, value AS actual, forecast FROM f8 JOIN ln ON ln.metric = f8.metric AND n = origin + step WHERE origin >= 4),
 ks AS (SELECT * FROM er JOIN asked USING (metric) WHERE n <= t AND step <= h),
 sc AS (SELECT metric, t, h, i, coalesce(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100, CAST('inf' AS DOUBLE)) AS wape FROM ks WHERE o >= t - 12 GROUP BY ALL),
 be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY metric, t ORDER BY wape, i) = 1),
 re AS (SELECT ks.metric, ks.t, step, (actual - forecast) / forecast AS e FROM ks JOIN be ON be.metric = ks.metric AND be.t = ks.t AND be.i = ks.i WHERE o >= 12 AND forecast <> 0),
 ow AS (SELECT metric, t, step, quantile_cont(e, 0.1) AS q1, quantile_cont(e, 0.9) AS q9 FROM re GROUP BY ALL HAVING count(*) >= 3),
 po AS (SELECT metric, t, quantile_cont(e, 0.1) AS q1, quantile_cont(e, 0.9) AS q9 FROM re GROUP BY ALL),
 fd AS (SELECT be.metric, be.t, f8.method, wape, f8.step, forecast, greatest(0, least(forecast, forecast * (1 + coalesce(ow.q1, po.q1, 0)))) AS low, greatest(forecast, forecast * (1 + coalesce(ow.q9, po.q9, 0))) AS high
   FROM be JOIN f8 ON f8.metric = be.metric AND f8.origin = be.t AND f8.i = be.i AND f8.step <= be.h LEFT JOIN ow ON ow.metric = be.metric AND ow.t = be.t AND ow.step = f8.step LEFT JOIN po ON po.metric = be.metric AND po.t = be.t)"""
_AT_END = _ALL_METHODS.replace(" ks AS (", " asked AS (SELECT metric, max(n) AS t, 4 AS h, max(week) AS last FROM ln GROUP BY metric HAVING max(n) >= 26), ks AS (", 1)


@R.add("fc_04", _AT_END + " SELECT DISTINCT metric, method, round(wape, 4) AS wape FROM fd")
def fc_04(spark, sf_dir):
    """The method of each metric."""
    return rounded(FC.forecast_analysis(_history(spark, sf_dir), _METRICS, 4).select("metric", "method", "wape").distinct())


@R.add("fc_05", _AT_END + " SELECT metric, method, CAST(step AS BIGINT) AS step, CAST(last + INTERVAL 7 DAY * step AS DATE) AS week, round(forecast, 3) AS forecast, round(low, 3) AS low, round(high, 3) AS high FROM fd JOIN asked USING (metric)", dates=("week",))
def fc_05(spark, sf_dir):
    return rounded(FC.forecast_analysis(_history(spark, sf_dir), _METRICS, 4).drop("wape"), 3)


_REPLAYED = _ALL_METHODS.replace(" ks AS (", " asked AS (SELECT metric, n - 1 AS t, least(8, z - n + 1) AS h, value AS seen FROM (SELECT *, max(n) OVER (PARTITION BY metric) AS z FROM ln WHERE metric IN ('spend', 'revenue')) WHERE n - 1 >= 26 AND n - 1 >= z - 26), ks AS (", 1)


@R.add("fc_06", _REPLAYED + " SELECT metric, count(*) AS checked, count(*) FILTER (seen BETWEEN low AND high) AS inside FROM fd JOIN asked USING (metric, t) WHERE step = 1 GROUP BY metric")
def fc_06(spark, sf_dir):
    return FC.range_coverage(_history(spark, sf_dir), ["spend", "revenue"], 8)


# response curves: a finer channel, so that there is more than one level of spend

_FINE = "region"
_RC = """, wk AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week FROM m GROUP BY 1 HAVING count(DISTINCT date) = 7),
 cs AS (SELECT region AS channel, CAST(date_trunc('week', date) AS DATE) AS week, sum(spend) AS spend, sum(conversions) AS conversions, sum(revenue) AS revenue FROM m GROUP BY 1, 2),
 cw AS (SELECT channel, week, coalesce(spend, 0) AS spend, coalesce(conversions, 0) AS conversions, coalesce(revenue, 0) AS revenue FROM (SELECT DISTINCT channel FROM cs) CROSS JOIN wk LEFT JOIN cs USING (channel, week)),
 va AS (SELECT channel, count(*) FILTER (spend > 0) AS weeks, stddev_samp(spend) FILTER (spend > 0) / avg(spend) FILTER (spend > 0) AS cv, max(spend) FILTER (spend > 0) / min(spend) FILTER (spend > 0) AS spread FROM cw GROUP BY 1),
 rn AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY week DESC) AS back FROM cw),
 ft AS (SELECT channel, count(*) FILTER (spend > 0 AND conversions > 0) AS weeks, regr_slope(ln(conversions), ln(spend)) FILTER (spend > 0 AND conversions > 0) AS raw_b, regr_r2(ln(conversions), ln(spend)) FILTER (spend > 0 AND conversions > 0) AS r2,
   avg(spend) FILTER (back <= 8) AS s8, avg(conversions) FILTER (back <= 8) AS c8, min(spend) FILTER (spend > 0) * 0.5 AS guard_low, max(spend) * 1.3 AS guard_high, sum(revenue) / sum(conversions) AS aov FROM rn GROUP BY 1),
 cu AS (SELECT *, least(raw_b, 1.0) AS b, c8 / pow(s8, least(raw_b, 1.0)) AS a FROM ft JOIN (SELECT channel, weeks >= 20 AND cv >= 0.15 AND spread >= 1.5 AS passes FROM va) USING (channel))"""


def _weekly(spark, sf_dir) -> DataFrame:
    return RC.weekly_channels(rows(spark, sf_dir), _FINE)


@R.add("rc_01", _RC + " SELECT channel, weeks, round(cv, 6) AS cv, round(spread, 6) AS spread, weeks >= 20 AND cv >= 0.15 AND spread >= 1.5 AS passes FROM va")
def rc_01(spark, sf_dir):
    return rounded(RC.data_check(_weekly(spark, sf_dir)), 6)


@R.add("ag_27", _RC + " SELECT channel, weeks, round(cv, 6) AS cv, round(spread, 6) AS spread FROM va")
def ag_27(spark, sf_dir):
    return rounded(RC.spend_variation(_weekly(spark, sf_dir)), 6)


@R.add("rc_02", """, inc(channel, s, e) AS (VALUES ('ASIA', DATE '1996-01-03', DATE '1996-01-20'), ('EUROPE', DATE '1996-01-16', DATE '1996-02-02')),
  w AS (SELECT channel, CAST(unnest(generate_series(date_trunc('week', CAST(s AS TIMESTAMP)), date_trunc('week', CAST(e AS TIMESTAMP)), INTERVAL 7 DAY)) AS DATE) AS week FROM inc)
  SELECT min(channel) AS channel, week FROM w GROUP BY week HAVING count(DISTINCT channel) = 1""", dates=("week",))
def rc_02(spark, sf_dir):
    data = spark.createDataFrame([("ASIA", "1996-01-03", "1996-01-20"), ("EUROPE", "1996-01-16", "1996-02-02")], "channel string, start string, end string")
    return rounded(RC.incident_weeks(data.select("channel", F.col("start").cast("date"), F.col("end").cast("date"))))


for _name in ("rc_03", "ag_28"):

    @R.add(_name, _RC + " SELECT channel, weeks, round(b, 6) AS b, round(r2, 6) AS r2, round(a, 6) AS a, round(s8, 4) AS spend8, round(guard_low, 4) AS guard_low, round(guard_high, 4) AS guard_high, CASE WHEN raw_b > 1 THEN 'Low' WHEN r2 >= 0.5 AND weeks >= 30 THEN 'High' WHEN r2 >= 0.25 AND weeks >= 20 THEN 'Medium' ELSE 'Low' END AS confidence FROM cu WHERE passes AND raw_b > 0 AND weeks >= 12")
    def _fit(spark, sf_dir):
        fits = RC.fit_channels(_weekly(spark, sf_dir)).where("status = 'fitted'")
        return fits.select("channel", "weeks", *(F.round(c, 6).alias(c) for c in ("b", "r2", "a")), *(F.round(c, 4).alias(c) for c in ("spend8", "guard_low", "guard_high")), "confidence")


_AT = "a * pow(s8 * 1.1e0, b)"
for _name in ("rc_05", "kpi_response"):

    @R.add(_name, _RC + f" SELECT channel, round({_AT}, 4) AS conversions, round(1 / (a * b * pow(s8 * 1.1e0, b - 1)), 4) AS marginal_cost, round(1e5 * a * b * pow(s8 * 1.1e0, b - 1), 4) AS per_lakh FROM cu WHERE passes AND raw_b > 0")
    def _curve(spark, sf_dir):
        c = RC.fit_channels(_weekly(spark, sf_dir)).where("status = 'fitted'")
        at = F.col("spend8") * 1.1
        cost = RC.marginal_cost(F.col("a"), F.col("b"), at)
        return rounded(c.select("channel", RC.conversions(F.col("a"), F.col("b"), at).alias("conversions"), cost.alias("marginal_cost"), F.try_divide(F.lit(1e5), cost).alias("per_lakh")))


@R.add("rc_04")
def rc_04(spark, sf_dir):
    return rounded(RC.bootstrap(_weekly(spark, sf_dir)), 6)


@R.add("rc_06")
def rc_06(spark, sf_dir):
    return rounded(RC.response_analysis(rows(spark, sf_dir), channel=_FINE))


def _curves(spark, sf_dir) -> DataFrame:
    return RC.fit_channels(_weekly(spark, sf_dir)).where("status = 'fitted'").withColumns({"b_low": F.col("b") * 0.8, "b_high": F.least(F.col("b") * 1.2, F.lit(1.0))})


_FITTED = ", cf AS (SELECT * FROM cu WHERE passes AND raw_b > 0 AND weeks >= 12)"


@R.add("sc_01", _RC + _FITTED + """, am AS (SELECT greatest(0, least(max(s8) FILTER (channel = 'ASIA') * 0.15e0, max(s8 - guard_low) FILTER (channel = 'ASIA'), max(guard_high - s8) FILTER (channel = 'EUROPE'))) AS amount FROM cf)
 SELECT channel, round(s8 + CASE channel WHEN 'ASIA' THEN -amount WHEN 'EUROPE' THEN amount ELSE 0 END, 4) AS new_spend FROM cf, am""")
def sc_01(spark, sf_dir):
    return rounded(RC.move_budget(_curves(spark, sf_dir), "ASIA", "EUROPE").select("channel", "new_spend"))


@R.add("sc_02")
def sc_02(spark, sf_dir):
    return rounded(RC.suggest_allocation(_curves(spark, sf_dir)).select("channel", "spend8", "new_spend"))


_SCENARIO = _RC + _FITTED + ", sp AS (SELECT *, least(greatest(s8 * CASE channel WHEN 'ASIA' THEN 1.2e0 WHEN 'EUROPE' THEN 0.9e0 ELSE 1 END, guard_low), guard_high) AS new_spend FROM cf), ev AS (SELECT channel, s8 AS spend_before, new_spend AS spend_after, a * pow(s8, b) AS conversions_before, a * pow(new_spend, b) AS conversions_after, a * pow(s8, b) * aov AS revenue_before, a * pow(new_spend, b) * aov AS revenue_after FROM sp)"


def _evaluated(spark, sf_dir) -> DataFrame:
    return RC.evaluate(RC.adjust_channels(_curves(spark, sf_dir), {"ASIA": 20, "EUROPE": -10}))


@R.add("sc_03", _SCENARIO + " SELECT channel, " + ", ".join(f"round({c}, 3) AS {c}" for c in ("spend_before", "spend_after", "conversions_before", "conversions_after", "revenue_before", "revenue_after")) + " FROM ev")
def sc_03(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir).select("channel", "spend_before", "spend_after", "conversions_before", "conversions_after", "revenue_before", "revenue_after"), 3)


@R.add("sc_04", _SCENARIO + " SELECT round(sum(spend_before), 3) AS spend_before, round(sum(spend_after), 3) AS spend_after, round(sum(conversions_after), 3) AS conversions_after, round(sum(spend_after) / sum(conversions_after), 3) AS cac_after, round(sum(revenue_after) / sum(spend_after), 3) AS roas_after FROM ev")
def sc_04(spark, sf_dir):
    return rounded(RC.scenario_totals(_evaluated(spark, sf_dir)).select("spend_before", "spend_after", "conversions_after", "cac_after", "roas_after"), 3)


# findings and answers


def _found(spark, sf_dir) -> DataFrame:
    path, df = f"{new_folder(spark, 'joined')}/rows", rows(spark, sf_dir)
    df.write.parquet(path)  # four tables come from the joined rows
    df = spark.read.schema(df.schema).parquet(path)
    segments = C.segment_table(df, "customer_segment").withColumnRenamed("customer_segment", "segment")
    return FI.generate_findings(C.channel_table(df), C.campaign_table(df), FU.funnel_table(df), segments, PRESENT)


_EXT = "SELECT {p} AS priority, '{f}' AS finding, {k} AS entity, '{m}' AS metric, round({v}, 4) AS value FROM (SELECT {k}, {v} AS {v} FROM {t} WHERE {w} ORDER BY {v} {o}, {k} LIMIT 1)"
_FINDINGS_SQL = (
    f", ch AS (SELECT channel, {measure_sql('roas')} AS roas, sum(spend) / sum(sum(spend)) OVER () * 100 AS spend_share FROM m GROUP BY 1),"
    f" ca AS (SELECT campaign_name, {measure_sql('roas')} AS roas, sum(conversions) AS conversions, sum(spend) / sum(sum(spend)) OVER () * 100 AS spend_share FROM m GROUP BY 1),"
    f" se AS (SELECT customer_segment, {measure_sql('roas')} AS roas FROM m GROUP BY 1) "
    + " UNION ALL ".join(
        f"({_EXT.format(**dict(zip('pfkmvtwo', x, strict=True)))})"
        for x in (
            (2, "best_channel", "channel", "roas", "roas", "ch", "true", "DESC"), (3, "weakest_channel", "channel", "roas", "roas", "ch", "true", "ASC"), (5, "top_campaign", "campaign_name", "conversions", "conversions", "ca", "true", "DESC"),
            (6, "weakest_campaign", "campaign_name", "roas", "roas", "ca", "spend_share >= 3", "ASC"), (9, "best_segment", "customer_segment", "roas", "roas", "se", "true", "DESC"),
        )
    )
)


@R.add("fnd_01", _FINDINGS_SQL)
def fnd_01(spark, sf_dir):
    return rounded(_found(spark, sf_dir).where(F.col("finding").isin("best_channel", "weakest_channel", "top_campaign", "weakest_campaign", "best_segment")).select("priority", "finding", "entity", "metric", "value"))


@R.add("srt_02")
def srt_02(spark, sf_dir):
    return rounded(_found(spark, sf_dir).select("priority", "finding", "entity", "metric", "value"))


_HEADLINE = "SELECT '{v}' AS variant, CASE WHEN count(revenue) > 0 AND count(spend) > 0 THEN 'roas' WHEN count(spend) > 0 AND count(leads) > 0 THEN 'cpl' WHEN count(clicks) > 0 AND count(impressions) > 0 THEN 'ctr' END AS headline FROM (SELECT *{r} FROM m)"
_LACKING = {"all": [], "no revenue": ["revenue"], "no money": ["revenue", "spend"], "no revenue and leads": ["revenue", "leads"], "no clicks": ["revenue", "spend", "clicks"]}


@R.add("fnd_02", " UNION ALL ".join(_HEADLINE.format(v=v, r=f" REPLACE ({', '.join(f'NULL AS {c}' for c in gone)})" if gone else "") for v, gone in _LACKING.items()))
def fnd_02(spark, sf_dir):
    """The headline measure of files that lack some fields, from what their rows hold."""
    df = rows(spark, sf_dir)
    found = [(v, FI.headline_metric(presence(df.withColumns({c: F.lit(None).cast(dict(df.dtypes)[c]) for c in gone}) if gone else df))) for v, gone in _LACKING.items()]
    return spark.createDataFrame(found, "variant string, headline string")


@R.add("fnd_03", f", ch AS (SELECT channel, {measure_sql('roas')} AS roas FROM m GROUP BY 1) SELECT finding, 'channels' AS table_name, channel AS key, 'roas' AS column_name, round(roas, 4) AS value FROM ((SELECT 'best_channel' AS finding, * FROM ch ORDER BY roas DESC LIMIT 1) UNION ALL (SELECT 'weakest_channel', * FROM ch ORDER BY roas LIMIT 1))")
def fnd_03(spark, sf_dir):
    found = _found(spark, sf_dir).where(F.col("finding").isin("best_channel", "weakest_channel")).select("finding", F.explode("numbers").alias("n"))
    return rounded(found.select("finding", F.col("n.table").alias("table_name"), F.col("n.key").alias("key"), F.col("n.column").alias("column_name"), F.col("n.value").alias("value")))


_SHARE_GAP = ", g AS (SELECT p_type_ AS product_category, a, b FROM (SELECT product_category AS p_type_, sum(spend) / sum(sum(spend)) OVER () * 100 AS a, sum(revenue) / sum(sum(revenue)) OVER () * 100 AS b FROM m GROUP BY 1))"


@R.add("fnd_04", _SHARE_GAP + " SELECT product_category, round(b, 4) AS revenue_share, round(a, 4) AS spend_share FROM g ORDER BY b - a DESC, product_category LIMIT 1")
def fnd_04(spark, sf_dir):
    from tallyspark.operators.common import add_shares

    table = add_shares(group_kpis(rows(spark, sf_dir), "product_category", PRESENT))
    found = SO.gap(table, "product_category", "revenue_share", points=-100.0)
    return rounded(found.select(F.col("entity").alias("product_category"), F.col("value").alias("revenue_share"), F.col("beside").alias("spend_share")))


@R.add(
    "fnd_04_titles",
    f", c AS (SELECT channel AS entity, {', '.join(f'{measure_sql(k)} AS {k}' for k in ('roas', 'cpc', 'aov'))}, sum(spend) AS spend, sum(clicks)::DOUBLE AS clicks, sum(revenue) / sum(sum(revenue)) OVER () * 100 AS back, sum(spend) / sum(sum(spend)) OVER () * 100 AS paid FROM m GROUP BY 1) "
    + " UNION ALL ".join(
        f"(SELECT '{kind}' AS kind, '{n}' AS measure, entity, round({n}, 4) AS value FROM c ORDER BY {n} {o}, entity LIMIT 1)"
        for n, *sides in (("roas", ("best", "DESC"), ("worst", "ASC")), ("aov", ("best", "DESC"), ("worst", "ASC")), ("cpc", ("best", "ASC"), ("worst", "DESC")), ("spend", ("highest", "DESC"), ("lowest", "ASC")), ("clicks", ("best", "DESC"), ("worst", "ASC")))
        for kind, o in sides
    )
    + " UNION ALL (SELECT 'gap', 'revenue_share', entity, round(back, 4) FROM c ORDER BY back - paid DESC, entity LIMIT 1)",
)
def fnd_04_titles(spark, sf_dir):
    """What stands out in the channel table: both ends of five measures, and who brings more than it costs."""
    from tallyspark.operators.common import add_shares

    table = add_shares(group_kpis(rows(spark, sf_dir), "channel", PRESENT))
    found = SO.extremes(SO.facts(table, "channel", ["roas", "aov", "cpc", "spend", "clicks"])).unionByName(SO.gap(table, "channel", "revenue_share", points=-100.0))
    return rounded(found.select("kind", "measure", "entity", "value"))


@R.add("pln_01", ", v AS (SELECT sum(clicks) AS clicks FROM m) SELECT 'clicks' AS kpi, CASE WHEN n >= 10000000 THEN CAST(n // 10000000 AS VARCHAR) || ',' || lpad(CAST(n // 100000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(n // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') ELSE CAST(n // 100000 AS VARCHAR) || ',' || lpad(CAST(n // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') END AS text FROM (SELECT CAST(clicks AS BIGINT) AS n FROM v)")
def pln_01(spark, sf_dir):
    return FI.key_numbers(kpi_table(rows(spark, sf_dir), PRESENT), {"clicks": "count"})


_PERIOD = "SELECT '{p}' AS period, {m} FROM m WHERE date BETWEEN DATE '{a}' AND DATE '{b}'"
_PERIODS = " UNION ALL ".join(_PERIOD.format(p=p, a=a, b=b, m=", ".join(f"CAST({measure_sql(k)} AS DOUBLE) AS {k}" for k in totals_and_ratios())) for p, a, b in (("current", "1998-06-01", "1998-06-30"), ("previous", "1998-05-02", "1998-05-31")))


@R.add("pln_02", f", w AS ({_PERIODS}), l AS (UNPIVOT w ON {', '.join(totals_and_ratios())} INTO NAME kpi VALUE value) SELECT kpi, round(max(value) FILTER (period = 'current'), 4) AS current, round(max(value) FILTER (period = 'previous'), 4) AS previous, round(100 * (max(value) FILTER (period = 'current') - max(value) FILTER (period = 'previous')) / nullif(abs(max(value) FILTER (period = 'previous')), 0), 4) AS pct_change FROM l GROUP BY kpi")
def pln_02(spark, sf_dir):
    """Thirty days against the thirty before, every measure."""
    return rounded(period_comparison(rows(spark, sf_dir), "1998-06-01", "1998-06-30", PRESENT).select("kpi", "current", "previous", "pct_change"))


@R.add("evd_01")
def evd_01(spark, sf_dir):
    return FI.evidence_pack(_found(spark, sf_dir), 200)


@R.add("evd_02", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'verified' WHEN o_orderkey % 3 = 1 THEN 'unverified' ELSE 'weak' END AS status FROM orders", m=False)
def evd_02(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(k % 3 == 0, F.concat(F.lit("Spend was about "), X.rupees((k + 1000).cast("double")))).when(k % 3 == 1, F.concat(F.lit("Spend was about "), X.rupees((k * 3 + 2000).cast("double")))).otherwise("It went well for 3 weeks")
    answers = orders.select(F.col("o_orderkey").alias("id"), text.alias("text"), F.array(F.struct((k + 1000).cast("double").alias("value"), F.lit("money").alias("kind"), F.lit(0.5).alias("tolerance"))).alias("evidence"))
    return FI.check_answers(answers, F.col("evidence")).select("id", "status")


QUERIES, ORACLE_SQL = R.queries, R.sql
