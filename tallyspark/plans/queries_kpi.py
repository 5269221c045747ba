"""Measures, grouped tables, trends, joins, sorts and set operations over the canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.kpi import BETTER, RATIOS, TOTALS, channel_pricing, channel_type, presence
from tallyspark.operators import channel as C
from tallyspark.operators import funnel as FU
from tallyspark.operators import group as G
from tallyspark.operators import trends as T
from tallyspark.operators.common import add_shares, campaign_key, channel_key, primary_outcome, recent_change
from tallyspark.operators.profit import loss_makers, profit_table
from tallyspark.sources.cube import Cube
from tallyspark.sources.shared import new_folder

from .build import MEASURES, PRESENT, SUMS, Registry, measures_sql, ratio_sql, rounded
from .canonical import campaign_rows

R = Registry()
rows = campaign_rows

# measures by channel

for _key in [*TOTALS, *RATIOS]:

    def _one(spark, sf_dir, key=_key) -> DataFrame:
        return rounded(G.group_kpis(rows(spark, sf_dir), "channel", PRESENT).select("channel", key))

    R.add(f"kpi_{_key}", f"SELECT channel, {measures_sql([_key])} FROM m GROUP BY channel")(_one)

_PROFIT_SQL = """, s AS (SELECT {by} AS entity,
    sum(gross_profit) FILTER (revenue IS NOT NULL) / nullif(sum(revenue) FILTER (gross_profit IS NOT NULL), 0) AS margin,
    sum(gross_profit - spend) AS contribution, sum(spend) FILTER (gross_profit IS NOT NULL) AS spend_c,
    sum(revenue) FILTER (spend IS NOT NULL) / nullif(sum(spend) FILTER (revenue IS NOT NULL), 0) AS roas, sum(spend) AS spend, sum(revenue) AS revenue, sum(gross_profit) AS gross_profit
  FROM m GROUP BY {by}),
p AS (SELECT entity, spend, revenue, gross_profit, roas, margin * 100 AS gross_margin_pct, CASE WHEN margin > 0 THEN 1 / margin END AS break_even_roas, contribution,
    contribution / nullif(spend_c, 0) AS profit_per_rupee, CASE WHEN margin > 0 THEN (roas * margin - 1) * 100 END AS roas_headroom,
    CASE WHEN margin > 0 AND roas IS NOT NULL THEN CASE WHEN round(roas * margin, 9) >= 1.10 THEN 'Profitable' WHEN round(roas * margin, 9) >= 0.90 THEN 'Near break-even' ELSE 'Loss-making' END
         WHEN contribution < 0 THEN 'Loss-making' ELSE 'Not available' END AS status FROM s)"""
for _key in ("gross_margin_pct", "break_even_roas", "contribution", "profit_per_rupee", "roas_headroom"):

    def _profit(spark, sf_dir, key=_key) -> DataFrame:
        return rounded(profit_table(rows(spark, sf_dir), "channel").select(F.col("entity").alias("channel"), key))

    R.add(f"kpi_{_key}", _PROFIT_SQL.format(by="channel") + f" SELECT entity AS channel, round({_key}, 4) AS {_key} FROM p")(_profit)

_ALL = [k for k in [*TOTALS, *RATIOS]]
_UNION = " UNION ALL ".join(
    f"SELECT '{k}' AS kpi, round({ratio_sql(k) if k in RATIOS else f'sum({k})'}, 4) AS value, count(*) FILTER ("
    + (f"({RATIOS[k].numerator}) IS NOT NULL AND {[d for d in RATIOS[k].denominators if d in PRESENT][0]} IS NOT NULL" if k in RATIOS else f"{k} IS NOT NULL")
    + f") AS rows_used, '{BETTER[k]}' AS better FROM {{src}}"
    for k in _ALL
)


@R.add("ag_01", _UNION.format(src="m"))
def ag_01(spark, sf_dir):
    return rounded(G.kpi_table(rows(spark, sf_dir), PRESENT).select("kpi", "value", "rows_used", "better"))


@R.add("ag_42", _UNION.format(src="m"))
def ag_42(spark, sf_dir):
    return rounded(G.kpi_table(rows(spark, sf_dir)).select("kpi", "value", "rows_used", "better"))


@R.add("ag_02", "SELECT platform, round(sum(revenue) FILTER (spend IS NOT NULL), 4) AS roas_numerator, round(sum(spend) FILTER (revenue IS NOT NULL), 4) AS roas_denominator, round(sum(spend) FILTER (leads IS NOT NULL), 4) AS cpl_numerator, round(sum(leads), 4) AS cpl_denominator FROM m GROUP BY platform")
def ag_02(spark, sf_dir):
    from tallyspark.functions.kpi import both_known

    out = []
    for key in ("roas", "cpl"):
        n, d = both_known(RATIOS[key].numerator, RATIOS[key].denominators[0])
        out += [F.sum(n).alias(f"{key}_numerator"), F.sum(d).alias(f"{key}_denominator")]
    return rounded(rows(spark, sf_dir).groupBy("platform").agg(*out))


_GROUPED = "SELECT {by} AS {by}, count(*) AS rows, " + measures_sql() + " FROM m GROUP BY {by}"


@R.add("ag_03", "SELECT coalesce(nullif(channel, '5-LOW'), '(none)') AS channel, region, count(*) AS rows, " + measures_sql() + " FROM m GROUP BY 1, 2")
def ag_03(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("channel", F.nullif("channel", F.lit("5-LOW")))
    return rounded(G.group_kpis(df, ["channel", "region"], PRESENT))


@R.add("ag_04", _PROFIT_SQL.format(by="region") + " SELECT entity, round(gross_margin_pct, 4) AS gross_margin_pct, round(break_even_roas, 4) AS break_even_roas, round(contribution, 4) AS contribution, round(profit_per_rupee, 4) AS profit_per_rupee, round(roas_headroom, 4) AS roas_headroom FROM p")
def ag_04(spark, sf_dir):
    return rounded(profit_table(rows(spark, sf_dir), "region").select("entity", "gross_margin_pct", "break_even_roas", "contribution", "profit_per_rupee", "roas_headroom"))


_SHARES = ", ".join(f"round(sum({m}) / nullif(sum(sum({m})) OVER (), 0) * 100, 4) AS {m}_share" for m in ("spend", "revenue", "conversions", "leads"))
for _name in ("ag_05", "wn_20"):

    @R.add(_name, f"SELECT platform, {_SHARES} FROM m GROUP BY platform")
    def _shares(spark, sf_dir):
        return rounded(add_shares(G.group_kpis(rows(spark, sf_dir), "platform", PRESENT)).select("platform", *(f"{m}_share" for m in ("spend", "revenue", "conversions", "leads"))))


_STAGES = ["impressions", "clicks", "leads", "qualified_leads", "conversions"]


def _funnel_sql(key: str, group: str) -> str:
    sums = ", ".join(f"sum({s}) AS {s}" for s in [*_STAGES, "revenue"])
    union = " UNION ALL ".join(f"SELECT {key}, {i} AS place, '{s}' AS stage, {s} AS value FROM t" for i, s in enumerate(_STAGES))
    return (
        f", t AS (SELECT {group} AS {key}, {sums} FROM m GROUP BY 1), u AS ({union}), "
        f"r AS (SELECT *, value / nullif(lag(value) OVER (PARTITION BY {key} ORDER BY place), 0) * 100 AS rate FROM u), "
        f"f AS (SELECT {key}, place, stage, value, rate, 100 - rate AS drop_off FROM r UNION ALL SELECT {key}, 6, 'revenue', revenue, NULL, NULL FROM t)"
    )


@R.add("ag_06", _funnel_sql("scope", "'all'") + " SELECT scope, CAST(place AS INTEGER) AS place, stage, round(value, 4) AS value, round(rate, 4) AS rate, round(drop_off, 4) AS drop_off FROM f")
def ag_06(spark, sf_dir):
    return rounded(FU.funnel_table(rows(spark, sf_dir)))


for _name in ("ag_07", "set_02"):

    @R.add(_name, _funnel_sql("channel", "channel") + " SELECT channel, CAST(place AS INTEGER) AS place, stage, round(value, 4) AS value, round(rate, 4) AS rate, round(drop_off, 4) AS drop_off FROM f")
    def _by_channel(spark, sf_dir):
        return rounded(FU.funnel_by_channel(rows(spark, sf_dir)))


@R.add("wn_13", _funnel_sql("channel", "channel") + " SELECT channel, stage, round(rate, 4) AS rate FROM f WHERE rate IS NOT NULL")
def wn_13(spark, sf_dir):
    return rounded(FU.funnel_by_channel(rows(spark, sf_dir)).where("rate is not null").select("channel", "stage", "rate"))


@R.add("ag_08", _funnel_sql("channel", "channel") + ", x AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY rate, place) AS n FROM f WHERE rate IS NOT NULL AND stage <> 'clicks') SELECT channel, stage, round(rate, 4) AS rate, round(drop_off, 4) AS drop_off FROM x WHERE n = 1")
def ag_08(spark, sf_dir):
    return rounded(FU.biggest_drop_off(FU.funnel_by_channel(rows(spark, sf_dir)), ["channel"]))


_TYPED = "CASE channel WHEN '1-URGENT' THEN 'email' WHEN '2-HIGH' THEN 'Organic  Search' WHEN '3-MEDIUM' THEN 'affiliate' ELSE channel END"
_TYPE = "CASE WHEN channel LIKE 'email%' OR channel LIKE 'Organic%' THEN 'owned' ELSE 'paid' END"


def _typed(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir).withColumn("channel", F.expr(_TYPED))


_TYPED_SQL = f", c AS (SELECT * REPLACE ({_TYPED} AS channel) FROM m)"
_INDEX = C.INDEXED


@R.add(
    "ag_09",
    _TYPED_SQL + f", g AS (SELECT channel, count(*) AS rows, {measures_sql(digits=None)} FROM c GROUP BY channel), o AS (SELECT {measures_sql(_INDEX, None)} FROM c WHERE {_TYPE} = 'paid')"
    + f" SELECT channel, {_TYPE} AS type, rows, " + ", ".join(f"round(g.{k}, 4) AS {k}" for k in MEASURES) + ", " + ", ".join(f"round(g.{m} / nullif(sum(g.{m}) OVER (), 0) * 100, 4) AS {m}_share" for m in ("spend", "revenue", "conversions", "leads"))
    + ", " + ", ".join(f"CASE WHEN {_TYPE} = 'paid' THEN round(g.{k} / o.{k} * 100, 4) END AS {k}_index" for k in _INDEX) + " FROM g, o",
)
def ag_09(spark, sf_dir):
    return rounded(C.channel_table(_typed(spark, sf_dir)))


for _name in ("ag_10", "prj_13"):

    @R.add(_name, _TYPED_SQL + f", x AS (SELECT * FROM c WHERE {_TYPE} = 'paid') " + _UNION.format(src="x"))
    def _paid(spark, sf_dir):
        return rounded(G.kpi_table(C.paid_only(_typed(spark, sf_dir)), PRESENT).select("kpi", "value", "rows_used", "better"))


@R.add("prj_11", _TYPED_SQL + f" SELECT channel, {_TYPE} AS type, count(*) AS n FROM c GROUP BY channel")
def prj_11(spark, sf_dir):
    return _typed(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n")).withColumn("type", channel_type(F.col("channel")))


@R.add("prj_12", _TYPED_SQL + " SELECT channel, CASE WHEN channel = 'affiliate' THEN 'performance' ELSE 'auction' END AS pricing, round(sum(spend), 4) AS spend FROM c GROUP BY channel")
def prj_12(spark, sf_dir):
    return rounded(_typed(spark, sf_dir).groupBy("channel").agg(F.sum("spend").alias("spend")).withColumn("pricing", channel_pricing(F.col("channel"))))


def _change_sql(by: str, metric: str = "revenue") -> str:
    return (
        f", d AS (SELECT max(date) AS last FROM m), x AS (SELECT {by} AS k, sum({metric}) FILTER (date > last - 28) AS recent, sum({metric}) FILTER (date <= last - 28 AND date > last - 56) AS previous FROM m, d WHERE {by} IS NOT NULL GROUP BY 1), "
        "t AS (SELECT k, recent, previous, (recent - previous) / nullif(previous, 0) AS change FROM x), "
        "tr AS (SELECT k, recent, previous, round(change * 100, 4) AS change_pct, CASE WHEN change IS NULL THEN 'n/a' WHEN abs(change) <= 0.05 THEN 'flat' WHEN change > 0 THEN 'up' ELSE 'down' END AS trend FROM t)"
    )


for _name in ("ag_15", "jn_07"):

    @R.add(_name, _change_sql("platform") + " SELECT k AS platform, round(recent, 4) AS recent, round(previous, 4) AS previous, change_pct, trend FROM tr")
    def _recent(spark, sf_dir):
        return rounded(recent_change(rows(spark, sf_dir), "platform", "revenue"))


for _name in ("ag_11", "jn_03"):

    @R.add(
        _name,
        _change_sql("campaign_name") + f", g AS (SELECT campaign_name, count(*) AS rows, {measures_sql()}, {_SHARES}, mode(channel ORDER BY channel) AS main_channel, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS active_days FROM m GROUP BY campaign_name) SELECT g.*, change_pct, trend FROM g LEFT JOIN tr ON k = campaign_name", dates=("first_date", "last_date"),
    )
    def _campaigns(spark, sf_dir):
        return rounded(C.campaign_table(rows(spark, sf_dir)))


for _name in ("ag_12", "jn_04"):

    @R.add(_name, _change_sql("customer_segment") + f", g AS (SELECT customer_segment, count(*) AS rows, {measures_sql()}, {_SHARES} FROM m GROUP BY customer_segment) SELECT g.*, change_pct, trend FROM g LEFT JOIN tr ON k = customer_segment")
    def _segments(spark, sf_dir):
        return rounded(C.segment_table(rows(spark, sf_dir), "customer_segment"))


_SERIES = ["spend", "revenue", "leads", "conversions", "roas", "cpl"]


def _series_sql(period: str, rolling: bool, metrics=_SERIES) -> str:
    out = f", g AS (SELECT {period} AS period, count(*) AS rows, count(DISTINCT date) AS days, {measures_sql(digits=None)} FROM m GROUP BY 1)"
    cols = [f"round({k}, 4) AS {k}" for k in MEASURES] + [f"round(({k} - lag({k}) OVER w) / nullif(lag({k}) OVER w, 0) * 100, 4) AS {k}_change" for k in metrics]
    if rolling:
        cols += [f"CASE WHEN count({k}) OVER r = 4 THEN round(avg({k}) OVER r, 6) END AS {k}_rolling" for k in metrics]
    return out + f" SELECT period, rows, days, {', '.join(cols)} FROM g WINDOW w AS (ORDER BY period), r AS (ORDER BY period ROWS 3 PRECEDING)"


@R.add("ag_13", _series_sql("CAST(date_trunc('week', date) AS DATE)", True), dates=("period",))
def ag_13(spark, sf_dir):
    return rounded(T.time_series(rows(spark, sf_dir), "week"))


for _name in ("wn_09", "jn_17"):

    @R.add(_name, _series_sql("strftime(date, '%Y-%m')", False))
    def _monthly(spark, sf_dir):
        return rounded(T.time_series(rows(spark, sf_dir), "month"))


@R.add("wn_10", ", g AS (SELECT CAST(date_trunc('week', date) AS DATE) AS period, sum(spend) AS spend FROM m GROUP BY 1) SELECT period, CASE WHEN count(spend) OVER r = 4 THEN round(avg(spend) OVER r, 6) END AS spend_rolling FROM g WINDOW r AS (ORDER BY period ROWS 3 PRECEDING)", dates=("period",))
def wn_10(spark, sf_dir):
    return rounded(T.time_series(rows(spark, sf_dir), "week", ["spend"]).select("period", "spend_rolling"))


_MONTHS = ", mo AS (SELECT strftime(date, '%Y-%m') AS month, count(DISTINCT date) AS days, max(day(last_day(date))) AS full_days, sum(revenue) AS revenue, sum(spend) AS spend FROM m GROUP BY 1)"


@R.add("ag_14", _MONTHS + ", f AS (SELECT *, count(*) OVER () AS n FROM mo WHERE days = full_days), s AS (SELECT CAST(substr(month, 6, 2) AS INTEGER) AS month_of_year, avg(revenue) AS mean, count(*) AS months FROM f WHERE n >= 12 GROUP BY 1) SELECT month_of_year, round(mean, 4) AS mean, months, round(mean / avg(mean) OVER () * 100, 4) AS index FROM s")
def ag_14(spark, sf_dir):
    return rounded(T.seasonality_index(rows(spark, sf_dir)))


_START, _END = "1998-01-01", "1998-06-30"
_PAIR = " UNION ALL ".join(
    f"SELECT '{k}' AS kpi, {ratio_sql(k) if k in RATIOS else f'sum({k})'} AS value, p, '{BETTER[k]}' AS better FROM q GROUP BY p" for k in _ALL
)
for _name in ("ag_16", "jn_16"):

    @R.add(
        _name,
        f", q AS (SELECT *, CASE WHEN date >= DATE '{_START}' THEN 'c' ELSE 'p' END AS p FROM m WHERE date <= DATE '{_END}' AND date >= DATE '{_START}' - CAST(DATE '{_END}' - DATE '{_START}' + 1 AS INTEGER)), v AS ({_PAIR}),"
        " w AS (SELECT kpi, better, max(value) FILTER (p = 'c') AS current, max(value) FILTER (p = 'p') AS previous FROM v GROUP BY 1, 2),"
        " z AS (SELECT *, CASE WHEN current - previous IS NULL THEN 'n/a' WHEN abs(current - previous) < 1e-12 THEN 'flat' WHEN current > previous THEN 'up' ELSE 'down' END AS direction FROM w)"
        " SELECT kpi, round(current, 4) AS current, round(previous, 4) AS previous, round(current - previous, 4) AS abs_change, round((current - previous) / nullif(abs(previous), 0) * 100, 4) AS pct_change, direction,"
        " CASE WHEN better = 'none' OR direction IN ('n/a', 'flat') THEN NULL ELSE direction = better END AS is_good FROM z",
    )
    def _compare(spark, sf_dir):
        return rounded(G.period_comparison(rows(spark, sf_dir), _START, _END, PRESENT))


# ranking, folding, limits

_CAMPAIGNS = f", g AS (SELECT campaign_name, {measures_sql()}, {_SHARES} FROM m GROUP BY campaign_name)"
for _name in ("wn_11", "lim_01"):

    @R.add(_name, _CAMPAIGNS + ", r AS (SELECT campaign_name, cpl, spend_share, CAST(row_number() OVER (ORDER BY cpl, campaign_name) AS INTEGER) AS rank FROM g WHERE cpl IS NOT NULL AND spend_share >= 3) SELECT * FROM r WHERE rank <= 10")
    def _ranked(spark, sf_dir):
        table = rounded(add_shares(G.group_kpis(rows(spark, sf_dir), "campaign_name", PRESENT)))
        return C.rank_campaigns(table, "cpl", top=10, min_spend_share=3).select("campaign_name", "cpl", "spend_share", "rank")


@R.add("ag_41", ", g AS (SELECT product_category, sum(spend) AS spend, sum(leads) AS leads FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY spend DESC, product_category) AS n, count(*) OVER () AS total FROM g) SELECT CASE WHEN n <= 3 OR total <= 4 THEN product_category ELSE 'Other' END AS product_category, round(sum(spend), 4) AS spend, round(sum(leads), 4) AS leads FROM r GROUP BY 1")
def ag_41(spark, sf_dir):
    return rounded(C.group_other(rows(spark, sf_dir), "product_category", ["spend", "leads"], "spend", most=3))


@R.add("lim_03", _CAMPAIGNS + " SELECT arg_max(campaign_name, roas) AS best_roas, arg_min(campaign_name, cpl) AS best_cpl, arg_min(campaign_name, roas) AS worst_roas FROM g")
def lim_03(spark, sf_dir):
    g = rounded(G.group_kpis(rows(spark, sf_dir), "campaign_name", PRESENT))
    return g.agg(F.max_by("campaign_name", "roas").alias("best_roas"), F.min_by("campaign_name", "cpl").alias("best_cpl"), F.min_by("campaign_name", "roas").alias("worst_roas"))


@R.add("lim_02", _CAMPAIGNS + " SELECT campaign_name, spend FROM g ORDER BY spend DESC, campaign_name LIMIT 5 OFFSET 3")
def lim_02(spark, sf_dir):
    return rounded(G.group_kpis(rows(spark, sf_dir), "campaign_name", PRESENT)).select("campaign_name", "spend").orderBy(F.desc("spend"), "campaign_name").offset(3).limit(5)


@R.add("srt_03", _PROFIT_SQL.format(by="campaign_name") + " SELECT entity, round(contribution, 4) AS contribution FROM p ORDER BY contribution DESC NULLS LAST, entity")
def srt_03(spark, sf_dir):
    return rounded(profit_table(rows(spark, sf_dir), "campaign_name").select("entity", "contribution")).orderBy(F.desc_nulls_last("contribution"), "entity")


# stored SQL totals


@R.add("ag_31", "SELECT channel, round(sum(spend), 4) AS spend, round(sum(leads), 4) AS leads, round(sum(conversions), 4) AS conversions, round(sum(revenue), 4) AS revenue FROM m GROUP BY channel ORDER BY channel")
def ag_31(spark, sf_dir):
    return rounded(spark.sql("SELECT channel, sum(spend) AS spend, sum(leads) AS leads, sum(conversions) AS conversions, sum(revenue) AS revenue FROM {m} GROUP BY channel ORDER BY channel", m=rows(spark, sf_dir)))


@R.add("ag_32", "SELECT strftime(date, '%Y-%m') AS month, round(sum(spend), 4) AS spend, round(sum(revenue), 4) AS revenue FROM m GROUP BY 1 ORDER BY 1")
def ag_32(spark, sf_dir):
    return rounded(spark.sql("SELECT date_format(date, 'yyyy-MM') AS month, sum(spend) AS spend, sum(revenue) AS revenue FROM {m} GROUP BY 1 ORDER BY 1", m=rows(spark, sf_dir)))


@R.add("ag_33", "SELECT campaign_name, round(sum(conversions), 4) AS conversions, round(sum(spend), 4) AS spend FROM m GROUP BY 1 ORDER BY conversions DESC, campaign_name LIMIT 10")
def ag_33(spark, sf_dir):
    return rounded(spark.sql("SELECT campaign_name, sum(conversions) AS conversions, sum(spend) AS spend FROM {m} GROUP BY 1 ORDER BY conversions DESC, campaign_name LIMIT 10", m=rows(spark, sf_dir)))


# filters and keys

_FILTERED = "SELECT channel, count(*) AS n, round(sum(spend), 4) AS spend FROM m WHERE {where} GROUP BY channel"


def apply_filters(df: DataFrame, filters: dict[str, list[str]], start: str | None = None, end: str | None = None) -> DataFrame:
    """Membership in every listed column (an empty list means all) and an inclusive date range."""
    for column, values in filters.items():
        if values:
            df = df.where(F.col(column).isin(values))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("date") <= F.lit(end).cast("date"))


def _filtered(spark, sf_dir, *args) -> DataFrame:
    return rounded(apply_filters(rows(spark, sf_dir), *args).groupBy("channel").agg(F.count("*").alias("n"), F.sum("spend").alias("spend")))


for _name in ("prj_06", "jn_08"):

    @R.add(_name, _FILTERED.format(where="region IN ('ASIA', 'EUROPE') AND platform IN ('R')"))
    def _members(spark, sf_dir):
        return _filtered(spark, sf_dir, {"region": ["ASIA", "EUROPE"], "platform": ["R"], "channel": []})


@R.add("prj_07", _FILTERED.format(where="region IN ('ASIA') AND date BETWEEN DATE '1996-02-01' AND DATE '1997-03-31'"))
def prj_07(spark, sf_dir):
    return _filtered(spark, sf_dir, {"region": ["ASIA"]}, "1996-02-01", "1997-03-31")


@R.add("prj_08", ", d AS (SELECT min(date) AS first, max(date) AS last FROM m), p AS (SELECT 'last_30' AS preset, greatest(last - 29, first) AS start, last AS end_date FROM d UNION ALL SELECT 'last_90', greatest(last - 89, first), last FROM d) SELECT preset, start, end_date, count(*) AS n FROM p JOIN m ON date BETWEEN start AND end_date GROUP BY 1, 2, 3", dates=("start", "end_date"))
def prj_08(spark, sf_dir):
    df = rows(spark, sf_dir)
    bounds = df.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    presets = bounds.select(F.explode(F.array(*(F.struct(F.lit(f"last_{n}").alias("preset"), F.greatest(F.date_sub("last", n - 1), "first").alias("start"), F.col("last").alias("end_date")) for n in (30, 90)))).alias("p")).select("p.*")
    return df.join(F.broadcast(presets), F.col("date").between(F.col("start"), F.col("end_date"))).groupBy("preset", "start", "end_date").agg(F.count("*").alias("n")).transform(rounded)


@R.add("prj_05", "SELECT count(spend) > 0 AS spend, count(leads) > 0 AS leads, count(CASE WHEN false THEN 1 END) > 0 AS customers FROM m")
def prj_05(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("customers", F.lit(None).cast("double"))
    present = presence(df)
    return spark.range(1).select(*(F.lit(c in present).alias(c) for c in ("spend", "leads", "customers")))


@R.add("prj_09", "SELECT unnest(['channel', 'platform', 'region', 'customer_segment', 'product_category']) AS dimension", m=False)
def prj_09(spark, sf_dir):
    from tallyspark.schema import DIMENSIONS

    present = presence(rows(spark, sf_dir))
    return spark.createDataFrame([(d,) for d in DIMENSIONS if d in present], "dimension string")


@R.add("prj_10", "SELECT 'campaign_name' AS campaign, 'channel' AS channel, 'revenue' AS outcome", m=False)
def prj_10(spark, sf_dir):
    present = presence(rows(spark, sf_dir))
    return spark.createDataFrame([(campaign_key(present), channel_key(present), primary_outcome(present))], "campaign string, channel string, outcome string")


@R.add("prj_17", ", e AS (SELECT * FROM m WHERE channel = '1-URGENT') SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, count(*) AS rows, " + measures_sql(["spend", "revenue", "roas", "cpl"]) + " FROM e WHERE date BETWEEN DATE '1997-05-05' - 28 AND DATE '1997-05-05' + 14 GROUP BY 1", dates=("week_start",))
def prj_17(spark, sf_dir):
    near = apply_filters(rows(spark, sf_dir), {"channel": ["1-URGENT"]}, "1997-04-07", "1997-05-19").withColumn("week_start", F.to_date(F.date_trunc("week", "date")))
    return rounded(G.group_kpis(near, "week_start", PRESENT).select("week_start", "rows", "spend", "revenue", "roas", "cpl"))


_WEEKLY = ", g AS (SELECT CAST(date_trunc('week', date) AS DATE) AS period, count(DISTINCT date) AS days, sum(spend) AS spend, sum(leads) AS leads FROM m GROUP BY 1), p AS (SELECT *, (period = min(period) OVER () OR period = max(period) OVER ()) AND days < 7 AS partial FROM g), f AS (SELECT * FROM (SELECT *, count(*) FILTER (NOT partial) OVER () AS n FROM p) WHERE NOT partial OR n < 2)"


@R.add("prj_19", _WEEKLY + " SELECT period, days, round(spend, 4) AS spend FROM f", dates=("period",))
def prj_19(spark, sf_dir):
    return rounded(T.full_weeks(T.time_series(rows(spark, sf_dir), "week", [])).select("period", "days", "spend"))


for _name in ("prj_20", "wn_19"):

    @R.add(_name, _WEEKLY + ", x AS (SELECT *, row_number() OVER (ORDER BY period DESC) AS k FROM f) SELECT period, 'spend' AS kpi, round(spend, 4) AS value FROM x WHERE k <= 12 UNION ALL SELECT period, 'leads', round(leads, 4) FROM x WHERE k <= 12", dates=("period",))
    def _spark_lines(spark, sf_dir):
        return rounded(T.sparkline(T.time_series(rows(spark, sf_dir), "week", []), ["spend", "leads"]))


# profitability

_PROFIT_COLUMNS = ["spend", "revenue", "gross_profit", "roas", "gross_margin_pct", "break_even_roas", "contribution", "profit_per_rupee", "roas_headroom"]


_FINE = "campaign_name || '/' || platform || '/' || CAST(year(date) AS VARCHAR) || '/' || CAST(month(date) AS VARCHAR)"


def _fine(spark, sf_dir) -> DataFrame:
    name = F.concat_ws("/", "campaign_name", "platform", F.year("date"), F.month("date"))
    return profit_table(rows(spark, sf_dir).withColumn("campaign_name", name), "campaign_name")


@R.add("ag_22", _PROFIT_SQL.format(by=_FINE) + " SELECT status, count(*) AS campaigns, round(sum(contribution), 4) AS contribution, round(sum(spend), 4) AS spend, round(sum(spend) / sum(sum(spend)) OVER () * 100, 4) AS spend_share FROM p GROUP BY status")
def ag_22(spark, sf_dir):
    by_status = _fine(spark, sf_dir).groupBy("status").agg(F.count("*").alias("campaigns"), F.sum("contribution").alias("contribution"), F.sum("spend").alias("spend"))
    return rounded(by_status.withColumn("spend_share", F.col("spend") / F.sum("spend").over(Window.partitionBy()) * 100))


@R.add("ag_23", _PROFIT_SQL.format(by="campaign_name") + " SELECT entity, round(contribution, 4) AS contribution, status FROM p WHERE contribution < 0 ORDER BY contribution, entity LIMIT 5")
def ag_23(spark, sf_dir):
    return rounded(loss_makers(profit_table(rows(spark, sf_dir), "campaign_name"), 5).select("entity", "contribution", "status"))


for _name in ("ag_24",):

    @R.add(_name, ", mo AS (SELECT strftime(date, '%Y-%m') AS month, count(DISTINCT date) AS days, max(day(last_day(date))) AS full_days, " + measures_sql(["spend", "revenue", "leads", "roas", "cpl"]) + " FROM m GROUP BY 1) SELECT month, days, days = full_days AS complete, spend, revenue, leads, roas, cpl FROM mo")
    def _actuals(spark, sf_dir):
        from tallyspark.operators.targets import monthly_actuals

        return rounded(monthly_actuals(rows(spark, sf_dir), PRESENT).select("month", "days", "complete", "spend", "revenue", "leads", "roas", "cpl"))


@R.add("fn_03", _PROFIT_SQL.format(by=_FINE) + " SELECT entity, status FROM p")
def fn_03(spark, sf_dir):
    return _fine(spark, sf_dir).select("entity", "status")


# set operations


@R.add("set_01", "SELECT 'channel' AS entity_type, channel AS entity, 'spend' AS metric, round(sum(spend), 4) AS value FROM m GROUP BY channel UNION ALL SELECT 'region', region, 'spend', round(sum(spend), 4) FROM m GROUP BY region")
def set_01(spark, sf_dir):
    df = rows(spark, sf_dir)
    parts = [df.groupBy(F.col(c).alias("entity")).agg(F.sum("spend").alias("value")).select(F.lit(c).alias("entity_type"), "entity", F.lit("spend").alias("metric"), "value") for c in ("channel", "region")]
    return rounded(parts[0].unionByName(parts[1]))


@R.add("set_03", "SELECT DISTINCT channel, region FROM m")
def set_03(spark, sf_dir):
    return rows(spark, sf_dir).select("channel", "region").dropDuplicates()




#: Part and supplier as the campaign: regions then share most but not all.
_PAIR = "CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING)"
_BY_REGION = ", a AS (SELECT DISTINCT campaign_name FROM m WHERE region = 'ASIA'), b AS (SELECT DISTINCT campaign_name FROM m WHERE region = 'EUROPE')"


@R.add("set_04", _BY_REGION + " SELECT (SELECT count(*) FROM a SEMI JOIN b USING (campaign_name)) > 0 AS overlap, (SELECT count(*) FROM a ANTI JOIN b USING (campaign_name)) AS only_asia, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS together", campaign=_PAIR)
def set_04(spark, sf_dir):
    """Sets of campaigns of two regions, over all rows, as counts over one row a campaign."""
    flags = rows(spark, sf_dir, _PAIR).groupBy("campaign_name").agg(*(F.bool_or(F.coalesce(F.col("region") == r, F.lit(False))).alias(n) for r, n in (("ASIA", "x"), ("EUROPE", "y"))))
    return flags.agg(F.coalesce(F.bool_or(F.col("x") & F.col("y")), F.lit(False)).alias("overlap"), F.count_if(F.col("x") & ~F.col("y")).alias("only_asia"), F.count_if(F.col("x") | F.col("y")).alias("together"))


@R.add("set_05", _BY_REGION + " SELECT campaign_name FROM a EXCEPT SELECT campaign_name FROM b", campaign=_PAIR)
def set_05(spark, sf_dir):
    df = rows(spark, sf_dir, _PAIR)
    return df.where("region = 'ASIA'").select("campaign_name").distinct().join(df.where("region = 'EUROPE'").select("campaign_name").distinct(), "campaign_name", "left_anti")


# joins over stored runs and lookups


@R.add("jn_18", "SELECT campaign_name, mode(channel ORDER BY channel) AS channel, mode(platform ORDER BY platform) AS platform FROM m GROUP BY 1")
def jn_18(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("campaign_name").agg(F.mode("channel", True).alias("channel"), F.mode("platform", True).alias("platform"))


@R.add("jn_06", ", w AS (SELECT unnest(generate_series((SELECT min(date) FROM m), (SELECT max(date) FROM m), INTERVAL 1 DAY)) AS d), s AS (SELECT date, sum(spend) AS spend FROM m WHERE channel = '1-URGENT' AND region = 'ASIA' GROUP BY 1) SELECT CAST(d AS DATE) AS date, round(coalesce(spend, 0), 4) AS spend FROM w LEFT JOIN s ON s.date = CAST(d AS DATE)", dates=("date",))
def jn_06(spark, sf_dir):
    df = rows(spark, sf_dir)
    grid = df.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    daily = df.where("channel = '1-URGENT' and region = 'ASIA'").groupBy("date").agg(F.sum("spend").alias("spend"))
    return rounded(grid.join(daily, "date", "left").select("date", F.coalesce("spend", F.lit(0.0)).alias("spend")))


# from a cube of sums by day and dimension, written once for each query here and once for each run elsewhere

_DIMS = ["channel", "region", "customer_segment", "product_category", "campaign_name"]


def _cube(spark, sf_dir) -> Cube:
    """Rows of the first years at once, the others added later."""
    cube, df = Cube(spark, new_folder(spark, "cube")), campaign_rows(spark, sf_dir)
    cube.build("r", df.where("date < DATE '1999-01-01'"), _DIMS, [["channel"], ["region", "channel"], ["campaign_name"], []])
    cube.add("r", df.where("date >= DATE '1999-01-01'"))
    return cube


_IN_VIEW = {"channel": ["1-URGENT", "3-MEDIUM"], "region": ["ASIA", "EUROPE", "AMERICA"]}
_VIEW_SQL = "channel IN ('1-URGENT', '3-MEDIUM') AND region IN ('ASIA', 'EUROPE', 'AMERICA')"
_FROM_CUBE = {
    "cube_ag_01": ([], None, None, None, "true"),
    "cube_ag_03": (["channel"], None, None, None, "true"),
    "cube_ag_11": (["campaign_name"], None, None, None, "true"),
    "cube_ag_12": (["customer_segment"], None, None, None, "true"),
    "cube_ag_13": (["week"], None, None, None, "true"),
    "cube_ag_24": (["month"], None, None, None, "true"),
    "cube_ag_32": (["month", "channel"], None, None, None, "true"),
    "cube_prj_06": (["region"], _IN_VIEW, None, None, _VIEW_SQL),
    "cube_prj_07": (["channel"], _IN_VIEW, "1997-01-15", "1998-03-02", _VIEW_SQL + " AND date BETWEEN DATE '1997-01-15' AND DATE '1998-03-02'"),
    "cube_prj_08": (["channel", "region"], None, "1998-06-01", None, "date >= DATE '1998-06-01'"),
    "cube_ag_16": (["product_category"], {"channel": ["2-HIGH"]}, "1998-01-01", "1998-01-31", "channel = '2-HIGH' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'"),
}
_KEY_SQL = {"week": "CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS week", "month": "strftime(date, '%Y-%m') AS month"}
for _name, (_by, _values, _start, _end, _where) in _FROM_CUBE.items():
    _keys = "".join(_KEY_SQL.get(b, f"coalesce({b}, '(none)') AS {b}") + ", " for b in _by)

    @R.add(_name, f"SELECT {_keys}count(*) AS rows, {measures_sql()} FROM m WHERE {_where}" + (f" GROUP BY {', '.join(str(i + 1) for i in range(len(_by)))}" if _by else ""))
    def _asked(spark, sf_dir, by=tuple(_by), values=_values, start=_start, end=_end):
        return rounded(_cube(spark, sf_dir).kpis("r", list(by), values, start, end))


QUERIES, ORACLE_SQL = R.queries, R.sql
