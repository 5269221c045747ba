"""Weekly anomalies, outages and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.anomaly import baseline, before, islands, rolling, spread
from tallyspark.operators import anomalies as A
from tallyspark.operators import incidents as I
from tallyspark.operators.containment import contained
from tallyspark.operators.intervals import overlapping
from tallyspark.sources.shared import new_folder

from .build import Registry, rounded
from .canonical import campaign_rows

R = Registry()
CAMPAIGN = "c_mktsegment"


def rows(spark, sf_dir) -> DataFrame:
    return campaign_rows(spark, sf_dir, CAMPAIGN)


def add(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    return R.add(name, sql, campaign=CAMPAIGN, dates=dates)


def grid_sql(entity: str, metric: str, tag: str = "") -> str:
    spec = A.METRICS[metric]
    known = f"FILTER ({spec.numerator} IS NOT NULL" + (f" AND {spec.denominator} IS NOT NULL)" if spec.denominator else ")")
    den = f"sum({spec.denominator}) {known}" if spec.denominator else "count(*) FILTER (spend IS NOT NULL) * 1.0e0"
    events = f"sum({spec.count})" if spec.count else "CAST(NULL AS DOUBLE)"
    return (
        f", s{tag} AS (SELECT {entity} AS entity, CAST(date_trunc('week', date) AS DATE) AS week, sum({spec.numerator}) {known} AS num, {den} AS den, {events} AS events, count(DISTINCT date) = 7 AS full_week FROM m WHERE {entity} IS NOT NULL GROUP BY 1, 2),"
        f" g{tag} AS (SELECT entity, week, num, den, events, coalesce(full_week, false) AS full_week FROM (SELECT DISTINCT entity FROM s{tag}) CROSS JOIN (SELECT DISTINCT week FROM s{tag}) LEFT JOIN s{tag} USING (entity, week))"
    )


def stable_sql(entity: str, tag: str = "") -> str:
    return (
        f", cd{tag} AS (SELECT {entity} AS entity, campaign_name AS campaign, CAST(date_trunc('week', date) AS DATE) AS week, count(DISTINCT date) AS days FROM m GROUP BY 1, 2, 3),"
        f" cg{tag} AS (SELECT entity, campaign, week, CASE WHEN days IS NULL THEN 0 WHEN days = 7 THEN 1 ELSE 2 END AS status FROM (SELECT DISTINCT entity, campaign FROM cd{tag}) CROSS JOIN (SELECT DISTINCT week FROM cd{tag}) LEFT JOIN cd{tag} USING (entity, campaign, week)),"
        f" cs{tag} AS (SELECT entity, week, status <> 2 AND max(status) OVER w = min(status) OVER w AS same FROM cg{tag} WINDOW w AS (PARTITION BY entity, campaign ORDER BY week ROWS 8 PRECEDING)),"
        f" st{tag} AS (SELECT entity, week, bool_and(same) AS stable FROM cs{tag} GROUP BY 1, 2)"
    )


def judge_sql(metric: str, window: int, tag: str = "", grid: str = "", stable: str | None = None) -> str:
    spec, sh = A.METRICS[metric], window - 1
    ratio = spec.denominator is not None
    source = f"g{grid}" if stable is None else f"(SELECT g{grid}.* REPLACE (full_week AND coalesce(stable, true) AS full_week) FROM g{grid} LEFT JOIN st{stable} USING (entity, week))"
    long = f"(PARTITION BY entity ORDER BY week ROWS BETWEEN {8 + sh} PRECEDING AND {1 + sh} PRECEDING)"
    near = "(PARTITION BY entity ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"
    cur = f"(PARTITION BY entity ORDER BY week ROWS BETWEEN {sh} PRECEDING AND CURRENT ROW)"
    value1 = f"num / nullif(den, 0) * {spec.scale}" if ratio else "num"
    value = f"sum(num) OVER {cur} / nullif(sum(den) OVER {cur}, 0) * {spec.scale}" if ratio else f"sum(num) OVER {cur} / {window}"

    def base(x: str, frame: str) -> str:
        return f"CASE WHEN count({x}) OVER {frame} >= 4 THEN median({x}) OVER {frame} END"

    a = (
        f", a{tag} AS (SELECT *, full_week AND ({value1}) IS NOT NULL AS ok1, {value1} AS value1 FROM {source}),"
        f" b{tag} AS (SELECT *, CASE WHEN ok1 THEN value1 END AS known, CASE WHEN ok1 THEN {'den' if ratio else 'num'} END AS vol, CASE WHEN ok1 THEN events END AS ev FROM a{tag}),"
        f" c{tag} AS (SELECT *, {base('known', long)} AS base, {base('known', near)} AS base1, {base('vol', long)} AS base_volume, {base('ev', long)} AS base_events,"
        f" CASE WHEN count(num) OVER {cur} = {window} THEN {value} END AS value, count(*) FILTER (ok1) OVER {cur} = {window} AS whole FROM b{tag}),"
        f" d{tag} AS (SELECT *, coalesce(whole AND base IS NOT NULL AND base <> 0 AND base_volume >= {spec.least_volume}, false) AS ok FROM c{tag}),"
        f" e{tag} AS (SELECT *, CASE WHEN ok THEN value / nullif(base, 0) END AS r, CASE WHEN ok1 THEN value1 / nullif(base1, 0) END AS r1 FROM d{tag}),"
        f" f{tag} AS (SELECT *, CASE WHEN count(r) OVER w >= 3 THEN median(r) OVER w ELSE 1.0 END AS common, CASE WHEN count(r1) OVER w >= 3 THEN median(r1) OVER w ELSE 1.0 END AS common1 FROM e{tag} WINDOW w AS (PARTITION BY week)),"
        f" h{tag} AS (SELECT *, r / nullif(common, 0) AS a, r1 / nullif(common1, 0) AS a1 FROM f{tag}),"
        f" i{tag} AS (SELECT *, list(a1) FILTER (a1 IS NOT NULL) OVER {long} AS past FROM h{tag}),"
        f" j{tag} AS (SELECT *, CASE WHEN len(past) >= 4 THEN list_aggregate(list_transform(past, lambda x: abs(x - list_aggregate(past, 'median'))), 'median') END AS mad FROM i{tag}),"
        f" k{tag} AS (SELECT *, (a - 1) / CASE WHEN mad IS NOT NULL THEN greatest(1.4826 * mad / sqrt({window}), 0.05) END AS score0, (a - 1) * 100 AS pct FROM j{tag}),"
    )
    if spec.count:
        z = f"2 * (sqrt(greatest(a * base_events * {window}, 0)) - sqrt(base_events * {window}))"
        score = f"CASE WHEN score0 IS NOT NULL AND a IS NOT NULL AND base_events IS NOT NULL THEN sign(score0) * least(abs(score0), abs({z})) END"
    else:
        score = "score0"
    kept = f"CASE WHEN pct > 0 THEN count(*) FILTER (a1 - 1 >= 0.15) OVER {cur} ELSE count(*) FILTER (1 - a1 >= 0.15) OVER {cur} END >= {window - 1}" if window > 1 else "true"
    return a + (
        f" l{tag} AS (SELECT *, {score} AS score, {kept} AS sustained FROM k{tag}),"
        f" n{tag} AS (SELECT entity, week, value, base * common AS baseline, base, mad, common, score, pct, sustained, whole, coalesce(ok AND abs(score) >= 4 AND abs(pct) >= 30 AND sustained, false) AS flag FROM l{tag})"
    )


_G = grid_sql("channel", "spend")
_J1, _J3 = judge_sql("spend", 1, "1"), judge_sql("spend", 3, "3")


def _spend_grid(spark, sf_dir) -> DataFrame:
    return A.weekly_grid(rows(spark, sf_dir), "channel", "spend").withColumn("known", F.when(F.col("full"), F.col("num")))


@add("wn_01", _G + _J3 + " SELECT entity, week, round(base, 4) AS base FROM n3", ("week",))
def wn_01(spark, sf_dir):
    return rounded(_spend_grid(spark, sf_dir).select("entity", "week", baseline(F.col("known"), before(["entity"], "week", 2)).alias("base")))


@add("wn_02", _G + ", x AS (SELECT *, CASE WHEN full_week THEN num END AS known FROM g), y AS (SELECT entity, week, list(known) FILTER (known IS NOT NULL) OVER (PARTITION BY entity ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS p FROM x) SELECT entity, week, CASE WHEN len(p) >= 4 THEN round(list_aggregate(list_transform(p, lambda v: abs(v - list_aggregate(p, 'median'))), 'median'), 6) END AS mad FROM y", ("week",))
def wn_02(spark, sf_dir):
    return rounded(_spend_grid(spark, sf_dir).select("entity", "week", spread(F.col("known"), before(["entity"], "week", 0)).alias("mad")), 6)


@add("wn_03", _G + " SELECT entity, week, CASE WHEN count(num) OVER w = 3 THEN round(sum(num) OVER w, 4) END AS num, CASE WHEN count(den) OVER w = 3 THEN sum(den) OVER w END AS den FROM g WINDOW w AS (PARTITION BY entity ORDER BY week ROWS 2 PRECEDING)".replace("sum(den)", "round(sum(den), 4)").replace("round(sum(den), 4) OVER w", "round(sum(den) OVER w, 4)"), ("week",))
def wn_03(spark, sf_dir):
    w = rolling(["entity"], "week", 3)
    df = rows(spark, sf_dir).groupBy(F.col("channel").alias("entity"), F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.sum("spend").alias("num"), F.count("spend").cast("double").alias("den"))
    grid = df.select("entity").distinct().crossJoin(df.select("week").distinct()).join(df, ["entity", "week"], "left")
    return rounded(grid.select("entity", "week", *(F.when(F.count(c).over(w) == 3, F.sum(c).over(w)).alias(c) for c in ("num", "den"))))


@add("wn_04", _G + _J3 + " SELECT entity, week, whole FROM n3", ("week",))
def wn_04(spark, sf_dir):
    return rounded(_spend_grid(spark, sf_dir).select("entity", "week", (F.count("known").over(rolling(["entity"], "week", 3)) == 3).alias("whole")))


_SCORED = "SELECT entity, week, round(value, 4) AS value, round(baseline, 3) AS baseline, round(score, 4) AS score, round(pct, 4) AS pct, flag FROM {n} WHERE score IS NOT NULL"


def _scored(judged: DataFrame) -> DataFrame:
    return rounded(judged.where("score is not null").select("entity", "week", "value", F.round("baseline", 3).alias("baseline"), "score", "pct", "flag"))


for _name in ("wn_05", "ano_03"):

    @add(_name, _G + _J3 + " " + _SCORED.format(n="n3"), ("week",))
    def _three(spark, sf_dir):
        return _scored(A.judge(A.weekly_grid(rows(spark, sf_dir), "channel", "spend"), "spend", 3))


for _metric in ("cpl", "cpc", "revenue", "clicks", "lead_qualification_rate", "lead_to_conversion_rate"):

    def _judged(spark, sf_dir, metric=_metric):
        return _scored(A.judge(A.weekly_grid(rows(spark, sf_dir), "platform", metric), metric, 1))

    add(f"ano_03_{_metric}", grid_sql("platform", _metric) + judge_sql(_metric, 1, "1") + " " + _SCORED.format(n="n1"), ("week",))(_judged)


@add("wn_06", stable_sql("channel") + " SELECT entity, week, stable FROM st", ("week",))
def wn_06(spark, sf_dir):
    return rounded(A.stable_composition(rows(spark, sf_dir), "channel", "campaign_name"))


@add("wn_07", _G + " SELECT week, round(CASE WHEN count(num) >= 3 THEN median(num) ELSE 1.0 END, 3) AS common FROM g GROUP BY week", ("week",))
def wn_07(spark, sf_dir):
    w = Window.partitionBy("week")
    grid = A.weekly_grid(rows(spark, sf_dir), "channel", "spend")
    return rounded(grid.select("week", F.when(F.count("num").over(w) >= 3, F.percentile("num", 0.5).over(w)).otherwise(1.0).alias("common")).distinct(), 3)


# merged periods: the weekly detector over channels, like for like

#: Every channel spends four times as much in one week of thirteen, and a launch campaign ends early, so that the campaigns' mix is stable afterwards.
_HIT = "(date - DATE '1995-01-02') // 7 % 13 = CAST(substr(channel, 1, 1) AS INTEGER) * 2"
_PLANT = f", pm AS (SELECT * REPLACE (spend * CASE WHEN {_HIT} THEN 4 ELSE 1 END AS spend, CASE WHEN date < DATE '1995-02-06' THEN 'launch' ELSE 'always on' END AS campaign_name) FROM m)"


def _planted(spark, sf_dir) -> DataFrame:
    hit = F.floor(F.datediff("date", F.lit("1995-01-02").cast("date")) / 7) % 13 == F.substring("channel", 1, 1).cast("int") * 2
    campaign = F.when(F.col("date") < "1995-02-06", "launch").otherwise("always on")
    return rows(spark, sf_dir).withColumn("spend", F.col("spend") * F.when(hit, 4).otherwise(1)).withColumn("campaign_name", campaign)


_FLAGS = (
    _PLANT + _G.replace("FROM m ", "FROM pm ") + stable_sql("channel").replace("FROM m ", "FROM pm ") + judge_sql("spend", 1, "1", stable="") + judge_sql("spend", 3, "3", stable="")
    + ", fl AS (SELECT entity, 'spend' AS metric, week AS start, week + 6 AS end_date, value, baseline, score, pct, CAST(sign(score) AS INTEGER) AS sign FROM n1 WHERE flag"
    " UNION ALL SELECT entity, 'spend', week - 14, week + 6, value, baseline, score, pct, CAST(sign(score) AS INTEGER) FROM n3 WHERE flag),"
    " o1 AS (SELECT *, max(end_date) OVER (PARTITION BY entity, metric, sign ORDER BY start, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fl),"
    " o2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity, metric, sign ORDER BY start, end_date ROWS UNBOUNDED PRECEDING) AS island FROM o1),"
    " mp AS (SELECT entity, metric, sign, min(start) AS start, max(end_date) AS end_date, count(*) AS parts, max(abs(score)) AS peak, arg_max(pct, abs(score)) AS pct, arg_max(value, abs(score)) AS value, arg_max(baseline, abs(score)) AS baseline FROM o2 GROUP BY entity, metric, sign, island)"
)


def _merged(spark, sf_dir) -> DataFrame:
    return A.weekly_anomalies(_planted(spark, sf_dir), "channel", "channel", "campaign_name", ["spend"])


_MERGED_SQL = " SELECT entity, metric, sign, start, end_date, round(peak, 4) AS peak, round(pct, 4) AS pct FROM mp"


def _merged_view(spark, sf_dir) -> DataFrame:
    return rounded(_merged(spark, sf_dir).select("entity", "metric", "sign", "start", F.col("end").alias("end_date"), F.abs("score").alias("peak"), "pct"))


for _name in ("ano_02", "ano_04", "wn_15", "srt_01"):
    add(_name, _FLAGS + _MERGED_SQL + " ORDER BY start, entity, metric", ("start", "end_date"))(lambda spark, sf_dir: _merged_view(spark, sf_dir).orderBy("start", "entity", "metric"))


@add("ano_06", _FLAGS + " SELECT entity, start, CASE WHEN pct > 0 THEN 'above' ELSE 'below' END AS direction, 'check' AS sentiment, CASE WHEN peak >= 6 AND abs(pct) >= 50 THEN 'high' ELSE 'medium' END AS severity FROM mp", ("start",))
def ano_06(spark, sf_dir):
    return rounded(_merged(spark, sf_dir).select("entity", "start", "direction", "sentiment", "severity"))


def _stored(df: DataFrame) -> DataFrame:
    """A small table written to the shared folder and read back."""
    df.write.mode("overwrite").parquet(path := new_folder(df.sparkSession, "weekly"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ENTITIES = (("campaign_name", "campaign"), ("channel", "channel"), ("region", "region"))
_FOUND = ("entity_type", "entity", "metric", "start", "end", "score", "pct", "direction", "sentiment", "severity")


def _all_found(df: DataFrame) -> DataFrame:
    """All metrics over campaigns, channels and regions, and the outages of platforms (severe, without a score)."""
    outages = A.tracking_outages(df, "campaign_name", "platform").select(
        F.lit("platform").alias("entity_type"), F.col("owner").alias("entity"), F.lit("clicks").alias("metric"), "start", "end", F.lit(None).cast("double").alias("score"),
        ((F.try_divide("observed", "baseline") - 1) * 100).alias("pct"), F.lit("below").alias("direction"), F.lit("negative").alias("sentiment"), F.lit("high").alias("severity"),
    )
    for column, kind in _ENTITIES:
        outages = outages.unionByName(A.weekly_anomalies(df, column, kind, "campaign_name", store=_stored).select(*_FOUND))
    return outages


@add("ano_01")
def ano_01(spark, sf_dir):
    return rounded(_all_found(rows(spark, sf_dir)).withColumnRenamed("end", "end_date"))


# outages, on rows with clicks lost for a few days

_LOST = "CASE WHEN campaign_name IN ('BUILDING', 'MACHINERY') AND date BETWEEN DATE '1997-03-03' AND DATE '1997-03-05' OR campaign_name = 'BUILDING' AND date = DATE '1998-08-10' THEN 0e0 ELSE clicks END"
_DAILY = (
    f", q AS (SELECT * REPLACE ({_LOST} AS clicks) FROM m), dd AS (SELECT campaign_name AS campaign, date, coalesce(sum(spend), 0) AS spend, sum(clicks) AS clicks FROM q GROUP BY 1, 2),"
    " bb AS (SELECT *, CASE WHEN count(clicks) OVER w >= 7 THEN median(clicks) OVER w END AS base_clicks, CASE WHEN count(spend) OVER w >= 7 THEN median(spend) OVER w END AS base_spend FROM dd WINDOW w AS (PARTITION BY campaign ORDER BY date RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),"
    " hit AS (SELECT * FROM bb WHERE spend > 0 AND base_clicks >= 20 AND clicks <= 0.05 * base_clicks AND spend >= 0.25 * base_spend)"
)


def _lost(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir).withColumn("clicks", F.expr(_LOST))


@add("wn_08", _DAILY + " SELECT campaign, date, round(clicks, 4) AS clicks, round(base_clicks, 4) AS base_clicks, round(base_spend, 3) AS base_spend FROM hit", ("date",))
def wn_08(spark, sf_dir):
    return rounded(A.outage_days(_lost(spark, sf_dir), "campaign_name").select("campaign", "date", "clicks", "base_clicks", F.round("base_spend", 3).alias("base_spend")))


for _name in ("ano_05", "wn_16"):

    @add(_name, _DAILY + ", ow AS (SELECT campaign_name AS campaign, mode(platform ORDER BY platform) AS owner FROM m GROUP BY 1), dy AS (SELECT owner, date, sum(clicks) AS clicks, sum(base_clicks) AS base, count(*) AS n FROM hit JOIN ow USING (campaign) GROUP BY 1, 2), rr AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY owner ORDER BY date) AS INTEGER) AS run FROM dy) SELECT owner, min(date) AS start, max(date) AS end_date, count(*) AS days, round(avg(clicks), 4) AS observed, round(avg(base), 4) AS baseline FROM rr GROUP BY owner, run", ("start", "end_date"))
    def _outages(spark, sf_dir):
        found = A.tracking_outages(_lost(spark, sf_dir), "campaign_name", "platform")
        return rounded(found.select("owner", "start", F.col("end").alias("end_date"), "days", "observed", "baseline"))


# incidents

_IMPACT = (
    _FLAGS + ", day AS (SELECT channel, date, sum(spend) AS spend FROM pm GROUP BY 1, 2),"
    " im AS (SELECT mp.entity, mp.start, mp.end_date, mp.peak, mp.pct, abs(sum(day.spend) - mp.baseline * ((mp.end_date - mp.start + 1) / 7.0)) AS impact FROM mp JOIN day ON channel = entity AND date BETWEEN start AND end_date GROUP BY mp.entity, mp.start, mp.end_date, mp.peak, mp.pct, mp.baseline, mp.sign)"
)


def _with_impact(spark, sf_dir) -> DataFrame:
    return I.flag_impact(_merged(spark, sf_dir), _planted(spark, sf_dir), "channel")


for _name in ("inc_01", "jn_11"):

    @add(_name, _IMPACT + " SELECT entity, start, end_date, round(impact, 3) AS impact, 'loss' AS impact_kind FROM im", ("start", "end_date"))
    def _impact(spark, sf_dir):
        return rounded(_with_impact(spark, sf_dir).select("entity", "start", F.col("end").alias("end_date"), "impact", "impact_kind"), 3)


_GROUPED = (
    _IMPACT + ", p1 AS (SELECT *, max(end_date) OVER (PARTITION BY entity ORDER BY start, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM im),"
    " p2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY start, end_date ROWS UNBOUNDED PRECEDING) AS incident FROM p1)"
)
for _name in ("inc_02", "wn_17"):

    @add(_name, _GROUPED + " SELECT entity, start, end_date, CAST(incident AS BIGINT) AS incident FROM p2", ("start", "end_date"))
    def _same(spark, sf_dir):
        return rounded(I.group_same_entity(_with_impact(spark, sf_dir)).select("entity", "start", F.col("end").alias("end_date"), "incident"))


for _name in ("inc_05", "wn_12"):

    @add(_name, _GROUPED + ", ii AS (SELECT entity, min(start) AS start, max(end_date) AS end_date, count(*) AS n_flags, max(impact) AS impact, max(CASE WHEN peak >= 6 AND abs(pct) >= 50 THEN 1 ELSE 0 END) AS high FROM p2 GROUP BY entity, incident) SELECT entity, start, end_date, n_flags, round(impact, 3) AS impact, CASE WHEN high = 1 THEN 'high' ELSE 'medium' END AS severity, CAST(row_number() OVER (ORDER BY impact DESC, start, entity) AS INTEGER) AS rank FROM ii", ("start", "end_date"))
    def _incidents(spark, sf_dir):
        table = I.incident_table(I.group_same_entity(_with_impact(spark, sf_dir)))
        return rounded(table.select("entity", "start", F.col("end").alias("end_date"), "n_flags", "impact", "severity", "rank"), 3)


@add("inc_06", _GROUPED + " SELECT entity, min(start) AS start, entity || ' : spend ' || CASE WHEN arg_max(pct, impact) > 0 THEN 'above' ELSE 'below' END || ' baseline' AS headline FROM p2 GROUP BY entity, incident", ("start",))
def inc_06(spark, sf_dir):
    return rounded(I.incident_table(I.group_same_entity(_with_impact(spark, sf_dir))).select("entity", "start", "headline"))


@add("inc_03")
def inc_03(spark, sf_dir):
    df = rows(spark, sf_dir)
    flags = _all_found(df).withColumn("entity_type", F.when(F.col("entity_type") == "platform", "outage").otherwise(F.col("entity_type")))
    everyone = None
    for column, kind in (*_ENTITIES, ("platform", "outage")):
        own = I.members(df, column, "campaign_name").withColumn("entity_type", F.lit(kind))
        everyone = own if everyone is None else everyone.unionByName(own)
    runs = I.group_same_entity(flags).groupBy("entity_type", "entity", "incident").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    numbered = runs.withColumn("number", F.row_number().over(Window.orderBy("start", "entity_type", "entity", "incident")).cast("long"))
    return rounded(I.attach(numbered.drop("incident"), everyone).select("number", "entity_type", "entity", "start", F.col("end").alias("end_date"), "parent"))


@add("jn_10", _FLAGS + " SELECT a.entity AS a, b.entity AS b, a.start AS a_start, b.start AS b_start FROM mp a JOIN mp b ON a.entity < b.entity AND a.start <= b.end_date + 1 AND b.start <= a.end_date + 1", ("a_start", "b_start"))
def jn_10(spark, sf_dir):
    flags = _merged(spark, sf_dir).select("entity", "start", "end")
    pairs = overlapping(flags, flags, slack=1).where("a_entity < b_entity")
    return rounded(pairs.select(F.col("a_entity").alias("a"), F.col("b_entity").alias("b"), "a_start", "b_start"))


@add("prj_14", _FLAGS + _MERGED_SQL + " WHERE start <= DATE '1997-12-31' AND end_date >= DATE '1997-01-01'", ("start", "end_date"))
def prj_14(spark, sf_dir):
    flags = I.in_view(_merged(spark, sf_dir), "1997-01-01", "1997-12-31")
    return rounded(flags.select("entity", "metric", "sign", "start", F.col("end").alias("end_date"), F.abs("score").alias("peak"), "pct"))


@add("prj_15", _GROUPED + ", ii AS (SELECT entity, min(start) AS start, max(end_date) AS end_date, count(*) AS n_flags FROM p2 GROUP BY entity, incident) SELECT * FROM ii WHERE start <= DATE '1997-12-31' AND end_date >= DATE '1996-06-01' AND entity IN (SELECT channel FROM pm WHERE campaign_name IN ('always on', 'no such campaign'))", ("start", "end_date"))
def prj_15(spark, sf_dir):
    """Incidents that overlap the dates and share a campaign with the chosen ones."""
    table = I.incident_table(I.group_same_entity(_with_impact(spark, sf_dir))).join(I.members(_planted(spark, sf_dir), "channel", "campaign_name"), "entity")
    view = I.in_view(table, "1996-06-01", "1997-12-31", ["always on", "no such campaign"])
    return rounded(view.select("entity", "start", F.col("end").alias("end_date"), "n_flags"))


#: Parts as campaigns: most but not all parts of a category are sold in each region.
_PART = "CAST(l_partkey AS STRING)"


@R.add("ag_40", " SELECT product_category AS entity, CAST(count(DISTINCT campaign_name) AS INTEGER) AS n, string_agg(DISTINCT campaign_name, ',' ORDER BY campaign_name) AS campaigns FROM m GROUP BY 1", campaign=_PART)
def ag_40(spark, sf_dir):
    own = I.members(campaign_rows(spark, sf_dir, _PART), "product_category", "campaign_name")
    return own.select("entity", F.size("campaigns").alias("n"), F.array_join("campaigns", ",").alias("campaigns"))


@R.add("jn_12", ", c AS (SELECT product_category AS entity, list(DISTINCT campaign_name) AS own FROM m GROUP BY 1), r AS (SELECT region AS other, list(DISTINCT campaign_name) AS theirs FROM m GROUP BY 1) SELECT entity, other, CAST(len(own) AS INTEGER) AS n FROM c JOIN r ON len(list_filter(own, lambda x: NOT list_contains(theirs, x))) = 0 AND len(own) > 0", campaign=_PART)
def jn_12(spark, sf_dir):
    """Categories all of whose parts a region has."""
    df = campaign_rows(spark, sf_dir, _PART)
    of = lambda c: df.select(F.col(c).alias("id"), F.col("campaign_name").alias("member"))
    return contained(of("product_category"), of("region")).select(F.col("id").alias("entity"), "other", F.col("n").cast("int").alias("n"))


@add("prj_16", _FLAGS + _MERGED_SQL + " WHERE start <= DATE '1998-06-30' AND end_date >= DATE '1998-01-01' AND entity IN (SELECT channel FROM pm WHERE campaign_name = 'always on')", ("start", "end_date"))
def prj_16(spark, sf_dir):
    own = I.members(_planted(spark, sf_dir), "channel", "campaign_name")
    view = I.in_view(_merged(spark, sf_dir).join(own, "entity"), "1998-01-01", "1998-06-30", ["always on"])
    return rounded(view.select("entity", "metric", "sign", "start", F.col("end").alias("end_date"), F.abs("score").alias("peak"), "pct"))


@add("inc_07", _FLAGS + f", tr AS (SELECT DISTINCT channel AS entity, CAST(date_trunc('week', date) AS DATE) AS start FROM m WHERE {_HIT}) SELECT entity, start, EXISTS (SELECT 1 FROM mp WHERE mp.entity = tr.entity AND mp.start <= tr.start + 6 AND mp.end_date >= tr.start) AS matched FROM tr", ("start",))
def inc_07(spark, sf_dir):
    hit = F.floor(F.datediff("date", F.lit("1995-01-02").cast("date")) / 7) % 13 == F.substring("channel", 1, 1).cast("int") * 2
    truth = rows(spark, sf_dir).where(hit).select(F.col("channel").alias("entity"), F.to_date(F.date_trunc("week", "date")).alias("start")).distinct()
    matched = I.match_planted(truth.withColumn("end", F.date_add("start", 6)), _merged(spark, sf_dir))
    return rounded(matched.select("entity", "start", "matched"))


@R.add("inc_04", "SELECT o_orderkey AS incident, 'cpl' AS metric, CASE WHEN o_orderkey % 3 = 0 THEN 'check' ELSE 'positive' END AS sentiment FROM orders UNION ALL SELECT o_orderkey, 'revenue', CASE WHEN o_orderkey % 3 = 0 THEN 'negative' ELSE 'positive' END FROM orders", m=False)
def inc_04(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("incident"), (F.col("o_orderkey") % 3 == 0).alias("bad"))
    cost = o.select("incident", F.lit("cpl").alias("metric"), F.lit(-40.0).alias("pct"), F.lit("positive").alias("sentiment"))
    result = o.select("incident", F.lit("revenue").alias("metric"), F.when(F.col("bad"), -60.0).otherwise(60.0).alias("pct"), F.when(F.col("bad"), "negative").otherwise("positive").alias("sentiment"))
    return I.fix_contradictions(cost.unionByName(result), ("incident",)).select("incident", "metric", "sentiment")


QUERIES, ORACLE_SQL = R.queries, R.sql
