"""Cleaning, profiling, mapping and checks over a messy export made from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import cleaning as CL
from tallyspark.operators import labels as LB
from tallyspark.operators import mapping as MP
from tallyspark.operators import profile as PR

from tallyspark.functions.kpi import presence

from .build import PRESENT, Registry, rounded
from .canonical import campaign_rows
from .messy import COLUMNS, KEPT_SQL, MAPPING, REPEAT, TOTAL, messy

R = Registry()


def add(name, sql=None, **more):
    return R.add(name, sql, m=False, **more)


def _clean(spark, sf_dir):
    return CL.clean(messy(spark, sf_dir), MAPPING)


_CLEAN_COLUMNS = """ SELECT r * 2 AS source_row, CASE WHEN k IN (16, 17) THEN NULL ELSE CAST(day AS VARCHAR) END AS date, 'Campaign ' || (o_custkey % 25) AS campaign_name, CASE WHEN k = 8 THEN NULL ELSE o_orderpriority END AS channel,
    CASE WHEN k IN (4, 5, 6) THEN NULL ELSE cost END AS spend, CAST(CASE WHEN k = 7 THEN clicks - 1 ELSE clicks * 10 END AS DOUBLE) AS impressions, CAST(CASE WHEN k = 7 THEN NULL ELSE clicks END AS DOUBLE) AS clicks, CAST(r % 7 AS DOUBLE) AS leads FROM o"""
for _name in ("cln_04", "prj_04"):

    @add(_name, KEPT_SQL + _CLEAN_COLUMNS)
    def _cleaned(spark, sf_dir):
        return _clean(spark, sf_dir)[0].select("source_row", F.col("date").cast("string").alias("date"), "campaign_name", "channel", "spend", "impressions", "clicks", "leads")


@add("cln_05", KEPT_SQL + """ SELECT o_orderpriority AS channel, 'Campaign ' || (o_custkey % 25) AS campaign_name, count(*) AS n FROM o WHERE k <> 8 GROUP BY 1, 2 UNION ALL SELECT NULL, 'Campaign ' || (o_custkey % 25), count(*) FROM o WHERE k = 8 GROUP BY 2""")
def cln_05(spark, sf_dir):
    """Texts standardised, before any date or number is read."""
    raw = CL.remove_summary_rows(messy(spark, sf_dir), COLUMNS)[0]
    df, _ = CL.select_and_rename(raw.join(CL.repeated_rows(raw, COLUMNS), "source_row", "left_anti"), {"campaign_name": "Campaign", "channel": "Channel"})
    changes, _ = CL.survey(df, ["campaign_name", "channel"])
    return CL.standardize(df, changes).groupBy("channel", "campaign_name").agg(F.count(F.lit(1)).alias("n"))


@add("prj_01", "SELECT 'Notes' AS column_name, 'column_dropped' AS action, (SELECT count(*) FROM orders WHERE o_orderkey % " + str(TOTAL) + " <> 0) AS rows UNION ALL SELECT 'Leads', 'column_dropped', (SELECT count(*) FROM orders WHERE o_orderkey % " + str(TOTAL) + " <> 0)")
def prj_01(spark, sf_dir):
    """Columns that no field claims are left out, and logged."""
    table, log = CL.clean(messy(spark, sf_dir), {f: c for f, c in MAPPING.items() if f != "leads"})
    assert not {"Notes", "Leads", "leads"} & set(table.columns)
    rows = table.agg(F.count(F.lit(1)).alias("rows"))
    return log.where("action = 'column_dropped'").select(F.col("column").alias("column_name"), "action").join(rows)  # one row


@add("cln_02", f"SELECT o_orderkey * 2 AS source_row, 'summary_row_removed' AS action FROM orders WHERE o_orderkey % {TOTAL} = 0 UNION ALL SELECT o_orderkey * 2 + 1, 'summary_row_removed' FROM orders WHERE o_orderkey % {TOTAL} = 0 AND o_orderkey % {REPEAT} = 0")
def cln_02(spark, sf_dir):
    return _clean(spark, sf_dir)[1].where("action = 'summary_row_removed'").select("source_row", "action")


for _name in ("cln_03", "wn_14"):

    @add(_name, f"SELECT o_orderkey * 2 + 1 AS source_row, o_orderkey * 2 AS first_row FROM orders WHERE o_orderkey % {REPEAT} = 0 AND o_orderkey % {TOTAL} <> 0")
    def _repeats(spark, sf_dir):
        rows, _ = CL.remove_summary_rows(messy(spark, sf_dir), COLUMNS)
        return CL.repeated_rows(rows, COLUMNS)


@add("cln_06", KEPT_SQL + """ SELECT r * 2 AS source_row, 'date_standardized' AS action FROM o WHERE k BETWEEN 10 AND 15 UNION ALL SELECT r * 2, 'unreadable_value' FROM o WHERE k = 17 UNION ALL SELECT r * 2, 'missing_value' FROM o WHERE k = 16
    UNION ALL SELECT r * 2, 'ambiguous_date' FROM o WHERE k BETWEEN 10 AND 12 AND day(day) <= 12 AND day(day) <> month(day)""")
def cln_06(spark, sf_dir):
    return _clean(spark, sf_dir)[1].where(F.col("column") == "date").select("source_row", "action")


@add("cln_07", KEPT_SQL + " SELECT r * 2 AS source_row, CASE k WHEN 3 THEN 'text_to_number' WHEN 5 THEN 'missing_value' WHEN 6 THEN 'unreadable_value' END AS action FROM o WHERE k IN (3, 5, 6)")
def cln_07(spark, sf_dir):
    return _clean(spark, sf_dir)[1].where((F.col("column") == "spend") & F.col("action").isin("text_to_number", "missing_value", "unreadable_value")).select("source_row", "action")


@add("cln_08", KEPT_SQL + " SELECT r * 2 AS source_row, 'negative_spend' AS flag FROM o WHERE k = 4")
def cln_08(spark, sf_dir):
    return _clean(spark, sf_dir)[0].where(F.array_contains("dq_flags", "negative_spend")).select("source_row", F.lit("negative_spend").alias("flag"))


@add("cln_09", KEPT_SQL + " SELECT r * 2 AS source_row, 'clicks_gt_impressions' AS flag FROM o WHERE k = 7")
def cln_09(spark, sf_dir):
    return _clean(spark, sf_dir)[0].where(F.array_contains("dq_flags", "clicks_gt_impressions")).select("source_row", F.lit("clicks_gt_impressions").alias("flag"))


_OUTLIERS = """WITH o AS (SELECT o_orderkey AS source_row, o_orderpriority AS channel, round(o_totalprice, 2) * CASE WHEN o_orderkey % 101 = 0 THEN 60.0e0 ELSE 1 END AS spend, CAST(o_orderkey % 7 + 3 AS DOUBLE) AS leads FROM orders),
    v AS (SELECT source_row, channel, 'spend' AS of, spend AS v FROM o UNION ALL SELECT source_row, channel, 'cpl', spend / leads FROM o WHERE leads >= 5),
    q AS (SELECT channel, of, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1, 2)
    SELECT source_row, of AS column_name, round(v, 2) AS value FROM v JOIN q USING (channel, of) WHERE n >= 20 AND q3 > q1 AND (v > q3 + 3 * (q3 - q1) OR v < q1 - 3 * (q3 - q1))"""


@add("cln_10", _OUTLIERS)
def cln_10(spark, sf_dir):
    """Values 60 times too high in every 101st row, and whatever else lies outside its channel's limits."""
    k = F.col("o_orderkey")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("source_row"), F.col("o_orderpriority").alias("channel"), (F.round("o_totalprice", 2) * F.when(k % 101 == 0, 60.0).otherwise(1.0)).alias("spend"), (k % 7 + 3).cast("double").alias("leads")
    )
    log = CL.flag_outliers(df).select("source_row", F.explode(F.flatten(F.array("_log_0", "_log_1"))).alias("e"))
    return log.select("source_row", F.col("e.column").alias("column_name"), F.col("e.original").cast("double").alias("value"))


@add("cln_11", KEPT_SQL + """ SELECT r * 2 AS source_row, 'channel' AS column_name, ' ' || lower(o_orderpriority) || ' ' AS original, o_orderpriority AS cleaned, 'label_standardized' AS action FROM o WHERE k = 1
    UNION ALL SELECT r * 2, 'channel', o_orderpriority || 'T', o_orderpriority, 'label_standardized' FROM o WHERE k = 2 UNION ALL SELECT r * 2, 'channel', o_orderpriority || '  ', o_orderpriority, 'whitespace_trimmed' FROM o WHERE k = 9""")
def cln_11(spark, sf_dir):
    log = _clean(spark, sf_dir)[1].where((F.col("column") == "channel") & F.col("action").isin("label_standardized", "whitespace_trimmed"))
    return log.select("source_row", F.col("column").alias("column_name"), "original", "cleaned", "action")


_COUNTS = KEPT_SQL + f""", a AS (SELECT 'date_standardized' AS action, 'date' AS column_name FROM o WHERE k BETWEEN 10 AND 15 UNION ALL SELECT 'missing_value', 'date' FROM o WHERE k = 16 UNION ALL SELECT 'unreadable_value', 'date' FROM o WHERE k = 17
    UNION ALL SELECT 'ambiguous_date', 'date' FROM o WHERE k BETWEEN 10 AND 12 AND day(day) <= 12 AND day(day) <> month(day) UNION ALL SELECT 'missing_value', 'channel' FROM o WHERE k = 8 UNION ALL SELECT 'missing_value', 'spend' FROM o WHERE k = 5
    UNION ALL SELECT 'unreadable_value', 'spend' FROM o WHERE k = 6 UNION ALL SELECT 'text_to_number', 'spend' FROM o WHERE k = 3 UNION ALL SELECT 'invalid_value_removed', 'spend' FROM o WHERE k = 4 UNION ALL SELECT 'invalid_value_removed', 'clicks' FROM o WHERE k = 7)"""
for _name in ("cln_12", "ag_38"):

    @add(_name, _COUNTS + " SELECT action, column_name, count(*) AS n FROM a WHERE action IN ('missing_value', 'unreadable_value', 'invalid_value_removed', 'ambiguous_date') GROUP BY 1, 2")
    def _limits(spark, sf_dir):
        return CL.limitations(_clean(spark, sf_dir)[1]).withColumnRenamed("column", "column_name")


_EVERY = f""", b AS (SELECT action FROM a UNION ALL SELECT 'label_standardized' FROM o WHERE k IN (1, 2) UNION ALL SELECT 'whitespace_trimmed' FROM o WHERE k = 9 UNION ALL SELECT 'duplicate_removed' FROM o WHERE r % {REPEAT} = 0 UNION ALL SELECT 'column_dropped'
    UNION ALL SELECT 'summary_row_removed' FROM orders WHERE o_orderkey % {TOTAL} = 0 UNION ALL SELECT 'summary_row_removed' FROM orders WHERE o_orderkey % {TOTAL} = 0 AND o_orderkey % {REPEAT} = 0)"""


@add("ag_37", _COUNTS + _EVERY + " SELECT action, count(*) AS n FROM b GROUP BY 1")
def ag_37(spark, sf_dir):
    return CL.log_summary(_clean(spark, sf_dir)[1]).groupBy("action").agg(F.sum("n").alias("n"))


@add("cln_01", "SELECT 'confirm the mapping of spend first' AS error")
def cln_01(spark, sf_dir):
    try:
        CL.clean(messy(spark, sf_dir), MAPPING, unconfirmed={"spend", "region"})
        error = ""
    except ValueError as refused:
        error = str(refused)
    return spark.range(1).select(F.lit(error).alias("error"))


@add("prj_02", "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS spend, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders")
def prj_02(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = o.select("o_orderkey", F.col("o_totalprice").cast("string").alias("spend"), F.year("o_orderdate").cast("string").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return CL.enforce_types(text).withColumn("date", F.col("date").cast("string"))


@add("prj_03", "SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week_start, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def prj_03(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return CL.add_calendar(o).select("o_orderkey", F.col("week_start").cast("string").alias("week_start"), "month", "quarter", "year")


_ALL = f"(SELECT * FROM (SELECT o_orderkey AS r, o_orderkey % 20 AS k FROM orders) UNION ALL SELECT o_orderkey, o_orderkey % 20 FROM orders WHERE o_orderkey % {REPEAT} = 0)"
for _name in ("ag_35", "prf_02"):

    @add(_name, f"SELECT column_name, n AS rows, missing, type FROM (SELECT count(*) AS n, count(*) FILTER (k = 16) AS d, count(*) FILTER (k = 5) AS c, count(*) FILTER (k = 8 AND r % {TOTAL} <> 0) AS h FROM {_ALL}) t, LATERAL (VALUES ('Day', d, 'date'), ('Cost', c, 'number'), ('Channel', h, 'text'), ('Clicks', 0, 'number'), ('Notes', 0, 'text')) v(column_name, missing, type)")
    def _profiled(spark, sf_dir):
        return PR.profile(messy(spark, sf_dir), ["Day", "Cost", "Channel", "Clicks", "Notes"]).select(F.col("column").alias("column_name"), "rows", "missing", "type")


@add("prf_03", "SELECT 'ctr' AS column_name, true AS ratio_like UNION ALL SELECT 'clicks', false")
def prf_03(spark, sf_dir):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(((k % 90) / 7).cast("string"), F.lit("%")).alias("ctr"), (k % 5000).cast("string").alias("clicks"))
    return PR.profile(o, ["ctr", "clicks"]).select(F.col("column").alias("column_name"), "ratio_like")


@add("ag_36", "SELECT 'p_brand' AS column_name, CAST(rank AS INTEGER) AS rank, p_brand AS value, n FROM (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1) WHERE rank <= 5")
def ag_36(spark, sf_dir):
    return PR.top_values(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_brand"]).select(F.col("column").alias("column_name"), "rank", "value", "n")


@add("prf_01", f"SELECT 'summary_rows' AS finding, CAST(NULL AS VARCHAR) AS column_name, count(*) FILTER (r % {TOTAL} = 0) AS n FROM {_ALL} UNION ALL SELECT 'stray_spaces', 'Channel', count(*) FILTER (k IN (1, 9) AND r % {TOTAL} <> 0) FROM {_ALL} UNION ALL SELECT 'duplicate_rows', NULL, (SELECT count(*) FROM orders WHERE o_orderkey % {REPEAT} = 0)")
def prf_01(spark, sf_dir):
    return PR.findings(messy(spark, sf_dir), COLUMNS).withColumnRenamed("column", "column_name")


@add("prf_04", "SELECT DISTINCT lower(o_orderpriority) AS variant, o_orderpriority AS label FROM orders UNION SELECT DISTINCT o_orderpriority || 'T', o_orderpriority FROM orders")
def prf_04(spark, sf_dir):
    return CL.cluster_labels(CL.remove_summary_rows(messy(spark, sf_dir), COLUMNS)[0], "Channel", aliases={})


@add("prf_04_aliases", "SELECT * FROM (VALUES ('fb', 'Meta'), ('Facebook Ads', 'Meta'), ('adwords', 'Google Ads'), ('E-mail', 'Email'), ('podcast', 'Podcast'), ('Podcasst', 'Podcast')) v(variant, label) WHERE (SELECT count(*) FROM orders) > 0")
def prf_04_aliases(spark, sf_dir):
    """The channels of all orders under other names: known ones take their canonical spelling, others the most frequent."""
    r = F.col("o_orderkey") % 11
    names = F.when(r == 0, "fb").when(r == 1, "Facebook Ads").when(r == 2, "Meta").when(r == 3, "adwords").when(r == 4, "E-mail").when(r == 5, "podcast").when(r == 6, "Podcasst").when(r == 7, "Email").otherwise("Podcast")
    return CL.cluster_labels(spark.read.parquet(f"{sf_dir}/orders.parquet").select(names.alias("channel")), "channel")


_PAIRS = {("abcd", "abcd"): 100.0, ("abc", "abd"): 66.6667, ("kitten", "sitting"): 61.5385, ("", "a"): 0.0}


@add("fn_19", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {v}e0)" for (a, b), v in _PAIRS.items()) + ", ('ad spend', 'spend ad', 100.0e0)) v(a, b, ratio)")
def fn_19(spark, sf_dir):
    made = [(a, b, round(LB.indel_ratio(a, b), 4)) for a, b in _PAIRS] + [("ad spend", "spend ad", LB.token_sort_ratio("ad spend", "spend ad"))]
    return spark.createDataFrame(made, "a string, b string, ratio double")


@add("jn_14", "SELECT DISTINCT lower(o_orderpriority) AS a, lower(o_orderpriority) || 't' AS b FROM orders")
def jn_14(spark, sf_dir):
    """Close spellings with the same digits among all distinct labels."""
    keys = CL.remove_summary_rows(messy(spark, sf_dir), COLUMNS)[0].where("Channel != 'n/a'").groupBy(LB.label_key(F.col("Channel"), {}).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    pairs = LB.close_keys(keys.select(F.lit("Channel").alias("column"), "key", "n"))
    return pairs.select(F.least("small", "big").alias("a"), F.greatest("small", "big").alias("b"))


@add("prf_05", "SELECT 'negative' AS finding, 'spend' AS column_name, count(*) AS n FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'impossible_stage', 'clicks', count(*) FROM orders WHERE o_orderkey % 13 = 0")
def prf_05(spark, sf_dir):
    k = F.col("o_orderkey")
    typed = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(k % 11 == 0, -1.0).otherwise(1.0).alias("spend"), F.when(k % 13 == 0, 5.0).otherwise(1.0).alias("clicks"), F.lit(2.0).alias("impressions"))
    return PR.impossible(typed).withColumnRenamed("column", "column_name")


# Headers of exports and what becomes of them. Each is also written in other ways below.
_BASE = [
    ("day", "date", "date", "mapped"), ("reporting date", "date", "date", "mapped"), ("campaign", "text", "campaign_name", "mapped"), ("campaign id", "text", "campaign_id", "mapped"), ("medium", "text", "channel", "mapped"), ("publisher platform", "text", "platform", "mapped"),
    ("cost", "number", "spend", "mapped"), ("amount spent", "number", "spend", "mapped"), ("ad spend", "number", "spend", "mapped"), ("impressions", "number", "impressions", "mapped"), ("link clicks", "number", "clicks", "mapped"), ("people reached", "number", "reach", "mapped"),
    ("video views", "number", "views", "mapped"), ("enquiries", "number", "leads", "mapped"), ("marketing qualified leads", "number", "qualified_leads", "mapped"), ("purchases", "number", "conversions", "mapped"), ("new customers", "number", "customers", "mapped"),
    ("net sales", "number", "revenue", "mapped"), ("conversion value", "number", "revenue", "mapped"), ("gross profit", "number", "gross_profit", "mapped"), ("gross margin", "number", "margin", "mapped"), ("planned spend", "number", "budget", "mapped"),
    ("city tier", "text", "city_tier", "mapped"), ("audience segment", "text", "customer_segment", "mapped"), ("product name", "text", "product", "mapped"), ("sku", "text", "sku", "mapped"), ("age range", "text", "age", "mapped"), ("zone", "text", "region", "mapped"),
    ("total cost", "number", None, "not_used"), ("cost of goods sold", "number", None, "not_used"), ("shipping cost", "number", None, "not_used"), ("ad set name", "text", None, "not_used"), ("search term", "text", None, "not_used"), ("device", "text", None, "not_used"),
    ("marketing cost", "number", None, "suggested"), ("profit", "number", None, "suggested"), ("net profit", "number", None, "suggested"), ("sales", "number", None, "suggested"), ("sign ups", "number", None, "suggested"), ("results", "number", None, "suggested"), ("key events", "number", None, "suggested"),
    ("amount", "number", None, "suggested"), ("cost per lead", "number", None, "derived"), ("average cpc", "number", None, "derived"), ("conversion rate", "number", None, "derived"), ("purchase roas", "number", None, "derived"), ("impression share", "number", None, "derived"), ("frequency", "number", None, "derived"),
    ("zork", "text", None, "unmapped"), ("internal remark b", "text", None, "unmapped"),
]
_WAYS = {"plain": "{}", "upper": "{}", "title": "{}", "snake": "{}", "units": "{} (INR)", "dots": "{}", "blanks": "  {}  ", "star": "{} *"}
_WRITTEN = {"upper": str.upper, "title": str.title, "snake": lambda h: h.replace(" ", "_"), "dots": lambda h: h.replace(" ", ".")}
_WAYS_SQL = {"plain": "h", "upper": "upper(h)", "title": "array_to_string(list_transform(string_split(h, ' '), lambda w: upper(w[1]) || w[2:]), ' ')", "snake": "replace(h, ' ', '_')", "units": "h || ' (INR)'", "dots": "replace(h, ' ', '.')", "blanks": "'  ' || h || '  '", "star": "h || ' *'"}
_BASE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{k}', {repr(f) if f else 'NULL'}, '{s}')" for h, k, f, s in _BASE) + ") b(h, kind, field, status)"
_HEADERS_SQL = f"WITH b AS ({_BASE_SQL}) " + " UNION ALL ".join(f"SELECT {sql} AS header, '{way}' AS way, kind, field, status FROM b" for way, sql in _WAYS_SQL.items())


def _headers() -> list[tuple[str, str, str]]:
    """(header, way, kind): each header alone in a file of its own."""
    return [(_WAYS[way].format(_WRITTEN.get(way, str)(h)), way, kind) for way in _WAYS for h, kind, _, _ in _BASE]


@add("map_01", f"SELECT header, field FROM ({_HEADERS_SQL})")
def map_01(spark, sf_dir):
    return spark.createDataFrame([(h, MP.map_fields([h], {h: kind})[h].field) for h, _, kind in _headers()], "header string, field string")


@add("map_02", f"SELECT header, status FROM ({_HEADERS_SQL})")
def map_02(spark, sf_dir):
    return spark.createDataFrame([(h, MP.propose(h, kind).status) for h, _, kind in _headers()], "header string, status string")


# A header that is nearly known is taken only if its values fit the field.
@add("map_03", "SELECT h AS header, k AS kind, CASE WHEN (h = 'Revenu' AND k IN ('number', 'money', 'mixed', 'empty')) THEN 'revenue' WHEN h = 'Platformm' AND k IN ('text', 'mixed', 'number', 'date', 'empty') THEN 'platform' WHEN h = 'Reporting dat' AND k IN ('date', 'mixed', 'empty') THEN 'date' END AS field FROM (VALUES ('Revenu'), ('Platformm'), ('Reporting dat')) v(h), (VALUES ('number'), ('money'), ('text'), ('date'), ('mixed'), ('empty')) w(k)")
def map_03(spark, sf_dir):
    made = [(h, k, MP.propose(h, k).field) for h in ("Revenu", "Platformm", "Reporting dat") for k in ("number", "money", "text", "date", "mixed", "empty")]
    return spark.createDataFrame(made, "header string, kind string, field string")


# 88 and more is taken, 75 and more is asked: n letters with one missing have a ratio of 100 (2n - 2) / (2n - 1).
@add("map_06", "SELECT h AS header, CASE WHEN score >= 88 THEN 'mapped' WHEN score >= 75 THEN 'suggested' ELSE 'unmapped' END AS status FROM (VALUES ('spen', 200.0 * 4 / 9), ('bdget', 200.0 * 5 / 11), ('rach', 200.0 * 4 / 9), ('clks', 100.0), ('ledz', 200.0 * 3 / 9), ('budgt plan', 200.0 * 5 / 16), ('reachd', 200.0 * 5 / 11), ('spd', 200.0 * 3 / 8)) v(h, score)")
def map_06(spark, sf_dir):
    return spark.createDataFrame([(h, MP.propose(h, "number").status) for h in ("spen", "bdget", "rach", "clks", "ledz", "budgt plan", "reachd", "spd")], "header string, status string")


# Columns that claim one field in the same file: the earlier word of the list, the user's choice, or nobody.
_TOGETHER = [("Gross revenue", None), ("Net revenue", "revenue"), ("Spend", "spend"), ("Marketing cost", None), ("Orders", "conversions"), ("Day", "date"), ("Total cost", None), ("Link clicks", None), ("Clicks", "clicks"), ("Impr.", "impressions"), ("CTR", None)]


@add("jn_13", "SELECT * FROM (VALUES " + ", ".join(f"('{h}', {repr(f) if f else 'NULL'})" for h, f in _TOGETHER) + ") v(header, field)")
def jn_13(spark, sf_dir):
    kinds = {r["column"]: r["type"] for r in PR.profile(messy(spark, sf_dir), COLUMNS).collect()}  # one row a column
    kinds |= {h: "number" for h, _ in _TOGETHER if h not in kinds}
    found = MP.map_fields([h for h, _ in _TOGETHER], kinds)
    return spark.createDataFrame([(h, m.field) for h, m in found.items()], "header string, field string")


@add("map_04", "SELECT 'channel' AS email, 'gender' AS gender, CAST(NULL AS VARCHAR) AS other")
def map_04(spark, sf_dir):
    got = [MP.vocabulary_field(v) for v in (["Email", "Paid Search", "Display", "SEO", "Radio"], ["F", "M", "Unknown"], ["ASIA", "EUROPE"])]
    return spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in zip(("email", "gender", "other"), got, strict=True)))


@add("map_05", """WITH o AS (SELECT o_orderkey % 7 AS file, CASE o_orderkey % 7 WHEN 0 THEN 'Lead generation' WHEN 1 THEN 'OUTCOME_SALES' WHEN 2 THEN 'Conversions' WHEN 3 THEN 'Traffic' WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Leads' ELSE 'Sales' END
    WHEN 5 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'onsite_conversion.lead_grouped' END ELSE 'offsite_conversion.view' END AS objective FROM orders)
    SELECT file, CASE WHEN bool_and(objective IN ('Lead generation', 'onsite_conversion.lead_grouped', '')) THEN 'leads' WHEN bool_and(objective IN ('OUTCOME_SALES', 'Conversions')) THEN 'conversions' END AS meaning FROM o GROUP BY file""")
def map_05(spark, sf_dir):
    file, even = F.col("o_orderkey") % 7, F.col("o_orderkey") % 2 == 0
    objective = (
        F.when(file == 0, "Lead generation").when(file == 1, "OUTCOME_SALES").when(file == 2, "Conversions").when(file == 3, "Traffic")
        .when(file == 4, F.when(even, "Leads").otherwise("Sales")).when(file == 5, F.when(even, "").otherwise("onsite_conversion.lead_grouped")).otherwise("offsite_conversion.view")
    )
    return MP.results_meaning(spark.read.parquet(f"{sf_dir}/orders.parquet").select(file.alias("file"), objective.alias("objective")), "objective", ["file"])


def _own_ratios(spark, sf_dir):
    df = campaign_rows(spark, sf_dir)
    return df.withColumns({"own_cpc": F.round(F.try_divide("spend", "clicks"), 2), "own_cpa": F.round(F.try_divide("spend", "leads"), 2), "own_roas": F.lit(3.0), "own_ctr": F.try_divide("clicks", "impressions")})


_XCK = "SELECT * FROM (VALUES ('CPC', 'own_cpc', 'verified'), ('ROAS', 'own_roas', 'mismatch'), ('CTR', 'own_ctr', 'verified')) v(check_name, column_name, status)"
for _name in ("xck_01", "jn_15"):

    @add(_name, _XCK)
    def _checked(spark, sf_dir):
        found = PR.cross_check(_own_ratios(spark, sf_dir), {"CPC": "own_cpc", "ROAS": "own_roas", "CTR": "own_ctr"})
        return found.select(F.col("check").alias("check_name"), F.col("column").alias("column_name"), "status")


_NEAR = "avg(CASE WHEN abs(own - calc) <= greatest(abs(own) * 0.02, 0.011) THEN 1.0e0 ELSE 0 END)"


@add("xck_03", f"""WITH o AS (SELECT round(o_totalprice, 2) AS web, o_orderkey % 50 + 10 AS clicks, round(o_totalprice / 7, 2) AS cost, o_orderkey % 9 + 1 AS store, o_orderkey % 3 = 0 AS third FROM orders),
    t AS (SELECT 'CPC' AS check_name, 'Cost / Clicks x 1' AS definition, 'verified' AS status, round(cost / clicks, 2) AS own, cost / clicks AS calc FROM o UNION ALL SELECT 'ROAS', 'Web sales / Cost x 1', 'alternative', round(web / cost, 2), web / cost FROM o
    UNION ALL SELECT 'AOV', 'Web sales / Store transactions x 1', 'alternative', round(web / store, 2), web / store FROM o UNION ALL SELECT 'CPL', 'Cost / Leads x 1', 'mismatch', CASE WHEN third THEN round(cost / 4, 2) ELSE 1 END, cost / 4 FROM o)
    SELECT check_name, definition, status, round({_NEAR}, 4) AS share, count(*) AS rows FROM t GROUP BY 1, 2, 3""")
def xck_03(spark, sf_dir):
    """Web sales and Store transactions are mapped to no field, but the file's own ratios rest on them."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    text = lambda c: F.format_string("%.2f", c.cast("double"))
    web, clicks, cost, store = F.round(price, 2), k % 50 + 10, F.round(price / 7, 2), k % 9 + 1
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        text(cost).alias("Cost"), clicks.cast("string").alias("Clicks"), text(web).alias("Web sales"), store.cast("string").alias("Store transactions"), F.lit("4").alias("Leads"),
        text(F.round(cost / clicks, 2)).alias("CPC"), text(F.round(web / cost, 2)).alias("ROAS"), text(F.round(web / store, 2)).alias("AOV"), F.when(k % 3 == 0, text(F.round(cost / 4, 2))).otherwise("1").alias("CPL"),
    )
    found = PR.cross_check_file(raw, {"CPC": "CPC", "ROAS": "ROAS", "AOV": "AOV", "CPL": "CPL"}, {"spend": "Cost", "clicks": "Clicks", "leads": "Leads"})
    return rounded(found.select(F.col("check").alias("check_name"), "definition", "status", "share", "rows"))


@R.add("xck_02", "SELECT round(avg(CASE WHEN abs(3.0 - revenue / nullif(spend, 0)) <= greatest(0.06, 0.011) THEN 1.0 ELSE 0.0 END) FILTER (revenue / nullif(spend, 0) IS NOT NULL), 4) AS share FROM m")
def xck_02(spark, sf_dir):
    share, _ = PR.match_share(F.lit(3.0), F.try_divide("revenue", "spend"))
    return rounded(campaign_rows(spark, sf_dir).agg(share.alias("share")))


@add("prj_18", "SELECT least(500, count(*)) AS n, count(*) > 0 AS some FROM orders")
def prj_18(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("source_row"))
    return PR.sample_rows(o).agg(F.count_distinct("source_row").alias("n"), (F.count("source_row") > 0).alias("some"))


@R.add("ag_39", "SELECT CASE WHEN sum(revenue) / sum(spend) > 50 THEN 'roas_high' END AS check_name, round(sum(revenue) / sum(spend), 4) AS value FROM (SELECT revenue * 20 AS revenue, spend FROM m) UNION ALL SELECT 'organic_spend', round(sum(spend), 4) FROM m WHERE channel = '1-URGENT'")
def ag_39(spark, sf_dir):
    df = campaign_rows(spark, sf_dir).withColumn("revenue", F.col("revenue") * 20).withColumn("channel", F.when(F.col("channel") == "1-URGENT", "Organic Social").otherwise(F.col("channel")))
    return rounded(PR.plausibility(df).select(F.col("check").alias("check_name"), "value"))


#: Which fields a file lacks, in four variants.
_LACKING = {"all": [], "no revenue": ["revenue", "gross_profit"], "no spend": ["spend", "region"], "no dates": ["date", "leads"]}


def _capable(variant: str) -> str:
    gone = ", ".join(f"NULL AS {c}" for c in _LACKING[variant])
    known = lambda c: f"count({c}) > 0" if c in PRESENT else "false"
    caps = {k: " OR ".join("(" + " AND ".join(known(c) for c in sorted(own)) + ")" for own in sets) for k, sets in PR.CAPABILITIES.items()}
    caps["funnel"] = " + ".join(f"CAST({known(c)} AS INTEGER)" for c in PR._FUNNEL) + " >= 2"
    return f"SELECT '{variant}' AS variant, capability, enabled FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in caps.items()) + f" FROM (SELECT *{f' REPLACE ({gone})' if gone else ''} FROM m)) UNPIVOT (enabled FOR capability IN (COLUMNS(*)))"


@R.add("val_01", " UNION ALL ".join(_capable(v) for v in _LACKING))
def val_01(spark, sf_dir):
    """What files that lack some fields allow, from what their rows hold."""
    df, out = campaign_rows(spark, sf_dir), None
    for variant, gone in _LACKING.items():
        present = presence(df.withColumns({c: F.lit(None).cast(dict(df.dtypes)[c]) for c in gone}) if gone else df)
        one = spark.createDataFrame([(variant, k, v) for k, v in PR.capabilities(present).items()], "variant string, capability string, enabled boolean")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES, ORACLE_SQL = R.queries, R.sql
