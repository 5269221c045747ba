"""Scalar functions over the driver's tables.

Parsers are held against a round trip: Spark writes known values as text in many formats and reads
them back; the SQL has the values themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import response as RC
from tallyspark.operators.common import direction
from tallyspark.operators.pacing import pacing_status
from tallyspark.operators.profit import profit_status
from tallyspark.operators.targets import gap_pct, target_status

from .build import Registry, rounded

R = Registry()


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name, sql, **more):
    return R.add(name, sql, m=False, **more)


for _name in ("fn_01", "fn_02"):

    @add(_name, "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0) * 100, 4) AS ratio FROM lineitem")
    def _divide(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem")
        return rounded(df.select("l_orderkey", "l_linenumber", (F.try_divide("l_extendedprice", "l_discount") * 100).alias("ratio")))


@add("fn_04", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Not available' WHEN abs((90 + o_orderkey % 21) / 100.0 - 1) <= 0.05 + 1e-9 THEN 'On pace' WHEN (90 + o_orderkey % 21) / 100.0 > 1 THEN 'Overspending' ELSE 'Underspending' END AS status FROM orders")
def fn_04(spark, sf_dir):
    ratio = F.when(F.col("o_orderkey") % 11 != 0, (90 + F.col("o_orderkey") % 21) / 100.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", pacing_status(ratio).alias("status"))


@add("fn_05", """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'Not available' WHEN o_orderkey % 17 = 0 THEN 'Off target'
    WHEN o_orderkey % 2 = 0 THEN CASE WHEN abs(g) <= 5 THEN 'On target' WHEN abs(g) <= 10 THEN 'Within 10%' WHEN g > 0 THEN 'Over' ELSE 'Under' END
    ELSE CASE WHEN g <= 0 THEN 'On target' WHEN g <= 10 THEN 'Within 10%' ELSE 'Off target' END END AS status
    FROM (SELECT o_orderkey, o_orderkey % 31 - 15 AS g FROM orders)""")
def fn_05(spark, sf_dir):
    gap = F.col("o_orderkey") % 31 - 15
    target = F.when(F.col("o_orderkey") % 13 != 0, F.when(F.col("o_orderkey") % 17 == 0, 0.0).otherwise(200.0))
    spend = (F.col("o_orderkey") % 2 == 0) & (F.coalesce(target, F.lit(1.0)) != 0)
    kpi, better = F.when(spend, "spend").otherwise("cpl"), F.when(spend, "none").otherwise("down")
    return table(spark, sf_dir, "orders").select("o_orderkey", target_status(kpi, better, 200.0 + gap * 2.0 + F.when(target == 0, 100).otherwise(0), target).alias("status"))


@add("fn_06", "SELECT c_custkey, round((c_acctbal - (c_custkey % 5 - 2)) / nullif(abs(c_custkey % 5 - 2), 0) * 100, 4) AS gap_pct FROM customer")
def fn_06(spark, sf_dir):
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", gap_pct(F.col("c_acctbal"), (F.col("c_custkey") % 5 - 2).cast("double")).alias("gap_pct")))


@add("fn_07", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_discount <= 0.05 THEN 'flat' WHEN l_linenumber % 2 = 0 THEN 'up' ELSE 'down' END AS way FROM lineitem")
def fn_07(spark, sf_dir):
    change = F.when(F.col("l_linenumber") != 7, F.col("l_discount") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", direction(change).alias("way"))


@add("fn_08", "SELECT o_orderkey, CASE WHEN c >= 0 OR abs(c) <= 5 THEN 'good' WHEN abs(c) <= 15 THEN 'watch' ELSE 'bad' END AS colour FROM (SELECT o_orderkey, o_orderkey % 61 - 30 AS c FROM orders)")
def fn_08(spark, sf_dir):
    from tallyspark.operators.findings import trend_colour

    return table(spark, sf_dir, "orders").select("o_orderkey", trend_colour((F.col("o_orderkey") % 61 - 30).cast("double"), F.lit("up")).alias("colour"))


@add("fn_09", "SELECT p_partkey, CASE WHEN r2 >= 0.5 AND w >= 30 THEN 'High' WHEN r2 >= 0.25 AND w >= 20 THEN 'Medium' ELSE 'Low' END AS confidence FROM (SELECT p_partkey, (p_partkey % 100) / 100.0 AS r2, p_size AS w FROM part)")
def fn_09(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", RC.confidence((F.col("p_partkey") % 100) / 100.0, F.col("p_size")).alias("confidence"))


@add("fn_10", "SELECT p_partkey, round(p_retailprice / pow(p_size, 0.6), 4) AS a, round(p_retailprice / pow(p_size, 0.6) * pow(p_size * 1.1e0, 0.6), 4) AS conversions, round(1 / (p_retailprice / pow(p_size, 0.6) * 0.6 * pow(p_size, -0.4)), 8) AS marginal FROM part")
def fn_10(spark, sf_dir):
    a = RC.scale(F.col("p_retailprice"), F.col("p_size"), F.lit(0.6))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(a, 4).alias("a"), F.round(RC.conversions(a, F.lit(0.6), F.col("p_size") * 1.1), 4).alias("conversions"), F.round(RC.marginal_cost(a, F.lit(0.6), F.col("p_size").cast("double")), 8).alias("marginal"))


@add("fn_11", "SELECT l_orderkey, l_linenumber, round(sign(l_discount - 0.05) * least(abs(l_discount - 0.05), abs(2 * (sqrt(l_quantity) - sqrt(l_quantity * 0.9e0)))), 6) AS score FROM lineitem")
def fn_11(spark, sf_dir):
    from tallyspark.functions.anomaly import both_least

    d = F.col("l_discount") - 0.05
    z = 2 * (F.sqrt("l_quantity") - F.sqrt(F.col("l_quantity") * 0.9))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.round(F.signum(d) * both_least(F.abs(d), F.abs(z)), 6) + F.lit(0.0)).alias("score"))


# texts to numbers and dates

_N = "CAST(round(o_totalprice * 100) AS BIGINT)"


@add("fn_13", f"""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 4 THEN -v WHEN 3 THEN floor(v) ELSE v END AS value, o_orderkey % 10 IN (1, 2, 3, 5, 6) OR (o_orderkey % 10 = 4 AND v >= 1000) AS formatted
    FROM (SELECT o_orderkey, {_N} / 100.0e0 AS v FROM orders)""")
def fn_13(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    v, k = cents / 100.0, F.col("o_orderkey") % 10
    western = F.format_number(v, 2)
    two = F.format_string("%.2f", v)
    text = (
        F.when(k == 1, F.concat(F.lit("₹"), western)).when(k == 2, F.concat(F.lit("INR "), two)).when(k == 3, F.concat(F.lit(" Rs. "), X.indian(F.floor(v)), F.lit(" ")))
        .when(k == 4, F.concat(F.lit("("), western, F.lit(")"))).when(k == 5, F.translate(western, ",.", ".,")).when(k == 6, F.replace(two, F.lit("."), F.lit(",")))
        .when(k == 7, F.lit(" N/A ")).when(k == 8, F.lit("12d")).otherwise(F.concat(two, F.lit(" ")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", X.parse_number(text).alias("p")).select("o_orderkey", "p.value", "p.formatted")


# The names of date formats, and how each is written.
_WRITTEN = {
    "YYYY-MM-DD": "yyyy-M-d",
    "YYYY-MM-DD hh:mm:ss": "yyyy-M-d H:m:s",
    "DD/MM/YYYY": "d/M/yyyy",
    "DD-MM-YYYY": "d-M-yyyy",
    "DD.MM.YYYY": "d.M.yyyy",
    "D-Mon-YYYY": "d-MMM-yyyy",
    "D Mon YYYY": "d MMM yyyy",
    "D-Month-YYYY": "d-MMMM-yyyy",
    "D Month YYYY": "d MMMM yyyy",
    "Mon D, YYYY": "MMM d, yyyy",
    "Month D, YYYY": "MMMM d, yyyy",
    "YYYY/MM/DD": "yyyy/M/d",
    "MM/DD/YYYY (US)": "M/d/yyyy",
}
_LABELS = list(_WRITTEN)
_FORMAT_CASE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_LABELS))


@add("fn_14", f"""SELECT o_orderkey, CAST(CAST(d AS DATE) AS VARCHAR) AS value,
    CASE WHEN o_orderkey % 14 = 13 THEN NULL WHEN o_orderkey % 14 IN (7, 8, 10) AND month(d) = 5 THEN CASE o_orderkey % 14 WHEN 7 THEN 'D-Mon-YYYY' WHEN 8 THEN 'D Mon YYYY' ELSE 'Mon D, YYYY' END ELSE CASE o_orderkey % 14 {_FORMAT_CASE} END END AS format
    FROM (SELECT o_orderkey, CASE o_orderkey % 14 WHEN 13 THEN NULL WHEN 12 THEN date_trunc('month', o_orderdate) + INTERVAL 24 DAY ELSE o_orderdate END AS d FROM orders)""")
def fn_14(spark, sf_dir):
    k = F.col("o_orderkey") % 14
    d = F.when(k == 12, F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "month"), 24)).otherwise(F.col("o_orderdate").cast("date"))
    text = F.lit("someday")
    for i, name in enumerate(_LABELS):
        text = F.when(k == i, F.date_format(d, _WRITTEN[name])).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.parse_date(text).alias("p")).select("o_orderkey", F.col("p.value").cast("string").alias("value"), "p.format")


@add("fn_15", "SELECT o_orderkey, o_orderkey % 9 < 8 AS missing FROM orders")
def fn_15(spark, sf_dir):
    tokens = F.array(*(F.lit(f" {t.upper()} ") for t in X.MISSING), F.lit("0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.is_missing(F.get(tokens, (F.col("o_orderkey") % 9).cast("int"))).alias("missing"))


@add("fn_16", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) || ' percent' AS header FROM part")
def fn_16(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.header_key(F.concat(F.col("p_type"), F.lit(" (INR) _%"))).alias("header"))


@add("fn_17", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, lower(c_mktsegment) AS key FROM customer")
def fn_17(spark, sf_dir):
    from tallyspark.functions.kpi import label

    return table(spark, sf_dir, "customer").select("c_custkey", X.digits_of(F.col("c_name")).alias("digits"), label(F.concat(F.lit(" \t"), F.col("c_mktsegment"), F.lit("  "))).alias("key"))


@add("fn_18", "SELECT p_partkey, 'cost per click ' || CAST(p_size AS VARCHAR) AS words FROM part")
def fn_18(spark, sf_dir):
    split = F.lower(X.tidy(F.regexp_replace(F.concat(F.lit("CostPer_Click"), F.col("p_size").cast("string")), r"(?<=[a-z])(?=[A-Z])|_|(?<=[A-Za-z])(?=\d)", " ")))
    return table(spark, sf_dir, "part").select("p_partkey", split.alias("words"))


@add("fn_20", "SELECT o_orderkey, o_orderkey % 6 < 3 AS summary FROM orders")
def fn_20(spark, sf_dir):
    texts = F.array(*map(F.lit, ["Grand Total", " sub-total of x", "TOTAL: 5", "totally fine", "a total", "Search"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.is_summary(F.get(texts, (F.col("o_orderkey") % 6).cast("int"))).alias("summary"))


# Every white space of Unicode, the same class on both sides.
_BLANKS = "\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


@add("fn_21", f"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[{_BLANKS}]+', ' ', 'g')) AS tidy FROM documents")
def fn_21(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.tidy(F.coalesce("text", F.lit(""))).alias("tidy"))


@add("fn_21_whole", R.sql["fn_21"])
def fn_21_whole(spark, sf_dir):
    """fn_21, which reads every document in every language by now."""
    return table(spark, sf_dir, "documents").select("doc_id", X.tidy(F.coalesce("text", F.lit(""))).alias("tidy"))


_PAIR = "CASE WHEN {n} >= 10000000 THEN CAST({n} // 10000000 AS VARCHAR) || ',' || lpad(CAST({n} // 100000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({n} // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') WHEN {n} >= 100000 THEN CAST({n} // 100000 AS VARCHAR) || ',' || lpad(CAST({n} // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') WHEN {n} >= 1000 THEN CAST({n} // 1000 AS VARCHAR) || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


@add("fn_22", f"SELECT o_orderkey, {_PAIR.format(n='n')} AS grouped FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 97)) AS BIGINT) AS n FROM orders)")
def fn_22(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.indian(F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 97))).alias("grouped"))


@add("fn_23", f"""SELECT o_orderkey, CASE WHEN n >= 10000000 THEN '₹' || printf('%.1f', n / 1e7) || ' Cr' WHEN n >= 100000 THEN '₹' || printf('%.1f', n / 1e5) || ' L' ELSE '₹' || {_PAIR.format(n='n')} END AS money,
    printf('%.2fx', (o_orderkey % 1000) / 64.0e0) AS ratio, CASE WHEN p = 0 OR p >= 1 THEN printf('%.1f', p) WHEN p < 0.1 THEN printf('%.3f', p) ELSE printf('%.2f', p) END || '%' AS share
    FROM (SELECT o_orderkey, (o_orderkey % 97) * 12345 AS n, (o_orderkey % 200) / 64.0e0 AS p FROM orders)""")
def fn_23(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.rupees(((k % 97) * 12345).cast("double"), compact=True).alias("money"), X.ratio_text((k % 1000) / 64.0).alias("ratio"), X.percent_text((k % 200) / 64.0).alias("share"))


@add("fn_24", "SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS day, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 330 MINUTE, '%-d %b %Y, %H:%M') || ' IST' AS stamp FROM orders")
def fn_24(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.date_text(F.col("o_orderdate")).alias("day"), X.stamp_text(F.col("o_orderdate").cast("timestamp")).alias("stamp"))


@add("fn_25", "SELECT o_orderkey, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS month_end, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS monday, CAST(day(last_day(CAST(o_orderdate AS DATE))) AS INTEGER) AS days FROM orders")
def fn_25(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.last_day(d).cast("string").alias("month_end"), F.to_date(F.date_trunc("week", d)).cast("string").alias("monday"), F.day(F.last_day(d)).alias("days"))


@add("fn_26", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(replace(p_type, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def fn_26(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.title(F.concat(F.lit("  "), F.col("p_type"))).alias("title"))


@add("fn_27", "SELECT o_orderkey, (o_orderkey % 97) * 1000.0e0 AS money, (o_orderkey % 50) + 0.5e0 AS percent, (o_orderkey % 9) * 1e5 AS lakh FROM orders")
def fn_27(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Spend was "), X.rupees(((k % 97) * 1000).cast("double")), F.lit(" or "), F.format_string("%.1f", k % 50 + 0.5), F.lit("% of the plan, revenue ₹"), (k % 9).cast("string"), F.lit(" L."))
    n = X.numbers_in(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", n[0]["value"].alias("money"), n[1]["value"].alias("percent"), n[2]["value"].alias("lakh"))


@add("fn_28", "SELECT sha256('[\"' || array_to_string(list_sort(list(DISTINCT p_brand)), '\",\"') || '\"]') AS key FROM part")
def fn_28(spark, sf_dir):
    from tallyspark.sources.store import layout_key

    return table(spark, sf_dir, "part").agg(layout_key(F.collect_set("p_brand")).alias("key"))


@add("fn_29", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS details FROM events")
def fn_29(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("details"))


@add("fn_30", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ', ') AS labels FROM lineitem GROUP BY 1")
def fn_30(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ", ").alias("labels"))


QUERIES, ORACLE_SQL = R.queries, R.sql
