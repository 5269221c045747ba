"""Files in, result tables stored and read back, runs and housekeeping, and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import mapping as MP
from tallyspark.operators.group import group_kpis
from tallyspark.sources import files as FILES
from tallyspark.sources import generate as GEN
from tallyspark.sources import workbooks as WB
from tallyspark.sources.shared import new_folder
from tallyspark.sources.store import RunStore, melted
from tallyspark.streaming import windows as ST

from .build import PRESENT, Registry, measures_sql, rounded
from .canonical import campaign_rows

R = Registry()


def add(name, sql=None, **more):
    return R.add(name, sql, m=False, **more)


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# files


def _csv(spark: SparkSession, sf_dir: str, sep: str = ",", encoding: str = "UTF-8", above: str = "") -> str:
    """The customers as one delimited file in parts, as people export it: notes over two lines, an empty column, perhaps title rows."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    note = F.concat(F.lit('say "hi"' + sep + " é\n"), F.col("c_mktsegment"))
    head = above + "\n" * bool(above) + sep.join(f'"{c}"' for c in ("c_custkey", "c_name", "c_note", "c_acctbal", " "))
    line = F.concat_ws(sep, *(quoted(c) for c in (F.col("c_custkey"), F.col("c_name"), note, F.col("c_acctbal"), F.lit(""))))
    folder = new_folder(spark, "csv")
    lines = spark.range(1).select(F.lit(head).alias("value"), F.lit(-1).cast("long").alias("k")).unionByName(table(spark, sf_dir, "customer").select(line.alias("value"), F.col("c_custkey").alias("k")))
    lines.orderBy("k").select(F.encode("value", encoding).cast("string").alias("value")).write.mode("append").text(folder)
    return f"{folder}/*.txt"


_CUSTOMERS = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 'say \"hi\"{sep} é' || chr(10) || c_mktsegment AS c_note FROM customer"
_TITLE = "Customers of all nations\n\nas of today,"
for _name, _sep, _enc, _above in (("src_01", ",", "UTF-8", ""), ("src_03", ",", "ISO-8859-1", ""), ("src_04", ";", "UTF-8", ""), ("src_05", "\t", "UTF-8", ""), ("src_08", ",", "UTF-8", _TITLE), ("src_09", ";", "UTF-8", ""), ("src_10", "\t", "UTF-8", "")):

    @add(_name, _CUSTOMERS.format(sep=_sep))
    def _loaded(spark, sf_dir, sep=_sep, enc=_enc, above=_above):
        raw, _ = FILES.load_file(spark, _csv(spark, sf_dir, sep, enc, above), max_mb=None, in_parts=True)  # the limit is for uploads
        return raw.select("c_custkey", "c_name", "c_note")


_NOTES = {"Read me": [["c_custkey", "key of the customer"], [" "], ["c_acctbal", "balance", "may be negative"]], "More": [["x"]]}


def _workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as one workbook for each nation, with a sheet that describes the columns, read back."""
    folder = new_folder(spark, "workbooks")
    own = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 2 == 0).alias("even"))
    WB.write_workbooks(own, "c_nationkey", folder, "Customers", _NOTES).collect()  # a row a file
    WB.register(spark)
    return spark.read.format("workbooks").load(folder)


@add("src_06", "SELECT CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS even FROM customer")
def src_06(spark, sf_dir):
    """The fullest sheet of each workbook."""
    rows = _workbooks(spark, sf_dir)
    own = rows.join(WB.fullest_sheet(rows).select("file", "sheet"), ["file", "sheet"]).where("row > 1")
    c = F.col("cells")
    return own.select(F.regexp_extract("file", r"([^/]+)\.xlsx$", 1).alias("nation"), c[0].alias("c_custkey"), c[1].alias("c_name"), c[2].cast("double").alias("c_acctbal"), c[3].alias("even"))


@add("src_07", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS nation, 'c_custkey | key of the customer' || chr(10) || 'c_acctbal | balance | may be negative' AS text, 'Customers' AS sheet, 'Read me, More' AS others FROM customer")
def src_07(spark, sf_dir):
    rows = _workbooks(spark, sf_dir)
    chosen = WB.fullest_sheet(rows)
    found = WB.dictionary_texts(rows, chosen).join(chosen, "file")
    return found.select(F.regexp_extract("file", r"([^/]+)\.xlsx$", 1).alias("nation"), "text", "sheet", F.array_join("others", ", ").alias("others"))


for _name in ("src_02", "src_11"):

    @add(_name)
    def _content(spark, sf_dir):
        return FILES.content(spark, f"{sf_dir}/customer.parquet").select("length", "sha256")


@add("src_12", "SELECT event_type, field, count(*) AS n FROM events JOIN (VALUES ('click', 'clicks'), ('view', 'views'), ('purchase', 'conversions')) v(event_type, field) USING (event_type) GROUP BY 1, 2")
def src_12(spark, sf_dir):
    """Kinds of events whose names, as a header would have them, the dictionary knows."""
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    headers = events.withColumn("key", X.header_key(F.concat(F.initcap("event_type"), F.lit("s (INR)"))))
    return headers.join(FILES.knowledge(spark), "key").select("event_type", "field", "n")


@add("src_17", "SELECT 365 AS days, 17 AS campaigns, 31025 AS rows")
def src_17(spark, sf_dir):
    g = GEN.campaigns(spark)
    return g.agg(F.countDistinct("date").alias("days"), F.countDistinct("campaign_name").alias("campaigns"), F.count(F.lit(1)).alias("rows"))


@add("src_18", "SELECT * FROM (VALUES ('export', 31025, 7), ('messy', 31025 + 1, 10), ('without revenue', 31025, 15), ('without leads', 31025, 15), ('without region', 31025, 15), ('without clicks', 31025, 15)) v(variant, rows, columns) UNION ALL SELECT 'slice ' || c, n * 1825, 7 FROM (VALUES ('Paid Search', 2), ('Paid Social', 3), ('Display', 3), ('Video', 3), ('Affiliate', 3), ('Email', 3)) v(c, n)")
def src_18(spark, sf_dir):
    """Rows and columns of each variant; the messy copy without its repeated rows."""
    df = GEN.campaigns(spark)
    made = {"export": GEN.platform_export(df), "messy": GEN.messy_copy(df).distinct()}
    made |= {f"without {c}": v for c, v in GEN.dropped_column_copies(df).items()} | {f"slice {c}": v for c, v in GEN.channel_slices(df).items()}
    out = None
    for name, variant in made.items():
        one = variant.agg(F.count(F.lit(1)).cast("int").alias("rows")).select(F.lit(name).alias("variant"), "rows", F.lit(len(variant.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


# the run store


def _store(spark) -> RunStore:
    return RunStore(spark, new_folder(spark, "store"))


_RECORDS = "SELECT count(*) AS rows, round(sum(spend), 2) AS spend, min(date) AS first_day FROM m WHERE channel = '2-HIGH'"
for _name in ("src_13", "snk_01"):

    @R.add(_name, _RECORDS, dates=("first_day",))
    def _records(spark, sf_dir):
        store, df = _store(spark), campaign_rows(spark, sf_dir)
        store.save_records("a", df.where("channel = '1-URGENT'"))
        store.save_records("b", df.where("channel = '3-MEDIUM'"))
        store.save_records("b", df.where("channel = '2-HIGH'"))  # replaces
        return rounded(store.load_records("b", ["spend", "date"]).agg(F.count(F.lit(1)).alias("rows"), F.sum("spend").alias("spend"), F.min("date").alias("first_day")), 2)


_TIDY = "SELECT channel AS campaign, metric, round(value, 4) AS value FROM (SELECT channel, sum(spend) AS spend, sum(revenue) AS revenue FROM m GROUP BY 1) UNPIVOT (value FOR metric IN (spend, revenue))"
def _by_channel(spark, sf_dir) -> DataFrame:
    return group_kpis(campaign_rows(spark, sf_dir), "channel", PRESENT).select(F.col("channel").alias("campaign"), "spend", "revenue")


for _name in ("src_14", "snk_02"):

    @R.add(_name, _TIDY)
    def _analysis(spark, sf_dir):
        store, wide = _store(spark), _by_channel(spark, sf_dir)
        store.save_analysis("r1", "campaign_analysis", melted(wide.where("campaign < '3'"), ["campaign"]))
        store.save_analysis("r1", "campaign_analysis", melted(wide, ["campaign"]))  # replaces
        store.save_analysis("r2", "campaign_analysis", melted(wide.where("campaign >= '3'"), ["campaign"]))
        return rounded(store.load_analysis("r1", "campaign_analysis"))


@R.add("snk_05", _TIDY)
def snk_05(spark, sf_dir):
    return rounded(melted(_by_channel(spark, sf_dir), ["campaign"]))


@R.add("src_16", "SELECT 'r2' AS run_id, round(sum(spend), 2) AS spend, count(*) AS rows FROM m")
def src_16(spark, sf_dir):
    """A finished run opens by its file's content, with the figures that it was stored with."""
    store = _store(spark)
    total = campaign_rows(spark, sf_dir).agg(F.round(F.sum("spend"), 2).alias("spend"), F.count(F.lit(1)).alias("rows")).first()
    store.register_datasets(spark.createDataFrame([("h1", "one.csv"), ("h2", "two.csv")], "sha256 string, name string"))
    for run_id, sha256, status, at in (("r1", "h1", "finished", 1), ("r2", "h1", "finished", 2), ("r3", "h1", "failed", 3), ("r4", "h2", "created", 4)):
        store.set_status(run_id, sha256, status, at)
        store.save_snapshot(run_id, {"spend": total["spend"], "rows": total["rows"], "run": run_id}, at)
    run_id, snapshot = store.reopen("h1")
    assert store.reopen("h2") is None and snapshot["run"] == run_id
    return spark.createDataFrame([(run_id, snapshot["spend"], snapshot["rows"])], "run_id string, spend double, rows long")


@add("snk_03", "SELECT 'o_comment' AS column_name, CASE WHEN o_orderkey % 2 = 0 THEN 'fixed' ELSE 'flagged' END AS action, count(*) AS n, min(o_orderkey) AS first_row FROM orders GROUP BY 2")
def snk_03(spark, sf_dir):
    """The cleaning log under the store's names; a run's log is replaced, other runs' stay."""
    store = _store(spark)
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_row"), F.lit("o_comment").alias("column"), F.lit("a").alias("original"), F.lit("b").alias("cleaned"), F.when(F.col("o_orderkey") % 2 == 0, "fixed").otherwise("flagged").alias("action"))
    store.save_quality_log("r1", log.where("source_row % 5 = 0"))
    store.save_quality_log("r2", log.where("source_row % 7 = 0"))
    store.save_quality_log("r1", log)
    return store.load_log("r1", "data_quality_logs").where("original_value = 'a' and cleaned_value = 'b'").groupBy("column_name", "action").agg(F.count(F.lit(1)).alias("n"), F.min("source_row").alias("first_row"))


@add("snk_04", "SELECT * FROM (VALUES ('Day', 'date', 'mapped', 100.0e0), ('Cost', 'spend', 'mapped', 100.0e0), ('Sales', NULL, 'suggested', 0.0e0), ('CTR', NULL, 'derived', 100.0e0), ('Total cost', NULL, 'not_used', 100.0e0)) v(source_column, canonical_field, status, score)")
def snk_04(spark, sf_dir):
    store = _store(spark)
    store.save_mappings("r1", MP.map_fields(["Day"], {"Day": "date"}))
    store.save_mappings("r1", MP.map_fields(["Day", "Cost", "Sales", "CTR", "Total cost"], {"Day": "date", "Cost": "number", "Sales": "number", "CTR": "number", "Total cost": "number"}))
    return store.load_log("r1", "field_mappings").select("source_column", "canonical_field", "status", "score")


@add("snk_10", "SELECT event_type AS purpose, count(*) AS calls, sum(event_id % 100) AS input_tokens FROM events GROUP BY 1")
def snk_10(spark, sf_dir):
    """Calls come in parts; none replaces what came before."""
    store = _store(spark)
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("purpose"), F.lit("m").alias("model"), F.lit("ok").alias("status"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 3).alias("part"))
    for part in range(3):
        store.append_log("r1", "ai_calls", calls.where(F.col("part") == part).drop("part"))
    store.append_log("r2", "ai_calls", calls.drop("part"))
    return store.load_log("r1", "ai_calls").groupBy("purpose").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"))


@add("snk_11", "SELECT 'r' || n_regionkey AS run_id, CASE WHEN n_nationkey % 2 = 0 THEN 'pdf' ELSE 'xlsx' END AS kind, n_name AS path, n_nationkey AS \"at\" FROM nation")
def snk_11(spark, sf_dir):
    """A report for each nation, registered under its region's run in two parts."""
    store = _store(spark)
    nations = table(spark, sf_dir, "nation")
    for run in [r["r_regionkey"] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()]:  # five regions
        own = nations.where(F.col("n_regionkey") == run).select(F.when(F.col("n_nationkey") % 2 == 0, "pdf").otherwise("xlsx").alias("kind"), F.col("n_name").alias("path"), F.col("n_nationkey").alias("at"))
        for part in (own.where("at < 10"), own.where("at >= 10")):
            store.append_log(f"r{run}", "reports", part)
    return store.read("reports").select("run_id", "kind", "path", "at")


@add("src_15", "SELECT 'quality' AS log, count(*) AS n FROM orders UNION ALL SELECT 'mappings', 3 UNION ALL SELECT 'reports', 1 UNION ALL SELECT 'runs', 1")
def src_15(spark, sf_dir):
    """Everything that is stored of one run, beside another."""
    store = _store(spark)
    store.register_datasets(spark.createDataFrame([("h1", "one.csv")], "sha256 string, name string"))
    for run_id in ("r1", "r2"):
        store.save_quality_log(run_id, table(spark, sf_dir, "orders").where(F.lit(run_id == "r1") | (F.col("o_orderkey") % 2 == 0)).select(F.col("o_orderkey").alias("source_row"), F.lit("x").alias("action")))
        store.append_log(run_id, "reports", spark.createDataFrame([("pdf", "p", 1)], "kind string, path string, at int"))
        store.save_mappings(run_id, MP.map_fields(["Day", "Cost", "Clicks"]))
        store.set_status(run_id, "h1", "finished", 1)
    counts = {"quality": store.load_log("r1", "data_quality_logs"), "mappings": store.load_log("r1", "field_mappings"), "reports": store.load_log("r1", "reports"), "runs": store.runs().where("run_id = 'r1'")}
    out = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("log"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@add("snk_06", "SELECT DISTINCT n_name AS sha256 FROM nation")
def snk_06(spark, sf_dir):
    store = _store(spark)
    files = table(spark, sf_dir, "nation").select(F.col("n_name").alias("sha256"), F.lit("x.csv").alias("name"))
    store.register_datasets(files.where("sha256 < 'K'"))
    return store.register_datasets(files).select("sha256")


def _few_runs(spark) -> RunStore:
    store = _store(spark)
    store.register_datasets(spark.createDataFrame([("h1", "one.csv"), ("h2", "two.csv"), ("h3", "orphan.csv")], "sha256 string, name string"))
    log = [("r1", "h1", "created", 1), ("r1", "h1", "finished", 5), ("r2", "h2", "created", 2), ("r2", "h2", "failed", 3), ("r3", "h1", "created", 7)]
    store.append("run_log", spark.createDataFrame(log, "run_id string, sha256 string, status string, at long"))
    for run_id, kind in (("r1", "pdf"), ("r1", "xlsx"), ("r2", "pdf")):
        store.append_log(run_id, "reports", spark.createDataFrame([(kind,)], "kind string"))
    return store


def _runs(spark, sf_dir) -> RunStore:
    """The customers' files as datasets and the orders as runs over them, with their states and reports."""
    store, k = _store(spark), F.col("o_orderkey")
    store.register_datasets(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sha256"), F.concat("c_name", F.lit(".csv")).alias("name")))
    runs = table(spark, sf_dir, "orders").select(k, k.cast("string").alias("run_id"), F.col("o_custkey").cast("string").alias("sha256"), "o_orderstatus")
    store.append("run_log", runs.select("run_id", "sha256", F.lit("created").alias("status"), (k * 2).alias("at")))
    last = F.create_map(F.lit("F"), F.lit("finished"), F.lit("P"), F.lit("failed"))[F.col("o_orderstatus")]
    store.append("run_log", runs.select("run_id", "sha256", last.alias("status"), (k * 2 + 1).alias("at")).where("status is not null"))
    store.append("reports", runs.select("run_id", F.explode(F.slice(F.array(F.lit("pdf"), F.lit("xlsx")), 1, (k % 3).cast("int"))).alias("kind")))
    return store


_RUN_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, c_name || '.csv' AS name, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'failed' ELSE 'created' END AS status FROM orders JOIN customer ON c_custkey = o_custkey"


@add("snk_07", "SELECT status, count(*) AS n FROM (" + _RUN_SQL + ") GROUP BY 1")
def snk_07(spark, sf_dir):
    """How many runs are in each state."""
    return _runs(spark, sf_dir).runs().groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@add("jn_01", _RUN_SQL)
def jn_01(spark, sf_dir):
    return _runs(spark, sf_dir).runs().select("run_id", "name", "status")


def _with_reports(store: RunStore, runs: DataFrame) -> DataFrame:
    reports = store.read("reports").groupBy("run_id").agg(F.count(F.lit(1)).alias("reports"))
    return runs.join(reports, "run_id", "left").select("run_id", "name", F.coalesce("reports", F.lit(0)).alias("reports"))


@add("jn_02", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, c_name || '.csv' AS name, o_orderkey % 3 AS reports FROM orders JOIN customer ON c_custkey = o_custkey")
def jn_02(spark, sf_dir):
    store = _runs(spark, sf_dir)
    return _with_reports(store, store.runs())


@add("prj_21", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, c_name || '.csv' AS name, o_orderkey % 3 AS reports FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderkey DESC LIMIT 50")
def prj_21(spark, sf_dir):
    """The feature: the newest runs of a store."""
    store = _runs(spark, sf_dir)
    return _with_reports(store, store.runs().limit(50))


@add("jn_09", "SELECT CAST(c_custkey AS VARCHAR) AS sha256 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn_09(spark, sf_dir):
    """Files that no run has read."""
    store = _runs(spark, sf_dir)
    return store.read("datasets").join(store.runs().select("sha256"), "sha256", "left_anti").select("sha256")


@add("snk_08", "SELECT c_nationkey AS key, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1")
def snk_08(spark, sf_dir):
    store = _store(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("version"))
    store.upsert("mapping_cache", rows.where("version % 3 = 0"), ["key"], "version")
    store.upsert("mapping_cache", rows.where("version % 3 = 1"), ["key"], "version")
    store.compact("mapping_cache", ["key"], "version")
    return store.upsert("mapping_cache", rows.where("version % 3 = 2"), ["key"], "version").select("key", "name")


@add("snk_09", "SELECT r_name AS layout_key, n_name AS kpi, CAST(n_nationkey AS DOUBLE) AS target FROM nation JOIN region ON r_regionkey = n_regionkey")
def snk_09(spark, sf_dir):
    """Each region's targets replace those that it had; other regions' stay."""
    store, nations = _store(spark), table(spark, sf_dir, "nation")
    every = nations.select(F.col("n_name").alias("kpi"), (F.col("n_nationkey") * 2.0).alias("target"))
    for region in table(spark, sf_dir, "region").collect():  # five regions
        store.save_targets(region["r_name"], every)
        store.save_targets(region["r_name"], nations.where(F.col("n_regionkey") == region["r_regionkey"]).select(F.col("n_name").alias("kpi"), F.col("n_nationkey").cast("double").alias("target")))
    return store.read("targets").select("layout_key", "kpi", "target")


@add("snk_14", "SELECT 'r3' AS run_id, (SELECT count(*) FROM orders) AS rows, 1 AS reports")
def snk_14(spark, sf_dir):
    """Only the newest run stays, and of the others no row of any table."""
    store = _few_runs(spark)
    store.append_log("r3", "reports", spark.createDataFrame([("pdf",)], "kind string"))
    for run_id in ("r1", "r2", "r3"):
        store.save_quality_log(run_id, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_row"), F.lit("x").alias("action")))
    gone = store.apply_retention(keep=1)
    left = store.runs().select("run_id")
    rows = store.read("data_quality_logs").groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
    reports = store.read("reports").groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("reports"))
    assert sorted(gone) == ["r1", "r2"] and rows.count() == 1 and reports.count() == 1
    return left.join(rows, "run_id").join(reports, "run_id")


@add("ag_34", "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, round(sum(value) FILTER (event_type = 'purchase'), 2) AS spent FROM events GROUP BY 1")
def ag_34(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("spent")), 2)


@R.add("snk_12", "SELECT channel, " + measures_sql(["spend", "revenue", "roas"], 2) + " FROM m GROUP BY channel")
def snk_12(spark, sf_dir):
    """A result table as a delimited export, read back with its types."""
    folder = new_folder(spark, "export")
    result = rounded(group_kpis(campaign_rows(spark, sf_dir), "channel", PRESENT).select("channel", "spend", "revenue", "roas"), 2)
    result.write.option("header", True).mode("overwrite").csv(folder)
    return spark.read.schema(result.schema).option("header", True).csv(folder)


# the stream


@add("st_01", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def st_01(spark, sf_dir):
    counts = ST.tumbling(ST.read_events(spark, f"{sf_dir}/events.parquet"), late="60 days")
    return rounded(_complete(counts, spark).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "value"), 2)


def _complete(counts: DataFrame, spark: SparkSession) -> DataFrame:
    """Every micro-batch rewrites the table of all windows, so nothing waits for the watermark at the end."""
    folder = new_folder(spark, "windows")
    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@add("st_02", """SELECT user_id, count(*) AS sessions, sum(n) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
    FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def st_02(spark, sf_dir):
    made = ST.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return made.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


QUERIES, ORACLE_SQL = R.queries, R.sql
