"""Rule findings with the numbers they rest on, plain comparisons, evidence packs and answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.kpi import BETTER, DOWN
from tallyspark.sources.shared import new_folder

# Fixed thresholds.
CONCENTRATION, SIZEABLE, MOVER, GAP_POINTS, PACK_CHARS = 40.0, 3.0, 2.0, 5.0, 21_000
HEADLINES = ["roas", "cpl", "ctr"]
FINDING = "finding string, priority int, entity string, metric string, value double, numbers array<struct<table:string,key:string,column:string,value:double>>"


def trend_colour(change_pct: Column, better: Column) -> Column:
    """good for a better or flat measure (5 %), watch to 15 % worse, then bad; none for neutral measures."""
    wrong = F.when(better == "down", change_pct).otherwise(-change_pct)
    return F.when(change_pct.isNull() | (better == "none"), "none").when((wrong <= 0) | (F.abs(change_pct) <= 5), "good").when(F.abs(change_pct) <= 15, "watch").otherwise("bad")


def headline_metric(present: set[str]) -> str | None:
    """ROAS where there is revenue, else cost per lead, else click rate."""
    needs = {"roas": {"revenue", "spend"}, "cpl": {"spend", "leads"}, "ctr": {"clicks", "impressions"}}
    return next((m for m in HEADLINES if needs[m] <= present), None)


def _number(table: str, key: Column, column: str) -> Column:
    return F.struct(F.lit(table).alias("table"), key.alias("key"), F.lit(column).alias("column"), F.col(column).cast("double").alias("value"))


def _extreme(table: DataFrame, name: str, key: str, metric: str, low: bool) -> DataFrame:
    """The row with the lowest or highest metric, ties by key."""
    order = F.struct(F.when(F.col(metric).isNotNull(), (F.col(metric) if low else -F.col(metric))).alias("v"), F.col(key).alias("k"))
    return table.where(F.col(metric).isNotNull()).agg(F.min_by(F.struct(*table.columns), order).alias("r")).where("r is not null").select("r.*")


def _finding(rows: DataFrame, finding: str, priority: int, table: str, key: str, metric: str, columns: list[str]) -> DataFrame:
    return rows.select(
        F.lit(finding).alias("finding"), F.lit(priority).alias("priority"), F.col(key).alias("entity"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"),
        F.array(*(_number(table, F.col(key), c) for c in columns)).alias("numbers"),
    )


def generate_findings(channels: DataFrame, campaigns: DataFrame, funnel: DataFrame, segments: DataFrame, present: set[str]) -> DataFrame:
    """Findings in order of priority from the result tables (few rows each); every number names its table, key and column."""
    folder = new_folder(channels.sparkSession, "findings")

    def written(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return table.sparkSession.read.schema(table.schema).parquet(f"{folder}/{name}")

    # small result tables that several rules read
    channels, campaigns, funnel, segments = (written(t, n) for t, n in ((channels, "channels"), (campaigns, "campaigns"), (funnel, "funnel"), (segments, "segments")))
    metric = headline_metric(present) or "spend"
    low = BETTER[metric] == DOWN
    several = channels.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    top = _extreme(several.where("_n > 1").drop("_n"), "channels", "channel", "spend_share", False).where(F.col("spend_share") >= CONCENTRATION)
    outcome = next((m for m in ("revenue", "conversions", "leads") if f"{m}_share" in channels.columns), None)
    parts = [_finding(top, "concentration", 1, "channels", "channel", "spend_share", ["spend_share", *([f"{outcome}_share"] if outcome else [])])]
    paid = channels.where("type = 'paid'")
    parts += [
        _finding(_extreme(paid, "channels", "channel", metric, low), "best_channel", 2, "channels", "channel", metric, [metric]),
        _finding(_extreme(paid, "channels", "channel", metric, not low), "weakest_channel", 3, "channels", "channel", metric, [metric]),
        _finding(channels.where("type = 'owned'"), "owned_channel", 3, "channels", "channel", "spend", ["spend"]),
    ]
    drop = funnel.where("rate is not null and stage != 'clicks'").agg(F.min_by(F.struct("stage", "rate"), F.struct("rate", "place")).alias("r")).where("r is not null").select("r.*")
    parts.append(_finding(drop, "funnel_bottleneck", 4, "funnel", "stage", "rate", ["rate"]))
    made = next((m for m in ("conversions", "leads", "clicks") if m in campaigns.columns), None)
    if made:
        parts.append(_finding(_extreme(campaigns, "campaigns", "campaign_name", made, False), "top_campaign", 5, "campaigns", "campaign_name", made, [made]))
    sizeable = campaigns.where(F.col("spend_share") >= SIZEABLE)
    parts.append(_finding(_extreme(sizeable, "campaigns", "campaign_name", metric, not low), "weakest_campaign", 6, "campaigns", "campaign_name", metric, [metric, "spend_share"]))
    movers = campaigns.where(F.col("spend_share") >= MOVER)
    parts += [
        _finding(_extreme(movers, "campaigns", "campaign_name", "change_pct", False).where("change_pct > 0"), "riser", 7, "campaigns", "campaign_name", "change_pct", ["change_pct"]),
        _finding(_extreme(movers, "campaigns", "campaign_name", "change_pct", True).where("change_pct < 0"), "faller", 8, "campaigns", "campaign_name", "change_pct", ["change_pct"]),
        _finding(_extreme(segments, "segments", "segment", metric, low), "best_segment", 9, "segments", "segment", metric, [metric]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("priority", "finding", "entity")


def key_numbers(kpis: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """kpi, text: the overall measures as they are shown."""
    text = F.lit(X.NA)
    for kind in ("money", "percent", "ratio", "count"):
        names = [k for k, v in kinds.items() if v == kind]
        text = F.when(F.col("kpi").isin(names), X.value_text(F.col("value"), kind)).otherwise(text)
    return kpis.where(F.col("kpi").isin(list(kinds))).select("kpi", text.alias("text"))


def alerts(incidents: DataFrame, most: int = 5) -> DataFrame:
    """The incidents that matter most, as lines."""
    text = F.concat(F.col("entity"), F.lit(": "), F.col("metrics"), F.lit(", "), X.date_range_text(F.col("start"), F.col("end")), F.lit(", about "), X.rupees(F.abs("impact"), compact=True))
    return incidents.where("sentiment != 'positive'").orderBy("rank").limit(most).select("rank", text.alias("line"))


def evidence_pack(findings: DataFrame, cap: int = PACK_CHARS) -> DataFrame:
    """evidence_id, text: findings by priority while they fit under a number of characters.

    A finding that does not fit is left out and later shorter ones may still enter; findings are a
    few rows, so this is one ordered fold over their array.
    """
    text = F.concat_ws(" | ", "finding", "entity", "metric", F.format_string("%.4f", "value"))
    items = findings.select(F.struct("priority", "finding", F.coalesce("entity", F.lit("")).alias("entity"), F.coalesce(text, F.lit("")).alias("text")).alias("i")).agg(F.array_sort(F.collect_list("i")).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, item: Column) -> Column:
        size = F.length(item["text"]) + 1
        fits = state["used"] + size <= cap
        return F.struct(F.when(fits, state["used"] + size).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(item["text"]))).otherwise(state["kept"]).alias("kept"))

    kept = items.select(F.posexplode(F.aggregate("items", start, step, lambda s: s["kept"])).alias("n", "text"))
    return kept.select(F.format_string("E%02d", F.col("n") + 1).alias("evidence_id"), "text")


def check_answers(answers: DataFrame, evidence: Column) -> DataFrame:
    """answers (id, text) with numbers, unmatched and status: verified, unverified or weak (no number to check)."""
    numbers = F.filter(X.numbers_in(F.col("text")), X.checkable)
    unmatched = F.size(F.filter(numbers, lambda n: ~X.matches(n, evidence)))
    return answers.withColumn("numbers", F.size(numbers)).withColumn("unmatched", unmatched).withColumn("status", F.when(F.col("numbers") == 0, "weak").when(F.col("unmatched") == 0, "verified").otherwise("unverified"))
