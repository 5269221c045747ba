"""What a raw text table holds: types, missing values, shares that parse, findings, cross-checks, plausibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.kpi import label

from .mapping import words

# Fixed thresholds.
TYPE_SHARE, MIXED_SHARE, MOSTLY_EMPTY = 0.90, 0.50, 0.95
MATCH_SHARE, LEAST_ROWS, REL_TOLERANCE, ABS_TOLERANCE, SAMPLE = 0.90, 5, 0.02, 0.011, 500
MOST_CTR, LEAST_LEAD_CONVERSION, MOST_ROAS = 50.0, 0.1, 50.0


def profile(raw: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: rows, missing, distinct, shares of numbers and dates, money and percent marks, range and type.

    All columns are profiled in one aggregate over the long form (column, value), which Spark combines before the shuffle.
    """
    long = raw.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))).alias("e")).select("e.*")
    seen = long.withColumn("missing", X.is_missing(F.col("v")))
    by_value = seen.groupBy("column", "v", "missing").agg(F.count(F.lit(1)).alias("n"))  # each distinct value is parsed once
    parsed = by_value.select("column", "v", "missing", "n", X.parse_number(F.col("v")).alias("num"), X.parse_date(F.col("v")).alias("day"))

    def weight(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition & ~F.col("missing"), F.col("n"))), F.lit(0))

    number, date = F.col("num.value").isNotNull(), F.col("day").isNotNull()
    sums = parsed.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("missing"), F.count(F.when(~F.col("missing"), 1)).alias("distinct"), weight(number).alias("_num"), weight(date).alias("_day"),
        weight(number & F.col("v").rlike(X.CURRENCY)).alias("_money"), weight(F.trim("v").endswith("%")).alias("_pct"), weight(number & (F.col("num.value") != F.floor("num.value"))).alias("_part"), weight(F.col("num.value").between(0, 100)).alias("_0_100"),
        F.min("num.value").alias("min"), F.max("num.value").alias("max"), F.min("day.value").alias("first_day"), F.max("day.value").alias("last_day"),
    )
    known = F.col("rows") - F.col("missing")
    shares = {c: F.coalesce(F.try_divide(F.col(f"_{c}"), known), F.lit(0.0)) for c in ("num", "day", "money", "pct", "part", "0_100")}
    kind = (
        F.when(known == 0, "empty").when(shares["day"] >= TYPE_SHARE, "date").when((shares["num"] >= TYPE_SHARE) & (shares["money"] >= MIXED_SHARE), "money").when(shares["num"] >= TYPE_SHARE, "number")
        .when((shares["num"] >= MIXED_SHARE) | (shares["day"] >= MIXED_SHARE), "mixed").otherwise("text")
    )
    ratio = (shares["pct"] >= 0.5) | ((shares["0_100"] >= 0.95) & (shares["part"] >= 0.5))
    return sums.select("column", "rows", "missing", "distinct", shares["num"].alias("number_share"), shares["day"].alias("date_share"), "min", "max", "first_day", "last_day", kind.alias("type"), ratio.alias("ratio_like"), (F.try_divide("missing", "rows") >= MOSTLY_EMPTY).alias("mostly_empty"))


def top_values(raw: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """column, rank, value, n: the most frequent known values. Counts are combined first; each column's best k come from bounded arrays."""
    long = raw.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("e")).select("e.*")
    counts = long.where(~X.is_missing(F.col("value"))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= k)  # Spark limits each partition's groups before the shuffle


def findings(raw: DataFrame, columns: list[str]) -> DataFrame:
    """finding, column, n: duplicates, totals, stray spaces, mixed types, empty columns."""
    total = F.exists(F.array(*(F.col(f"`{c}`") for c in columns)), X.is_summary)
    one = raw.agg(F.count(F.when(total, 1)).alias("summary_rows"), *(F.count(F.when(F.col(f"`{c}`") != X.tidy(F.col(f"`{c}`")), 1)).alias(f"stray:{c}") for c in columns))
    cells = [F.struct(F.lit(n.split(":")[0]).alias("finding"), F.lit(n.split(":")[1] if ":" in n else None).cast("string").alias("column"), F.col(f"`{n}`").alias("n")) for n in one.columns]
    loose = one.select(F.explode(F.array(*cells)).alias("f")).select("f.*").withColumn("finding", F.when(F.col("finding") == "stray", "stray_spaces").otherwise(F.col("finding")))
    repeats = raw.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_rows").alias("finding"), F.lit(None).cast("string").alias("column"), "n")
    kinds = profile(raw, columns)
    typed = kinds.where(F.col("type").isin("mixed", "empty") | F.col("mostly_empty")).select(F.when(F.col("type") == "mixed", "mixed_types").when(F.col("type") == "empty", "empty_column").otherwise("mostly_empty").alias("finding"), "column", (F.col("rows") - F.col("missing")).alias("n"))
    return loose.unionByName(repeats).unionByName(typed).where("n > 0 or finding = 'empty_column'")


def impossible(df: DataFrame) -> DataFrame:
    """finding, column, n: negative measures and stages above the stage before them, in typed columns."""
    from tallyspark.schema import NUMERIC

    from .cleaning import FUNNEL_RULES

    checks = {f"negative:{c}": F.col(c) < 0 for c in NUMERIC if c in df.columns and c != "margin"}
    checks |= {f"impossible_stage:{a}": F.col(a) > F.col(b) for a, b in FUNNEL_RULES if a in df.columns and b in df.columns}
    one = df.agg(*(F.count(F.when(v, 1)).alias(k) for k, v in checks.items()))
    return one.unpivot([], list(checks), "k", "n").where("n > 0").select(F.split("k", ":")[0].alias("finding"), F.split("k", ":")[1].alias("column"), "n")


# cross-checks of a file's own ratios

CHECKS = {
    "CPC": [("spend", "clicks", (1,))],
    "CTR": [("clicks", "impressions", (100, 1))],
    "CPL": [("spend", "leads", (1,))],
    "CPM": [("spend", "impressions", (1000,))],
    "CPA": [("spend", "conversions", (1,)), ("spend", "orders", (1,)), ("spend", "customers", (1,))],
    "ROAS": [("revenue", "spend", (1,))],
    "ROI": [("profit", "spend", (100, 1)), ("net_return", "spend", (100, 1))],
    "CVR": [("conversions", "clicks", (100, 1)), ("conversions", "leads", (100, 1)), ("orders", "clicks", (100, 1))],
    "AOV": [("revenue", "orders", (1,)), ("revenue", "conversions", (1,))],
}


def match_share(own: Column, calculated: Column) -> tuple[Column, Column]:
    """Share of comparable rows that agree within the tolerance, and their number."""
    near = F.abs(own - calculated) <= F.greatest(F.abs(own) * REL_TOLERANCE, F.lit(ABS_TOLERANCE))
    return F.avg(F.when(own.isNotNull() & calculated.isNotNull(), near.cast("double"))), F.count(F.when(own.isNotNull() & calculated.isNotNull(), 1))


def sample_rows(df: DataFrame, key: str = "source_row", n: int = SAMPLE) -> DataFrame:
    """A fixed sample: the rows with the smallest hashes of their keys."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


# The field that plays a role, and words of columns that could play it.
ROLE_FIELDS = {"profit": "gross_profit"}
ROLE_WORDS = {
    "spend": ["spend", "spent", "cost"],
    "revenue": ["revenue", "sales", "gmv", "value"],
    "profit": ["profit", "margin amount", "contribution"],
    "orders": ["orders", "purchases", "transactions"],
    "customers": ["customers"],
    "conversions": ["conversions", "results"],
    "leads": ["leads"],
    "clicks": ["clicks"],
    "impressions": ["impressions"],
}
#: A column with one of these words is a ratio itself, so it is no part of one.
NO_ROLE = ["rate", "percent", "per", "ratio", "average", "avg", "roas", "roi", "cpc", "ctr"]
NET_RETURN = "(revenue - spend)"


def _judged(df: DataFrame, trials: list[tuple[str, str, str, int, Column, Column]]) -> DataFrame:
    """The best trial of each check (metric, column, definition, place, own value, calculated value); all are counters of ONE aggregate."""
    if not trials:
        return df.sparkSession.createDataFrame([], "check string, column string, definition string, share double, rows long, status string")
    counters = [match_share(own, calculated) for *_, own, calculated in trials]
    one = df.agg(*(c.alias(f"{k}{i}") for i, pair in enumerate(counters) for k, c in zip("sn", pair, strict=True)))
    cells = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("check", "column", "definition", "place"), t[:4], strict=True)), F.col(f"s{i}").alias("share"), F.col(f"n{i}").alias("rows")) for i, t in enumerate(trials)]
    long = one.select(F.explode(F.array(*cells)).alias("t")).select("t.*")
    holds = F.coalesce(F.col("share") >= MATCH_SHARE, F.lit(False)).cast("int")
    first = F.struct(holds, F.when(holds == 1, -F.col("place")).otherwise(0), F.coalesce("share", F.lit(-1.0)), -F.col("place"))
    best = long.groupBy("check", "column").agg(F.max_by(F.struct("definition", "place", "share", "rows"), first).alias("b")).select("check", "column", "b.*")
    status = F.when(F.col("rows") < LEAST_ROWS, "unchecked").when(F.coalesce(F.col("share"), F.lit(0.0)) < MATCH_SHARE, "mismatch").when(F.col("place") == 0, "verified").otherwise("alternative")
    return best.select("check", "column", "definition", "share", "rows", status.alias("status"))


def cross_check(df: DataFrame, own: dict[str, str]) -> DataFrame:
    """check, column, definition, share, rows, status for the file's own ratios (metric -> column) against typed fields.

    verified: the first definition holds; alternative: another one does.
    """
    trials = []
    for metric, column in own.items():
        for order, (n, d, scales) in enumerate(t for t in CHECKS[metric] if t[0] in df.columns and t[1] in df.columns):
            trials += [(metric, column, f"{n} / {d} x {s}", order, F.col(column), F.try_divide(n, d) * s) for s in scales]
    return _judged(df, trials)


def roles(spark: SparkSession, columns: list[str], mapping: dict[str, str]) -> DataFrame:
    """role, column, claimed, place: the columns that may stand for each part of a ratio, from their names' words.

    The field's own column (claimed) may always, another one if it has a word of the role and none that makes it
    a ratio itself. Revenue less spend is a part too if both are known.
    """
    named = spark.createDataFrame([(c, words(c), i) for i, c in enumerate(columns)], "column string, words string, place int")  # a row a column
    wanted = spark.createDataFrame([(r, mapping.get(ROLE_FIELDS.get(r, r)), w) for r, w in ROLE_WORDS.items()], "role string, own string, any array<string>")
    ratio = F.arrays_overlap(F.split("words", " "), F.array(*map(F.lit, NO_ROLE)))
    fits = F.exists("any", lambda w: F.col("words").contains(w)) & ~ratio
    pairs = named.join(wanted, F.coalesce(F.col("column") == F.col("own"), F.lit(False)) | fits).select("role", "column", F.coalesce(F.col("column") == F.col("own"), F.lit(False)).alias("claimed"), "place")
    if {"revenue", "spend"} <= set(mapping):
        pairs = pairs.unionByName(spark.range(1).select(F.lit("net_return").alias("role"), F.lit(NET_RETURN).alias("column"), F.lit(True).alias("claimed"), F.lit(-1).alias("place")))
    return pairs


def trials_of(found: DataFrame, own: dict[str, str]) -> DataFrame:
    """check, numerator, denominator, scales, rank: definitions joined with the columns that may play their parts.

    Rank 0 has the first definition whose parts are both the fields' own columns; what rests on other columns or
    definitions has the higher ranks, own columns first.
    """
    spark = found.sparkSession
    definitions = spark.createDataFrame([(m, i, n, d, [float(s) for s in scales]) for m in own for i, (n, d, scales) in enumerate(CHECKS[m])], "check string, order int, upper string, lower string, scales array<double>")
    side = lambda name: found.select(*(F.col(c).alias(f"{name}_{c}") for c in found.columns))
    pairs = definitions.join(side("n"), F.col("upper") == F.col("n_role")).join(side("d"), F.col("lower") == F.col("d_role")).where("n_column != d_column")
    claimed = F.col("n_claimed") & F.col("d_claimed")
    place = F.row_number().over(Window.partitionBy("check").orderBy(F.when(claimed, 0).otherwise(1), "order", F.when(F.col("n_claimed"), 0).otherwise(1), "n_place", F.when(F.col("d_claimed"), 0).otherwise(1), "d_place"))
    return pairs.select("check", F.col("n_column").alias("numerator"), F.col("d_column").alias("denominator"), "scales", claimed.alias("claimed"), place.alias("place")).withColumn("rank", F.when(F.col("claimed") & (F.col("place") == 1), 0).otherwise(F.col("place")))


def cross_check_file(raw: DataFrame, own: dict[str, str], mapping: dict[str, str]) -> DataFrame:
    """As cross_check, for a raw text table: numerators and denominators may also be columns that no field claims.

    verified: the mapped columns give the file's own ratio in its first definition; alternative: other
    columns or another definition do. own: check -> column with the file's ratio; mapping: field -> column.
    """
    columns = [c for c in raw.columns if c not in own.values()]
    tried = trials_of(roles(raw.sparkSession, columns, mapping), own).orderBy("check", "rank").collect()  # names of columns only
    used = sorted({c for t in tried for c in (t["numerator"], t["denominator"])} - {NET_RETURN} | set(own.values()) | ({mapping["revenue"], mapping["spend"]} if {"revenue", "spend"} <= set(mapping) else set()))
    name = {c: f"_{i}" for i, c in enumerate(used)}
    marks = raw.select(*(X.number_mark(F.regexp_replace(F.col(f"`{c}`").cast("string"), "[%x]", "")).alias(n) for c, n in name.items()))
    value = {c: F.col(n) for c, n in name.items()}
    if {"revenue", "spend"} <= set(mapping):
        value[NET_RETURN] = value[mapping["revenue"]] - value[mapping["spend"]]
    trials = [(t["check"], own[t["check"]], f"{t['numerator']} / {t['denominator']} x {s:g}", t["rank"], value[own[t["check"]]], F.try_divide(value[t["numerator"]], value[t["denominator"]]) * s) for t in tried for s in t["scales"]]
    return _judged(marks.select(*(X.number_value(F.col(c)).alias(c) for c in marks.columns)), trials)


def plausibility(df: DataFrame) -> DataFrame:
    """check, value for totals that cannot or hardly can be right, and spend on organic channels."""
    names = [c for c in ("spend", "impressions", "reach", "clicks", "leads", "conversions", "revenue") if c in df.columns]
    t = df.agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in names))
    checks: list[tuple[str, Column, Column]] = []
    for big, small in (("leads", "clicks"), ("conversions", "leads"), ("clicks", "impressions"), ("reach", "impressions")):
        if {big, small} <= set(names):
            checks.append((f"{big}_gt_{small}", (F.col(big) > F.col(small)) & (F.col(small) > 0), F.col(big)))
    for name, n, d, scale, most, least in (("ctr_high", "clicks", "impressions", 100, MOST_CTR, None), ("lead_to_conv_low", "conversions", "leads", 100, None, LEAST_LEAD_CONVERSION), ("roas_high", "revenue", "spend", 1, MOST_ROAS, None)):
        if {n, d} <= set(names):
            v = F.try_divide(n, d) * scale
            checks.append((name, (v > most) if most is not None else (v < least), v))
    hits = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("check"), v.alias("value"))) for k, c, v in checks)), lambda x: x.isNotNull())
    out = t.select(F.explode(hits).alias("h")).select("h.check", F.lit(None).cast("string").alias("channel"), "h.value")
    if {"channel", "spend"} <= set(df.columns):
        organic = F.lower("channel").contains("organic") | label(F.col("channel")).isin("seo", "organic search", "organic social")
        spent = df.where(organic).groupBy("channel").agg(F.sum("spend").alias("value")).where("value > 0")
        out = out.unionByName(spent.select(F.lit("organic_spend").alias("check"), "channel", "value"))
    return out


CAPABILITIES = {
    "time_series": [{"date"}], "ctr": [{"clicks", "impressions"}], "cpc": [{"spend", "clicks"}], "cpl": [{"spend", "leads"}], "revenue_metrics": [{"revenue", "spend"}],
    "roi": [{"gross_profit", "spend"}, {"margin", "revenue", "spend"}], "aov": [{"revenue", "orders"}, {"revenue", "conversions"}], "cac": [{"spend", "customers"}, {"spend", "conversions"}],
    "campaign_analysis": [{"campaign_name"}, {"campaign_id"}], "channel_analysis": [{"channel"}, {"platform"}], "segment_analysis": [{"customer_segment"}, {"age"}, {"gender"}, {"customer_type"}, {"new_returning"}],
    "geography_analysis": [{"region"}, {"state"}, {"city"}, {"country"}, {"market"}, {"city_tier"}], "product_analysis": [{"product"}, {"product_category"}, {"sku"}], "anomaly_detection": [{"date", m} for m in ("spend", "clicks", "leads", "conversions", "revenue")],
}
_FUNNEL = ["impressions", "clicks", "leads", "qualified_leads", "opportunities", "conversions", "customers"]


def capabilities(present: set[str], date_share: float = 1.0) -> dict[str, bool]:
    """Which analyses the mapped fields allow; unreadable dates switch the ones over time off."""
    fields = present - ({"date"} if date_share < MIXED_SHARE else set())
    out = {k: any(s <= fields for s in sets) for k, sets in CAPABILITIES.items()}
    return out | {"funnel": sum(f in fields for f in _FUNNEL) >= 2}


def blocking(present: set[str]) -> list[str]:
    """Why nothing can be analysed at all."""
    out = [] if present & {"spend", "impressions", "clicks", "leads", "conversions", "revenue"} else ["no measure"]
    return out
