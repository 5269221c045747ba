"""Measures overall and by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.kpi import BETTER, RATIOS, TOTALS, both_known, measures, parts, presence, with_gross_profit


def group_kpis(df: DataFrame, by: str | list[str], present: set[str] | None = None) -> DataFrame:
    """One row a key: rows, sums and ratios of the sums. A missing key is '(none)'. One aggregate, one shuffle."""
    df, present = with_gross_profit(df, presence(df) if present is None else present)
    keys = [F.coalesce(F.col(c).cast("string") if dict(df.dtypes)[c] == "string" else F.col(c), F.lit("(none)")).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in ([by] if isinstance(by, str) else by)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *measures(present))


def compute_kpis(df: DataFrame, present: set[str] | None = None) -> DataFrame:
    """One row: for each measure its value, numerator, denominator and rows used."""
    df, present = with_gross_profit(df, presence(df) if present is None else present)
    out = []
    for key in TOTALS:
        if key in present:
            out += [F.sum(F.col(key).cast("double")).alias(f"{key}"), F.count(key).alias(f"{key}__rows")]
    for key in RATIOS:
        if (found := parts(key, present)) is not None:
            n, d = both_known(found[0], found[1])
            out += [
                (F.try_divide(F.sum(n), F.sum(d)) * found[2]).alias(key), F.sum(n).alias(f"{key}__numerator"),
                F.sum(d).alias(f"{key}__denominator"), F.count(n).alias(f"{key}__rows"),
            ]
    return df.agg(*out)


def kpi_table(df: DataFrame, present: set[str] | None = None) -> DataFrame:
    """kpi, value, numerator, denominator, rows_used, better: the overall measures as rows."""
    wide = compute_kpis(df, present)
    keys = [k for k in wide.columns if "__" not in k]
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(k).alias("kpi"), F.col(k).alias("value"),
            (F.col(f"{k}__numerator") if f"{k}__numerator" in wide.columns else none).alias("numerator"),
            (F.col(f"{k}__denominator") if f"{k}__denominator" in wide.columns else none).alias("denominator"),
            F.col(f"{k}__rows").alias("rows_used"), F.lit(BETTER[k]).alias("better"),
        )
        for k in keys
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def period_comparison(df: DataFrame, start: str, end: str, present: set[str] | None = None) -> DataFrame:
    """kpi, current, previous, abs_change, pct_change, direction, is_good for [start, end] and the equally long time before it."""
    df, present = with_gross_profit(df, presence(df) if present is None else present)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    before = F.date_sub(first, F.datediff(last, first) + 1)
    now = (F.col("date") >= first) & (F.col("date") <= last)
    then = (F.col("date") >= before) & (F.col("date") < first)
    rows = df.where((F.col("date") >= before) & (F.col("date") <= last)).withColumn("period", F.when(now, "current").when(then, "previous"))
    by_period = group_kpis(rows, "period", present)
    keys = [k for k in (*TOTALS, *RATIOS) if k in by_period.columns]
    long = by_period.unpivot(["period"], keys, "kpi", "value")
    pair = long.groupBy("kpi").agg(*(F.max(F.when(F.col("period") == p, F.col("value"))).alias(p) for p in ("current", "previous")))
    change = F.col("current") - F.col("previous")
    way = F.when(change.isNull(), "n/a").when(F.abs(change) < 1e-12, "flat").when(change > 0, "up").otherwise("down")
    better = F.create_map(*(F.lit(x) for k in keys for x in (k, BETTER[k])))[F.col("kpi")]
    good = F.when((better == "none") | F.col("direction").isin("n/a", "flat"), None).otherwise(F.col("direction") == better)
    out = pair.select("kpi", "current", "previous", change.alias("abs_change"), (F.try_divide(change, F.abs("previous")) * 100).alias("pct_change"), way.alias("direction"))
    return out.withColumn("is_good", good)
