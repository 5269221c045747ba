"""Measures as declared pairs of SQL expressions; every ratio is recomputed from sums.

Three rules: additive measures are summed (reach never is); ratios come from sums, not from averages
of rows; a ratio counts only rows where both of its parts are known. A missing or zero denominator
gives NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.schema import ADDITIVE, FIELDS

UP, DOWN, NEITHER = "up", "down", "none"


@dataclass(frozen=True)
class Ratio:
    """numerator / denominator * scale; a denominator may name stand-ins, the first with data counts."""

    numerator: str
    denominators: tuple[str, ...]
    scale: float
    better: str
    needs: tuple[str, ...] = ()


TOTALS = {"spend": NEITHER, "impressions": UP, "clicks": UP, "leads": UP, "qualified_leads": UP, "conversions": UP, "revenue": UP, "gross_profit": UP}
RATIOS = {
    "ctr": Ratio("clicks", ("impressions",), 100, UP),
    "cpc": Ratio("spend", ("clicks",), 1, DOWN),
    "cpl": Ratio("spend", ("leads",), 1, DOWN),
    "click_to_lead_rate": Ratio("leads", ("clicks",), 100, UP),
    "lead_qualification_rate": Ratio("qualified_leads", ("leads",), 100, UP),
    "lead_to_conversion_rate": Ratio("conversions", ("leads",), 100, UP),
    "cac": Ratio("spend", ("customers", "conversions"), 1, DOWN),
    "roas": Ratio("revenue", ("spend",), 1, UP),
    "aov": Ratio("revenue", ("orders", "conversions"), 1, UP),
    "roi": Ratio("gross_profit - spend", ("spend",), 100, UP, ("gross_profit", "spend")),
    "budget_utilisation": Ratio("spend", ("budget",), 100, NEITHER),
}
PROFIT_BETTER = {"gross_margin_pct": UP, "break_even_roas": DOWN, "contribution": UP, "profit_per_rupee": UP, "roas_headroom": UP}
BETTER = TOTALS | {k: r.better for k, r in RATIOS.items()} | PROFIT_BETTER


def presence(df: DataFrame) -> set[str]:
    """The canonical fields that have a value, from one aggregate over all columns."""
    columns = [c for c in df.columns if c in FIELDS]
    if not columns:
        return set()
    counts = df.agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in columns)).first()
    return {c for c in columns if counts[c]}


def with_gross_profit(df: DataFrame, present: set[str]) -> tuple[DataFrame, set[str]]:
    """Gross profit from revenue and margin where there is no such column; margins above 1 are percentages."""
    if "gross_profit" in present or not {"margin", "revenue"} <= present:
        return df, present
    share = F.when(F.col("margin") > 1, F.col("margin") / 100).otherwise(F.col("margin"))
    return df.withColumn("gross_profit", F.col("revenue") * share), present | {"gross_profit"}


def parts(key: str, present: set[str]) -> tuple[str, str, float] | None:
    """Numerator and denominator expressions of a ratio and its scale, or None without the fields."""
    ratio = RATIOS[key]
    denominator = next((d for d in ratio.denominators if d in present), None)
    if denominator is None or not set(ratio.needs or (ratio.numerator,)) <= present:
        return None
    return ratio.numerator, denominator, float(ratio.scale)


def both_known(numerator: str, denominator: str) -> tuple[Column, Column]:
    """The parts of a ratio on rows where both are known, else NULL."""
    n, d = F.expr(numerator).cast("double"), F.expr(denominator).cast("double")
    known = n.isNotNull() & d.isNotNull()
    return F.when(known, n), F.when(known, d)


def ratio_of_sums(key: str, present: set[str]) -> Column | None:
    found = parts(key, present)
    if found is None:
        return None
    n, d = both_known(found[0], found[1])
    return F.try_divide(F.sum(n), F.sum(d)) * found[2]


def measures(present: set[str]) -> list[Column]:
    """All sums and ratios that the data allow, as aggregate columns."""
    sums = [F.sum(F.col(m).cast("double")).alias(m) for m in ADDITIVE if m in present]
    ratios = [(k, ratio_of_sums(k, present)) for k in RATIOS]
    return sums + [c.alias(k) for k, c in ratios if c is not None]


# Fixed labels of channels that carry no media price, and of those paid by result.
OWNED = ["email", "sms", "whatsapp", "push notifications", "organic social", "organic search", "seo", "direct", "referral", "website"]
BY_RESULT = ["affiliate", "affiliates", "affiliate network"]


def label(name: Column) -> Column:
    """Trimmed, single-spaced, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def channel_type(channel: Column) -> Column:
    """owned or paid; a missing or unknown channel counts as paid."""
    key = label(channel)
    return F.when(key.isin(OWNED) | key.startswith("email") | key.startswith("e-mail"), "owned").otherwise("paid")


def channel_pricing(channel: Column) -> Column:
    """performance for channels paid by result, else auction."""
    return F.when(label(channel).isin(BY_RESULT), "performance").otherwise("auction")
