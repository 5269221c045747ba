"""Helpers for the query modules: registration, rounding, and SQL for grouped measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.kpi import RATIOS, TOTALS, parts

from .canonical import campaign_sql

#: Fields that the canonical rows hold.
PRESENT = {"date", "campaign_name", "channel", "platform", "region", "customer_segment", "product_category", "spend", "budget", "impressions", "clicks", "leads", "qualified_leads", "conversions", "revenue", "gross_profit"}
SUMS = ["spend", "budget", "impressions", "clicks", "leads", "qualified_leads", "conversions", "revenue", "gross_profit"]
MEASURES = SUMS + list(RATIOS)


class Registry:
    """Collects a module's queries and the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, campaign: str = "p_brand", m: bool = True, dates: tuple[str, ...] = ()):
        """Register the decorated query; with m, its SQL can read the canonical rows as m. dates: columns given as text."""

        def keep(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = f
            if sql is not None:
                whole = f"WITH {campaign_sql(campaign)}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if m else sql
                as_text = ", ".join(f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dates)
                self.sql[name] = f"SELECT * REPLACE ({as_text}) FROM ({whole})" if dates else whole
            return f

        return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that sums in another order give equal values (means of four keep six digits: ties); dates as text."""
    return df.select(*((F.round(c, 6 if c.endswith("_rolling") else digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))


def ratio_sql(key: str) -> str:
    n, d, scale = parts(key, PRESENT)
    known = f"FILTER (({n}) IS NOT NULL AND ({d}) IS NOT NULL)"
    return f"sum({n}) {known} / nullif(sum({d}) {known}, 0) * {scale}"


def measure_sql(key: str) -> str:
    return ratio_sql(key) if key in RATIOS else f"sum({key})"


def measures_sql(keys: list[str] | None = None, digits: int | None = 4) -> str:
    """The measures as a select list."""
    return ", ".join(f"round({measure_sql(k)}, {digits}) AS {k}" if digits is not None else f"{measure_sql(k)} AS {k}" for k in keys or MEASURES)


def totals_and_ratios() -> list[str]:
    return [*TOTALS, *RATIOS]
