"""Joins of date intervals that overlap, without comparing all pairs.

An interval lives at a level: the least power of two of days that is as long, so it touches at most two bins of its
level. Of two intervals the shorter one visits the bins of the longer one's level. Both meet by an equi-join on
(level, bin), and a pair comes out in the first bin that both touch. Longer intervals than the highest
level live there in as many bins as they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The highest level: bins of 2**16 days.
LEVELS = 16


def _numbered(df: DataFrame, side: str, start: str, end: str, slack: int) -> DataFrame:
    """Columns with the side's prefix, and the interval's days and level. Intervals without both ends, or that end before they start, meet nothing."""
    first, last = F.unix_date(F.col(start).cast("date")), F.unix_date(F.col(end).cast("date")) + slack
    rows = df.where(F.col(start) <= F.col(end)).select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns), first.alias(f"_{side}_first"), last.alias(f"_{side}_last"))
    size = F.col(f"_{side}_last") - F.col(f"_{side}_first") + 1
    return rows.withColumn(f"_{side}_level", F.least(F.ceil(F.log2(size.cast("double"))).cast("int"), F.lit(LEVELS)))


def _bins(df: DataFrame, side: str, level: Column) -> DataFrame:
    """A row for each bin that the interval touches at some levels."""
    leveled = df.withColumn("_level", level)
    shifted = lambda c: F.expr(f"shiftright({c}, _level)")
    return leveled.withColumn("_bin", F.explode(F.sequence(shifted(f"_{side}_first"), shifted(f"_{side}_last"))))


def overlapping(a: DataFrame, b: DataFrame, start: str = "start", end: str = "end", slack: int = 0) -> DataFrame:
    """All pairs of rows whose intervals overlap or lie at most ``slack`` days apart, as columns a_... and b_...

    Dates, both ends inclusive. Each pair comes once, equal rows as often as they are.
    """
    left, right = _numbered(a, "a", start, end, slack), _numbered(b, "b", start, end, slack)
    home = lambda df, side: _bins(df, side, F.col(f"_{side}_level"))
    visits = lambda df, side, least: _bins(df, side, F.explode(F.sequence(F.col(f"_{side}_level") + least, F.lit(LEVELS + least)))).where(F.col("_level") <= LEVELS)
    first_shared = F.col("_bin") == F.greatest(F.expr("shiftright(_a_first, _level)"), F.expr("shiftright(_b_first, _level)"))
    meet = (F.col("_a_first") <= F.col("_b_last")) & (F.col("_b_first") <= F.col("_a_last"))
    names = [*(f"a_{c}" for c in a.columns), *(f"b_{c}" for c in b.columns)]
    keys = ["_level", "_bin"]
    longer_a = home(left, "a").join(visits(right, "b", 0), keys).where(first_shared & meet).select(*names)
    longer_b = visits(left, "a", 1).join(home(right, "b"), keys).where(first_shared & meet).select(*names)
    return longer_a.unionByName(longer_b)
