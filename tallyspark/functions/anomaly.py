"""Window kernels of the weekly detector: baselines, spreads, runs of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BASELINE, LEAST = 8, 4


def before(by: list[str], order: str, shift: int) -> WindowSpec:
    """The eight rows before the judged window of shift + 1 rows."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-(BASELINE + shift), -(1 + shift))


def rolling(by: list[str], order: str, width: int) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)


def baseline(value: Column, frame: WindowSpec) -> Column:
    """Median of the known values in the frame, at least four."""
    return F.when(F.count(value).over(frame) >= LEAST, F.percentile(value, 0.5).over(frame))


def _middle(values: Column) -> Column:
    """Median of an array without NULLs."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.element_at(ordered, ((n + 1) / 2).cast("int")), F.element_at(ordered, (n / 2).cast("int") + 1)
    return F.when(n == 0, None).otherwise((low + high) / 2)


def spread(value: Column, frame: WindowSpec) -> Column:
    """Median absolute deviation from the median in the frame, at least four known values."""
    values = F.collect_list(value).over(frame)
    deviations = F.transform(values, lambda x: F.abs(x - _middle(values)))
    return F.when(F.size(values) >= LEAST, _middle(deviations))


def both_least(a: Column, b: Column) -> Column:
    """The smaller one, NULL if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def islands(df: DataFrame, by: list[str], start: str, end: str, gap_days: int = 1) -> DataFrame:
    """df with island: periods that overlap or lie at most gap_days apart share a number within the key."""
    past = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*by).orderBy(start, end)
    opens = F.when(F.col(start) > F.date_add(F.max(end).over(past), gap_days), 1).when(F.max(end).over(past).isNull(), 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")
