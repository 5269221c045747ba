"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, component (smallest id reachable) for every id in edges (a, b).

    Every round takes the smallest label among neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of a component's diameter. Each round is a written
    table; whether anything moved is counted as the table is written. All labels are ids, so a label
    is looked up in the same table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = scratch.table(both, f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component"))
    labels = scratch.table(labels, f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(seen, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        roots = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        lower = lower.join(roots, "component", "left").select("id", F.least("component", "root").alias("component"), "before")
        moved = Observation(f"{name}-{step}-moved")
        watched = lower.observe(moved, F.count(F.when(F.col("component") != F.col("before"), 1)).alias("n"))
        labels = scratch.table(watched.select("id", "component"), f"{name}-{step}")
        if not moved.get["n"]:
            return labels
        if step > 1:
            scratch.drop(f"{name}-{step - 2}")
