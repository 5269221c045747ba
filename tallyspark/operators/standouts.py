"""What stands out in result tables, found for all measures at once and put into words at the end.

Result tables become facts (entity, measure, value) in long form. Each finder returns rows of one shape:

    kind, measure, entity, value, beside

``beside`` is what the value is held against, where there is such a thing. A finder returns no row where
nothing stands out: a single entity, equal values, a gap or a change too small to mention. The remainder
of a folded table (REMAINDER) is no entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.kpi import BETTER, DOWN, UP

from .findings import GAP_POINTS
from .group import period_comparison

REMAINDER, TREND_DAYS, FLAT_PCT = "Other", 28, 5.0
#: How a measure's values are written; the others are counts.
WRITTEN_AS = {
    "money": ["spend", "revenue", "gross_profit", "cpc", "cpl", "cac", "aov", "budget", "contribution"],
    "percent": ["ctr", "click_to_lead_rate", "lead_qualification_rate", "lead_to_conversion_rate", "roi", "budget_utilisation", "gross_margin_pct", "rate", "share", "change"],
    "ratio": ["roas", "break_even_roas", "profit_per_rupee"],
}
_ABBREVIATED = ["ctr", "cpc", "cpl", "cac", "roas", "aov", "roi"]
STANDOUT = ["kind", "measure", "entity", "value", "beside"]


def facts(table: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """entity, measure, value: known values of known entities."""
    named = table.where(F.col(key).isNotNull() & (F.col(key) != REMAINDER)).select(F.col(key).alias("entity"), *(F.col(m).cast("double").alias(m) for m in measures))
    return named.unpivot(["entity"], measures, "measure", "value").where("value is not null")


def _rows(df: DataFrame, kind: Column | str, beside: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(kind.alias("kind"), F.col("measure"), F.col("entity"), F.col("value").cast("double").alias("value"), (F.lit(None) if beside is None else beside).cast("double").alias("beside"))


def extremes(found: DataFrame, reference: dict[str, float] | None = None) -> DataFrame:
    """Both ends of each measure, ties by name: best and worst, or highest and lowest where neither is good. One aggregate."""
    one = F.struct("entity", "value")
    ends = found.groupBy("measure").agg(F.min_by(one, F.struct(-F.col("value"), "entity")).alias("high"), F.min_by(one, F.struct("value", "entity")).alias("low")).where("high.value > low.value")
    sides = ends.select("measure", F.explode(F.array(F.struct(F.lit(True).alias("up"), "high.*"), F.struct(F.lit(False).alias("up"), "low.*"))).alias("s")).select("measure", "s.*")
    good = F.create_map(*(F.lit(x) for m, b in BETTER.items() if b in (UP, DOWN) for x in (m, b == UP)))[F.col("measure")]
    kind = F.when(good.isNull(), F.when(F.col("up"), "highest").otherwise("lowest")).when(good == F.col("up"), "best").otherwise("worst")
    held = F.create_map(*(F.lit(x) for m, v in reference.items() for x in (m, v)))[F.col("measure")] if reference else None
    return _rows(sides, kind, held)


def gap(table: DataFrame, key: str, result: str, base: str = "spend_share", points: float = GAP_POINTS) -> DataFrame:
    """The entity whose share of a result is furthest above its share of spend, by some points at least."""
    both = table.where(F.col(key).isNotNull() & (F.col(key) != REMAINDER)).select(F.col(key).alias("entity"), F.lit(result).alias("measure"), F.col(result).alias("value"), F.col(base).alias("other"))
    best = both.where("value - other is not null").agg(F.min_by(F.struct("*"), F.struct(F.col("other") - F.col("value"), "entity")).alias("r")).select("r.*")
    return _rows(best.where(F.col("value") - F.col("other") >= points), "gap", F.col("other"))


def changes(df: DataFrame, present: set[str], days: int = TREND_DAYS, least: float = FLAT_PCT) -> DataFrame:
    """Every measure whose last days differ from as many days before by more than ``least`` per cent."""
    last = df.agg(F.max("date").alias("last"), F.date_sub(F.max("date"), days - 1).alias("first")).first()
    if last["last"] is None:
        return df.sparkSession.createDataFrame([], "kind string, measure string, entity string, value double, beside double")
    moved = period_comparison(df, str(last["first"]), str(last["last"]), present).where(F.abs("pct_change") > least)
    return _rows(moved.select(F.col("kpi").alias("measure"), F.lit(None).cast("string").alias("entity"), F.col("pct_change").alias("value"), F.lit(days).alias("days")), "change", F.col("days"))


def narrowest(funnel: DataFrame) -> DataFrame:
    """The step that the fewest pass; clicks on an impression aren't looked at, revenue isn't a step."""
    steps = funnel.where("stage != 'revenue'").withColumn("from", F.lag("stage").over(Window.partitionBy().orderBy("place")))  # a few rows
    low = steps.where("rate is not null and stage != 'clicks'").agg(F.min_by(F.struct("stage", "from", "rate"), F.struct("rate", "place")).alias("r")).where("r is not null")
    return _rows(low.select(F.lit("rate").alias("measure"), F.concat("r.from", F.lit(" to "), "r.stage").alias("entity"), F.col("r.rate").alias("value")), "step")


def pace(pacing: DataFrame, key: str, projected: str, budget: str, off_pct: float = FLAT_PCT) -> DataFrame:
    """Entities that are heading for more or less than their budget, by more than some per cent."""
    use = F.try_divide(F.col(projected), F.col(budget)) * 100
    named = pacing.select(F.col(key).alias("entity"), F.lit("budget_utilisation").alias("measure"), use.alias("value"))
    return _rows(named.where(F.abs(F.col("value") - 100) > off_pct), "pace", F.lit(100))


def outlook(forecast: DataFrame, recent: DataFrame) -> DataFrame:
    """What is expected in all against what came in as many weeks before. Both: measure, value."""
    ahead = forecast.groupBy("measure").agg(F.sum("value").alias("value"))
    behind = recent.groupBy("measure").agg(F.sum("value").alias("other"))
    return _rows(ahead.join(behind, "measure").withColumn("entity", F.lit(None).cast("string")), "outlook", F.col("other"))


def losses(profit: DataFrame, key: str) -> DataFrame:
    """Entities that cost more than they earn."""
    return _rows(profit.where("contribution < 0").select(F.col(key).alias("entity"), F.lit("contribution").alias("measure"), F.col("contribution").alias("value")), "loss")


def _written(value: Column) -> Column:
    out = X.value_text(value, "count")
    for kind, names in WRITTEN_AS.items():
        out = F.when(F.col("measure").isin(names) | F.lit(kind == "percent") & F.col("measure").endswith("_share"), X.value_text(value, kind)).otherwise(out)
    return out


def worded(found: DataFrame) -> DataFrame:
    """The rows with a line of text."""
    plain = F.regexp_replace(F.regexp_replace("measure", "_share$", ""), "_", " ")
    name = F.when(F.col("measure").isin(_ABBREVIATED), F.upper("measure")).otherwise(plain)
    value, beside = _written(F.col("value")), _written(F.col("beside"))
    against = F.when(F.col("beside").isNotNull(), F.concat(F.lit(" (all: "), beside, F.lit(")"))).otherwise("")
    size = X.value_text(F.abs("value"), "percent")
    lines = {
        "best": F.concat(F.lit("ahead on "), name, F.lit(": "), F.col("entity"), F.lit(", "), value, against),
        "worst": F.concat(F.lit("behind on "), name, F.lit(": "), F.col("entity"), F.lit(", "), value, against),
        "highest": F.concat(F.lit("most "), name, F.lit(": "), F.col("entity"), F.lit(", "), value),
        "lowest": F.concat(F.lit("least "), name, F.lit(": "), F.col("entity"), F.lit(", "), value),
        "gap": F.concat(F.col("entity"), F.lit(": "), value, F.lit(" of all "), name, F.lit(" from "), beside, F.lit(" of the money")),
        "change": F.concat(name, F.when(F.col("value") > 0, " up ").otherwise(" down "), size, F.lit(" within "), F.col("beside").cast("int").cast("string"), F.lit(" days")),
        "step": F.concat(F.col("entity"), F.lit(": no more than "), value, F.lit(" get through")),
        "pace": F.concat(F.col("entity"), F.lit(": on course for "), value, F.lit(" of the budget")),
        "outlook": F.concat(name, F.lit(": "), value, F.lit(" expected, after "), beside),
        "loss": F.concat(F.col("entity"), F.lit(": "), X.value_text(F.abs("value"), "money"), F.lit(" lost")),
    }
    text = F.lit(None).cast("string")
    for kind, line in lines.items():
        text = F.when(F.col("kind") == kind, line).otherwise(text)
    return found.withColumn("line", text)
