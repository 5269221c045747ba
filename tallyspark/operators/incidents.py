"""Incidents: flags with their impact in money, grouped and attached, ranked by impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.anomaly import islands
from tallyspark.sources.shared import new_folder

from .intervals import overlapping


def flag_impact(flags: DataFrame, df: DataFrame, entity: str) -> DataFrame:
    """flags with impact (positive: a loss) from the entity's rows within each flag's period.

    A range join on the entity; flags are few, and rows are first summed to days.
    """
    daily = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("_entity"), F.col("date").alias("_date")).agg(
        *(F.sum(c).alias(f"_{c}") for c in ("spend", "revenue", "clicks", "leads"))
    )
    overall = df.agg(
        F.try_divide(F.sum("spend"), F.sum(F.when(F.col("spend").isNotNull(), F.col("clicks")))).alias("_cpc"),
        F.try_divide(F.sum(F.when(F.col("conversions").isNotNull(), F.col("revenue"))), F.sum(F.when(F.col("revenue").isNotNull(), F.col("conversions")))).alias("_aov"),
    )
    inside = (F.col("entity") == F.col("_entity")) & F.col("_date").between(F.col("start"), F.col("end"))
    sums = flags.join(daily, inside, "left").groupBy(*flags.columns).agg(*(F.sum(f"_{c}").alias(f"_{c}") for c in ("spend", "revenue", "clicks", "leads")))
    rows = sums.join(F.broadcast(overall))  # one row
    weeks = (F.datediff("end", "start") + 1) / 7.0
    base, seen = F.col("baseline"), F.col("value")
    impact = (
        F.when(F.col("metric") == "spend", F.abs(F.col("_spend") - base * weeks))
        .when(F.col("metric") == "revenue", base * weeks - F.col("_revenue"))
        .when(F.col("metric") == "clicks", (base * weeks - F.col("_clicks")) * F.col("_cpc"))
        .when(F.col("metric") == "cpc", (seen - base) * F.col("_clicks"))
        .when(F.col("metric") == "cpl", (seen - base) * F.col("_leads"))
        .when(F.col("metric") == "lead_qualification_rate", F.col("_spend") * (1 - F.try_divide(seen, base)))
        .when(F.col("metric") == "lead_to_conversion_rate", (base - seen) / 100 * F.col("_leads") * F.col("_aov"))
    )
    none = F.col("metric").isin("cpc", "cpl") & (F.col("sentiment") == "check")
    impact = F.when(none, 0.0).otherwise(impact)
    kind = F.when(F.col("metric") == "spend", "loss").when(none, "none").when(impact >= 0, "loss").otherwise("gain")
    return rows.select(*flags.columns, impact.alias("impact"), kind.alias("impact_kind"))


def group_same_entity(flags: DataFrame) -> DataFrame:
    """Flags of an entity that overlap or touch get one incident number."""
    return islands(flags, ["entity_type", "entity"], "start", "end").withColumnRenamed("island", "incident")


def incident_table(grouped: DataFrame) -> DataFrame:
    """One row an incident: its span, flags, metrics, largest effect (never a sum) and rank by it."""
    strongest = F.max_by(F.struct("metric", "sentiment", "severity", "impact_kind", "pct"), F.struct(F.abs("impact"), F.abs("score"), "metric"))
    out = grouped.groupBy("entity_type", "entity", "incident").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_flags"), F.array_join(F.array_sort(F.collect_set("metric")), ", ").alias("metrics"),
        F.max(F.abs("impact")).alias("impact"), strongest.alias("top"), F.max(F.when(F.col("severity") == "high", 1).otherwise(0)).alias("_high"),
    )
    order = Window.orderBy(F.desc_nulls_last("impact"), "start", "entity_type", "entity")
    headline = F.concat_ws(" ", F.col("entity"), F.lit(":"), F.col("top.metric"), F.when(F.col("top.pct") > 0, "above").otherwise("below"), F.lit("baseline"))
    return out.select(
        "entity_type", "entity", "start", "end", "n_flags", "metrics", "impact", F.col("top.metric").alias("top_metric"), F.col("top.sentiment").alias("sentiment"),
        F.when(F.col("_high") == 1, "high").otherwise("medium").alias("severity"), headline.alias("headline"), F.row_number().over(order).alias("rank"),
    )


#: Kinds that take others in, in the order in which they do.
TAKERS = ["outage", "channel", "region"]


def attach(incidents: DataFrame, members: DataFrame, parts: int = 2) -> DataFrame:
    """incidents with parent: which incident of a channel, region or outage each one belongs to.

    incidents: number, entity_type, entity, start, end; members: entity_type, entity, campaigns.
    An outage takes in overlapping incidents whose campaigns are all its own. A channel, then a region,
    with incidents of at least ``parts`` different campaigns of its own in its period takes those in; with
    incidents of one campaign only it belongs to the first of them. Within a kind the earlier one comes first.

    What an incident takes depends only on earlier ones that want the same incidents, or that want itself. So the
    wishes (an edge for each pair that overlaps and fits) are settled in waves: in each, all incidents
    that come first for everything they wish and that no earlier one still wishes act at once.
    """
    spark = incidents.sparkSession
    folder, wave = new_folder(spark, "attach"), 0

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}-{wave}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}-{wave}")

    rows = incidents.join(members, ["entity_type", "entity"], "left").select("number", "entity_type", "entity", "start", "end", "campaigns")
    taker = rows.where(F.col("entity_type").isin(TAKERS))
    kind = F.col("a_entity_type")
    fits = (F.size("b_campaigns") > 0) & (F.size(F.array_except("b_campaigns", "a_campaigns")) == 0) & (F.col("a_number") != F.col("b_number"))
    wanted = F.when(kind == "outage", F.col("b_entity_type") != "outage").otherwise(F.col("b_entity_type") == "campaign")
    turn = F.struct(F.array_position(F.array(*map(F.lit, TAKERS)), kind).alias("kind"), F.col("a_start").alias("start"), F.col("a_number").alias("number"))
    pairs = overlapping(taker, rows.where(F.col("campaigns").isNotNull()), slack=1).where(F.coalesce(fits & wanted, F.lit(False)))
    wishes = written(pairs.select(turn.alias("turn"), F.col("a_number").alias("taker"), (kind == "outage").alias("all"), F.col("b_number").alias("number"), F.col("b_entity").alias("entity"), F.col("b_start").alias("start")), "wishes")
    settled = []
    while not wishes.isEmpty():
        first = wishes.groupBy("number").agg(F.min("turn").alias("first"))
        own = first.select(F.col("number").alias("taker"), F.col("first").alias("before"))
        free = wishes.join(first, "number").groupBy("taker", "turn").agg(F.bool_and(F.col("turn") == F.col("first")).alias("free"))
        ready = written(free.where("free").join(own, "taker", "left").where("before is null or before > turn").select("taker"), "ready")
        acting = wishes.join(ready, "taker")
        plans = acting.groupBy("taker").agg(F.bool_or("all").alias("all"), F.count_distinct("entity").alias("n"), F.min(F.struct("start", "number")).alias("one")).withColumn("takes", F.col("all") | (F.col("n") >= parts))
        given = acting.select("taker", "number").join(plans.where("takes").select("taker"), "taker").select("number", F.col("taker").alias("parent"))
        joins = plans.where("not takes").select(F.col("taker").alias("number"), F.col("one.number").alias("parent"))
        new = written(given.unionByName(joins), "parents")
        settled.append(new)
        gone = new.select("number")
        rest = wishes.join(ready, "taker", "left_anti").join(gone, "number", "left_anti").join(gone.select(F.col("number").alias("taker")), "taker", "left_anti")
        wave += 1
        wishes = written(rest.select(*wishes.columns), "wishes")
    parents = spark.createDataFrame([], "number long, parent long")
    for new in settled:
        parents = parents.unionByName(new)
    return incidents.join(parents, "number", "left")


def members(df: DataFrame, entity: str, campaign: str) -> DataFrame:
    """entity, campaigns: the campaigns that ran under each entity."""
    return df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.array_sort(F.collect_set(campaign)).alias("campaigns"))


def in_view(incidents: DataFrame, start: str, end: str, campaigns: list[str] | None = None) -> DataFrame:
    """Incidents that overlap the dates and, if campaigns are given, share one with them."""
    rows = incidents.where((F.col("start") <= F.lit(end).cast("date")) & (F.col("end") >= F.lit(start).cast("date")))
    return rows if not campaigns else rows.where(F.arrays_overlap("campaigns", F.array(*map(F.lit, campaigns))))


def fix_contradictions(grouped: DataFrame, keys: tuple[str, ...] = ("entity_type", "entity", "incident")) -> DataFrame:
    """Flags in which a cost fell because results collapsed in the same incident are no good news: their sentiment becomes check."""
    collapsed = F.max(F.when(F.col("metric").isin("revenue", "clicks", "lead_to_conversion_rate") & (F.col("pct") < 0), 1).otherwise(0)).over(Window.partitionBy(*keys))
    cheap = F.col("metric").isin("cpc", "cpl") & (F.col("pct") < 0) & (F.col("sentiment") == "positive")
    return grouped.withColumn("sentiment", F.when(cheap & (collapsed == 1), "check").otherwise(F.col("sentiment")))


def match_planted(truth: DataFrame, found: DataFrame) -> DataFrame:
    """truth (entity, start, end) with matched: some found period of the entity overlaps it."""
    f = found.select(F.col("entity").alias("_entity"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    meets = (F.col("entity") == F.col("_entity")) & (F.col("_start") <= F.col("end")) & (F.col("_end") >= F.col("start"))
    hits = truth.join(f, meets, "left_semi").withColumn("matched", F.lit(True))
    return truth.join(hits, truth.columns, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
