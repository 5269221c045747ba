"""Raw text tables to clean typed ones, with a log of every change.

The rules for single cells are a table (``rules``), held against all cells of a row in one pass. Rules over
several cells or rows follow: stages, outliers. Log entries collect in an array, which is exploded once
at the end. The raw rows are written once with their digests, the parsed rows once, since several steps
read them. Rows are not shuffled: of duplicates only digests are, and the few repeated rows are taken
out by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.schema import FIELDS
from tallyspark.sources.shared import new_folder

from .labels import ALIASES, SIMILARITY, relabelled
from .rules import KEY, LOG, RULES, Rule, applied, with_cells

# Fixed pairs: the first stage can't exceed the second.
FUNNEL_RULES = [("clicks", "impressions"), ("reach", "impressions"), ("leads", "clicks"), ("qualified_leads", "leads")]
OUTLIER_ROWS, OUTLIER_IQR, OUTLIER_LEADS = 20, 3.0, 5
#: A column with more spellings to change gets them by a join; with fewer, they are in a map. Both give the same.
MOST_IN_MAP = 500


def _entry(column: str, original: Column, cleaned: Column, action: str, reason: str, severity: str) -> Column:
    return F.struct(F.lit(column).alias("column"), original.cast("string").alias("original"), cleaned.cast("string").alias("cleaned"), F.lit(action).alias("action"), F.lit(reason).alias("reason"), F.lit(severity).alias("severity"))


def _noted(df: DataFrame, *cases: tuple[Column, Column]) -> DataFrame:
    """df with one more array of log entries, of the cases whose condition holds."""
    entries = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), e) for c, e in cases)), lambda x: x.isNotNull())
    return df.withColumn(f"_log_{sum(c.startswith('_log_') for c in df.columns)}", entries)


def _flagged(df: DataFrame, condition: Column, flag: str) -> DataFrame:
    return df.withColumn(f"_flag_{sum(c.startswith('_flag_') for c in df.columns)}", F.when(F.coalesce(condition, F.lit(False)), F.lit(flag)))


def _gathered(df: DataFrame) -> DataFrame:
    """df with the single flags and arrays added to dq_flags and _log."""
    flags, logs = ([c for c in df.columns if c.startswith(p)] for p in ("_flag_", "_log_"))
    none = {"dq_flags": F.array().cast("array<string>"), "_log": F.array().cast(LOG)}
    before = {c: F.col(c) if c in df.columns else none[c] for c in none}
    more = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else none["dq_flags"]
    every = {"dq_flags": F.concat(before["dq_flags"], more), "_log": F.flatten(F.array(before["_log"], *logs))}
    return df.select(*(c for c in df.columns if c not in (*flags, *logs, *every)), *(v.alias(c) for c, v in every.items()))


def _cells(columns: list[str]) -> list[Column]:
    """Columns by names that may hold dots and spaces."""
    return [F.col(f"`{c}`") for c in columns]


def remove_summary_rows(raw: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without totals, and the rows that were totals (any cell begins like one)."""
    total = F.exists(F.array(*_cells(columns)), X.is_summary)
    return raw.where(~total), raw.where(total)


def row_digest(columns: list[str]) -> Column:
    """Equal for rows that are equal in all columns, NULLs too."""
    return F.sha2(F.to_json(F.struct(*_cells(columns)), {"ignoreNullFields": "false"}), 256)


def repeated_rows(raw: DataFrame, columns: list[str]) -> DataFrame:
    """source_row, first_row: rows that are equal in all columns (NULLs too) to an earlier one. Only digests are shuffled."""
    return repeats_of(raw.select("source_row", row_digest(columns).alias("_key")))


def repeats_of(keyed: DataFrame) -> DataFrame:
    """The same for rows (source_row, _key)."""
    first = keyed.groupBy("_key").agg(F.min("source_row").alias("first_row"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(first, "_key").where("source_row != first_row").select("source_row", "first_row")


def select_and_rename(raw: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Canonical columns from source columns, and the names of those left out."""
    keep = [F.col(f"`{source}`").alias(field) for field, source in mapping.items()]
    dropped = [c for c in raw.columns if c not in mapping.values() and c not in ("source_row", "first_row")]
    return raw.select("source_row", *keep), dropped


def survey(df: DataFrame, labels: list[str], dates: list[str] = (), day_first: bool = True, aliases: dict[str, str] = ALIASES) -> tuple[DataFrame | None, dict[str, str]]:
    """(column, v, label: spellings to change; main date format by column) from one grouped count, which is written.

    Texts are counted as they stand, so that each distinct one is tidied or read once.
    """
    spark = df.sparkSession
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("raw")) for c in [*labels, *dates]]
    if not cells:
        return None, {}
    folder = new_folder(spark, "survey")
    counts = df.select(F.explode(F.array(*cells)).alias("e")).select("e.*").groupBy("column", "raw").agg(F.count(F.lit(1)).alias("n"))
    is_date = F.col("column").isin(*dates) if dates else F.lit(False)
    v = F.when(is_date, X.date_format_of(X.date_mark(F.col("raw"), day_first))).when(~X.is_missing(F.col("raw")), X.tidy(F.col("raw")))
    counts = counts.select("column", v.alias("v"), "n").where("v is not null").groupBy("column", "v").agg(F.sum("n").alias("n"))
    counts.write.parquet(f"{folder}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{folder}/counts")
    formats = counts.where(is_date).groupBy("column").agg(F.max_by("v", F.struct("n", "v")).alias("v")) if dates else None
    main = {r["column"]: r["v"] for r in formats.collect()} if dates else {}  # one row a column
    if not labels:
        return None, main
    changes = relabelled(counts.where(F.col("column").isin(*labels)), SIMILARITY, aliases)
    changes.write.parquet(f"{folder}/labels")
    return spark.read.schema(changes.schema).parquet(f"{folder}/labels"), main


def cluster_labels(df: DataFrame, column: str, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """variant, label: the spellings of one column that another one replaces."""
    changes, _ = survey(df.select(column), [column], aliases=aliases)
    return changes.select(F.col("v").alias("variant"), "label")


def standardize(df: DataFrame, changes: DataFrame | None = None, main: dict[str, str] | None = None, day_first: bool = True, rules: list[Rule] = RULES) -> DataFrame:
    """Texts, dates and numbers by the table of rules; df gets dq_flags and _log. changes: spellings to change (column, v, label)."""
    sizes = {r["column"]: r["n"] for r in changes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()} if changes is not None else {}  # one row a column
    few = [c for c, n in sizes.items() if n <= MOST_IN_MAP]
    known = {r["column"] + KEY + r["v"]: r["label"] for r in changes.where(F.col("column").isin(*few)).collect()} if few else {}
    joined = {}
    for c in [c for c in sizes if c not in few]:
        own = changes.where(F.col("column") == c).select(F.col("v").alias("_v"), F.col("label").alias(f"_label_{c}"))
        df = df.join(own, X.tidy(F.col(c)) == F.col("_v"), "left").drop("_v")
        joined[c] = f"_label_{c}"
    labels = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else None
    return applied(with_cells(df, labels, joined, main, day_first), rules).drop(*joined.values())


def drop_impossible(df: DataFrame) -> DataFrame:
    """Stages above the stage before them become NULL; all rules see the values as they were."""
    rules = [(a, b) for a, b in FUNNEL_RULES if a in df.columns and b in df.columns]
    checks = {f"{a}_gt_{b}": (a, F.coalesce(F.col(a) > F.col(b), F.lit(False))) for a, b in rules}
    df = df.select("*", *(v.alias(f"_{k}") for k, (_, v) in checks.items()))
    for flag, (a, _) in checks.items():
        df = _noted(df, (F.col(f"_{flag}"), _entry(a, F.col(a), F.lit(None), "invalid_value_removed", "above the stage before", "error")))
        df = _flagged(df, F.col(f"_{flag}"), flag)
    for flag, (a, _) in checks.items():
        df = df.withColumn(a, F.when(F.col(f"_{flag}"), None).otherwise(F.col(a)))
    return df.drop(*(f"_{k}" for k in checks))


def exact_quantiles(values: DataFrame, probabilities: list[float]) -> DataFrame:
    """key, n, q (array) for rows (key, v): linear interpolation between the exact neighbours in order.

    Distinct values with counts are range-partitioned by (key, v), so one large key spreads over many
    partitions; how many rows lie before each partition is a small table, and only the partitions
    that hold a wanted place are looked into.
    """
    spark = values.sparkSession
    folder = new_folder(spark, "quantiles")
    counted = values.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted.repartitionByRange(n_parts, "key", "v").withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/counts")
    counted = spark.read.parquet(f"{folder}/counts")
    parts = counted.groupBy("key", "part").agg(F.sum("n").alias("size"))
    by_key = Window.partitionBy("key")
    before = F.sum("size").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    parts = parts.select("key", "part", "size", before.alias("before"), F.sum("size").over(by_key).alias("total"))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    wanted = F.array(*(f(place(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)))
    inside = F.filter(wanted, lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("size")))
    parts = parts.select("key", "part", "before", "total", F.array_distinct(inside).alias("places")).where("size(places) > 0")
    rows = counted.join(parts, ["key", "part"])
    upto = F.sum("n").over(Window.partitionBy("key", "part").orderBy("v"))
    rows = rows.withColumn("upto", F.col("before") + upto).withColumn("place", F.explode("places")).where("place < upto and place >= upto - n")
    found = rows.groupBy("key").agg(F.max("total").alias("n"), F.map_from_entries(F.collect_set(F.struct("place", "v"))).alias("at"))

    def value(p: float) -> Column:
        exact = F.lit(p) * (F.col("n") - 1)
        low, high = F.col("at")[F.floor(exact).cast("long")], F.col("at")[F.ceil(exact).cast("long")]
        return low + (high - low) * (exact - F.floor(exact))

    return found.select("key", "n", F.array(*map(value, probabilities)).alias("q"))


def flag_outliers(df: DataFrame) -> DataFrame:
    """Spend and cost per lead far outside their channel's quartiles; values stay. df is read more than once."""
    if "spend" not in df.columns:
        return df
    df = df.withColumn("_channel", F.coalesce(F.col("channel"), F.lit("(none)")) if "channel" in df.columns else F.lit("all"))
    values = {"spend": F.col("spend")}
    if "leads" in df.columns:
        values["cpl"] = F.when(F.col("leads") >= OUTLIER_LEADS, F.try_divide("spend", "leads"))
    each = df.select(F.explode(F.array(*(F.struct(F.struct(F.col("_channel").alias("channel"), F.lit(k).alias("of")).alias("key"), v.cast("double").alias("v")) for k, v in values.items()))).alias("e")).select("e.*")
    limits = exact_quantiles(each, [0.25, 0.75])
    wide = limits.groupBy(F.col("key.channel").alias("_of")).agg(*(F.max(F.when(F.col("key.of") == k, F.struct("n", "q"))).alias(f"_l_{k}") for k in values))
    df = df.join(wide, F.col("_channel") == F.col("_of"), "left")
    for k, v in values.items():
        n, q1, q3 = F.col(f"_l_{k}.n"), F.col(f"_l_{k}.q")[0], F.col(f"_l_{k}.q")[1]
        out = (n >= OUTLIER_ROWS) & (q3 > q1) & ((v > q3 + OUTLIER_IQR * (q3 - q1)) | (v < q1 - OUTLIER_IQR * (q3 - q1)))
        df = _noted(df, (out, _entry(k, F.round(v, 2), F.round(v, 2), "outlier_flagged", "far from the rest of its channel", "info")))
        df = _flagged(df, out, f"outlier_{k}")
    return df.drop("_of", "_channel", *(f"_l_{k}" for k in values))


def add_calendar(df: DataFrame) -> DataFrame:
    """Week, month, quarter and year of the date, if there is one."""
    if "date" not in df.columns:
        return df
    d = F.col("date")
    return df.withColumns({"week_start": F.to_date(F.date_trunc("week", d)), "month": F.date_format(d, "yyyy-MM"), "quarter": F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")), "year": F.year(d)})


def enforce_types(df: DataFrame) -> DataFrame:
    """The canonical types: dates, doubles for measures, an integer year, text for the rest; what does not fit is NULL."""
    kinds = {"date": "date", "number": "double", "money": "double"}
    return df.select(*(F.col(c).try_cast("int" if c == "year" else kinds.get(FIELDS[c].kind, "string")).alias(c) if c in FIELDS else F.col(c) for c in df.columns))


def order_columns(df: DataFrame) -> DataFrame:
    known = [c for c in FIELDS if c in df.columns]
    return df.select(*known, *(c for c in df.columns if c not in known))


def clean(raw: DataFrame, mapping: dict[str, str], day_first: bool = True, remove_duplicates: bool = True, unconfirmed: set[str] = frozenset(), aliases: dict[str, str] = ALIASES, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(clean table, quality log) of a raw text table with source_row. The parsed rows are written by this call; both results read them."""
    if critical := sorted(f for f in unconfirmed if f in FIELDS and FIELDS[f].critical):
        raise ValueError(f"confirm the mapping of {', '.join(critical)} first")
    spark, columns = raw.sparkSession, [c for c in raw.columns if c != "source_row"]
    folder = new_folder(spark, "clean")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    # under names of their own, as raw names may hold any character
    place = {c: f"c{i}" for i, c in enumerate(columns)}
    total = F.exists(F.array(*_cells(columns)), X.is_summary)
    base = written(raw.select("source_row", *(F.col(f"`{c}`").alias(n) for c, n in place.items()), total.alias("_total"), row_digest(columns).alias("_key")), "raw")
    totals, rows = base.where("_total"), base.where("not _total")
    repeats = written(repeats_of(rows.select("source_row", "_key")), "repeats")
    kept = rows.join(repeats, "source_row", "left_anti") if remove_duplicates else rows
    df = kept.select("source_row", *(F.col(place[source]).alias(field) for field, source in mapping.items()))
    dropped = [c for c in columns if c not in mapping.values()]
    names = {k: [c for c in df.columns if c in FIELDS and FIELDS[c].kind == k] for k in ("category", "date")}
    changes, main = survey(df, names["category"], names["date"], day_first, aliases)
    df = _gathered(drop_impossible(standardize(df, changes, main, day_first, rules)))
    df = written(df, "parsed")
    df = _gathered(flag_outliers(df))
    table = order_columns(enforce_types(add_calendar(df)).drop("_log"))
    own = df.select("source_row", F.explode("_log").alias("e")).select("source_row", "e.*")
    none = F.lit(None).cast("string")
    removed = totals.select("source_row", none.alias("column"), none.alias("original"), none.alias("cleaned"), F.lit("summary_row_removed").alias("action"), F.lit("a total, not a record").alias("reason"), F.lit("warning").alias("severity"))
    action = "duplicate_removed" if remove_duplicates else "duplicate_flagged"
    again = repeats.select("source_row", none.alias("column"), none.alias("original"), F.col("first_row").cast("string").alias("cleaned"), F.lit(action).alias("action"), F.lit("equal to an earlier row").alias("reason"), F.lit("warning").alias("severity"))
    log = own.unionByName(removed).unionByName(again)
    if dropped:
        names = F.array(*map(F.lit, dropped))
        one = raw.sparkSession.range(1).select(F.lit(None).cast("long").alias("source_row"), F.explode(names).alias("column"), none.alias("original"), none.alias("cleaned"), F.lit("column_dropped").alias("action"), F.lit("not mapped").alias("reason"), F.lit("info").alias("severity"))
        log = log.unionByName(one)
    return table, log


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("action", "severity").agg(F.count(F.lit(1)).alias("n"))


def limitations(log: DataFrame) -> DataFrame:
    """What the cleaned data can't show: counts by action and column of missing, unreadable and impossible values."""
    return log.where(F.col("action").isin("missing_value", "unreadable_value", "invalid_value_removed", "ambiguous_date")).groupBy("action", "column").agg(F.count(F.lit(1)).alias("n"))


