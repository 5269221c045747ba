"""Spellings of one label, found and joined by Spark whatever their number.

Spellings with one key (lower case, single spaces, known aliases) are one label. A key that is a close
spelling of a more frequent one, with the same digits, is taken for a misspelling of it. Close keys
are candidates of a blocked join, not of all pairs: two keys with a ratio of at least ``similarity``
differ by so few characters that, cut into one piece more than those, one whole piece of the first
stands in the second at nearly the same place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.kpi import label
from tallyspark.sources.shared import new_folder

# Other names of well-known channels and platforms.
ALIASES = {
    "fb": "meta",
    "facebook": "meta",
    "facebook ads": "meta",
    "meta ads": "meta",
    "meta platforms": "meta",
    "fb ads": "meta",
    "google": "google ads",
    "adwords": "google ads",
    "google adwords": "google ads",
    "yt": "youtube",
    "youtube ads": "youtube",
    "linkedin ads": "linkedin",
    "li": "linkedin",
    "ppc": "paid search",
    "sem": "paid search",
    "search": "paid search",
    "social": "paid social",
    "paid socials": "paid social",
    "e-mail": "email",
    "e mail": "email",
    "emailer": "email",
}
# How those are written.
CANONICAL = {
    "meta": "Meta",
    "google ads": "Google Ads",
    "youtube": "YouTube",
    "linkedin": "LinkedIn",
    "paid search": "Paid Search",
    "paid social": "Paid Social",
    "email": "Email",
    "video": "Video",
    "affiliate": "Affiliate",
    "professional network": "Professional Network",
}
#: Columns in which the canonical spellings hold.
KNOWN_IN = ("channel", "platform")
SIMILARITY, LEAST_CHARS = 90.0, 4


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length, in percent."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v)))[key] if values else F.lit(None).cast("string")


def label_key(text: Column, aliases: dict[str, str] = ALIASES) -> Column:
    key = label(text)
    return F.coalesce(lookup(aliases, key), key)


def close_keys(keys: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """column, small, big for rows (column, key, n): the second key is more frequent, ties to the first in order."""
    share = 1 - similarity / 100
    size = F.length("key")
    # a close key is at most (1 + share) / (1 - share) times as long; so many characters can differ then
    differ = F.floor(F.lit(share) * (size + F.floor(size * ((1 + share) / (1 - share)))) + 1e-9).cast("int")
    cut = keys.select("column", "key", "n", F.regexp_replace("key", "[^0-9]", "").alias("digits"), size.alias("size"), differ.alias("differ"))
    cut = cut.withColumn("piece_size", F.greatest(F.lit(1), F.floor(F.col("size") / (F.col("differ") + 1)).cast("int")))
    piece = lambda at: F.struct(F.substring("key", at + 1, F.col("piece_size")).alias("piece"), at.alias("at"))
    pieces = cut.select("column", "digits", "key", "n", "differ", F.explode(F.transform(F.sequence(F.lit(0), F.col("differ")), lambda i: piece(i * F.col("piece_size")))).alias("p"))
    pieces = pieces.select("column", "digits", F.col("key").alias("a"), F.col("n").alias("a_n"), "differ", "p.piece", F.col("p.at").alias("a_at"), F.length("p.piece").alias("of"))
    lengths = [r["of"] for r in pieces.select("of").distinct().collect()]  # a few small numbers
    whole = cut.where(F.lit(bool(lengths))).select("column", "digits", F.col("key").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("of"))
    whole = whole.where(F.length("b") >= F.col("of")).withColumn("b_at", F.explode(F.sequence(F.lit(0), F.length("b") - F.col("of"))))
    whole = whole.withColumn("piece", F.substring("b", F.col("b_at") + 1, F.col("of")))
    met = pieces.join(whole, ["column", "digits", "of", "piece"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("a_at") - F.col("b_at")) <= F.col("differ")))
    met = met.where(F.least(F.length("a"), F.length("b")) * 2 >= (1 - share) * (F.length("a") + F.length("b")) - 1e-9)
    bigger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    pairs = met.select("column", F.when(bigger, F.col("b")).otherwise(F.col("a")).alias("small"), F.when(bigger, F.col("a")).otherwise(F.col("b")).alias("big")).where(F.length("small") >= LEAST_CHARS).distinct()

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(x, y) >= similarity for x, y in zip(a, b, strict=True)], dtype=bool)

    return pairs.where(close("small", "big"))


def merged_keys(keys: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """column, key, head for keys that are misspellings. A head is no misspelling itself.

    A key all of whose more frequent close keys are misspellings is a head; one with a head among them is
    a misspelling of the most frequent such, once no more frequent one is undecided. Each round settles at least one key of every chain, and is
    a written table.
    """
    spark = keys.sparkSession
    folder = new_folder(spark, "labels")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    pairs = written(close_keys(keys, similarity), "pairs")
    sizes = keys.select("column", F.col("key").alias("big"), "n")
    settled = spark.createDataFrame([], "column string, key string, head string")
    waiting, turn = written(pairs.join(sizes, ["column", "big"]), "waiting"), 0
    while not waiting.isEmpty():
        turn += 1
        open_keys = waiting.select("column", F.col("small").alias("big")).distinct().withColumn("open", F.lit(True))
        seen = waiting.join(open_keys, ["column", "big"], "left")
        # what is not open has no more frequent close key left: it is a head
        most = F.min_by(F.struct("big", F.coalesce("open", F.lit(False)).alias("open")), F.struct((-F.col("n")).alias("n"), "big"))
        verdict = seen.groupBy("column", "small").agg(most.alias("most"))
        ready = verdict.where("not most.open").select("column", F.col("small").alias("key"), F.col("most.big").alias("head"))
        ready = written(ready, f"settled-{turn}")
        settled = settled.unionByName(ready)
        gone = ready.select("column", F.col("key").alias("small"))
        left = waiting.join(gone, ["column", "small"], "left_anti").join(gone.withColumnRenamed("small", "big"), ["column", "big"], "left_anti")
        waiting = written(left.select(waiting.columns), f"waiting-{turn}")
    return settled


def relabelled(counts: DataFrame, similarity: float = SIMILARITY, aliases: dict[str, str] = ALIASES, typos: bool = True) -> DataFrame:
    """column, v, label for spellings that change, from rows (column, v, n)."""
    keyed = counts.withColumn("key", label_key(F.col("v"), aliases))
    if typos:
        heads = merged_keys(keyed.groupBy("column", "key").agg(F.sum("n").alias("n")), similarity)
        keyed = keyed.join(heads, ["column", "key"], "left").withColumn("key", F.coalesce("head", "key")).drop("head")
    best = keyed.groupBy("column", "key").agg(F.max_by("v", F.struct("n", "v")).alias("best"))
    known = F.when(F.col("column").isin(*KNOWN_IN), lookup(CANONICAL, F.col("key")))
    best = best.select("column", "key", F.coalesce(known, "best").alias("label"))
    return keyed.join(best, ["column", "key"]).where("v != label").select("column", "v", "label")
