"""Secret scan with multipart credential linking, in built-in DataFrame functions only.

Base findings, each kind leftmost and non-overlapping, with failing matches dropped afterwards:
``assign`` (a keyword, a separator and a value of 12 or more characters), ``access`` (AKIA and 18 or
more characters in all) and ``hex`` (16 or more hexadecimal digits). The spans are of whole matches,
in code points, the end exclusive.

Weak candidates are ``id`` (an identifier setting or a short AKIA key), ``secret`` (a token of 20 or
more characters with letters and digits) and ``endpoint`` (a URL or host:port). They are reported only
where complementary parts co-occur: an ``id`` or ``endpoint`` with a secret part, a ``secret`` with an
identifier or endpoint, at most ``scope`` code points apart; base findings count as parts too. A
weak candidate that overlaps a base finding is not reported. The parts of a text are joined as
intervals by running maxima over their sorted ends, which is linear in the parts.

Defined cases: a null text counts as empty and has no spans; equal rows each give a row; rows without
a doc_id are scanned too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WEAK_ACCESS = r"AKIA[A-Z0-9]{8,13}(?![A-Z0-9])"
WEAK_ID = r"""(?i)(?:client|account|access|user|key)[_-]?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}:[0-9]{2,5}"""
KINDS = ["assign", "access", "hex", "id", "secret", "endpoint"]

_SPAN = "struct<start:int,rank:int,end:int>"
#: Findings are gathered in groups of so many, so that a text with very many is not copied once for each.
GROUP = 256


def _spans(text: Column, pattern: str, kind: str, has: Column | None = None, keep=None, group: int = 0) -> Column:
    """array of (start, rank of the kind, end) of all matches, from the lengths of what lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("size"),
        F.transform(tested, keep if keep is not None else lambda _: F.lit(True)).alias("ok"),
    )
    none = F.array().cast(f"array<{_SPAN}>")

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"))
        spans = F.when(F.coalesce(x["ok"], F.lit(False)), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def group_step(state: Column, part: Column) -> Column:
        within = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("spans")), step)
        return F.struct(within["at"].alias("at"), F.concat(state["groups"], F.array(within["spans"])).alias("groups"))

    some = text.rlike(pattern) if has is None else has & text.rlike(pattern)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / GROUP).cast("int")), lambda i: F.slice(sizes, i * GROUP + 1, GROUP))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("groups"))
    return F.when(some, F.aggregate(parts, start, group_step, lambda s: F.flatten(s["groups"]))).otherwise(none)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """key, weak: the weak candidates of a text whose complement lies within scope."""
    rows = parts.where("size(weak) > 0").select("key", F.explode(F.concat("base", "weak")).alias("part"))
    rows = rows.select("key", "part.*", (F.col("part.rank") < 3).alias("is_base"))
    role = F.when(F.col("rank").isin(1, 3), "id").when(F.col("rank") == 5, "endpoint").otherwise("secret")
    rows = rows.withColumn("role", role)
    # each part is an anchor at its start; each weak one also asks at its end, and at scope past its end
    asks = F.when(F.col("is_base"), F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("turn")))).otherwise(
        F.array(
            F.struct(F.col("end").alias("at"), F.lit(0).alias("turn")),
            F.struct(F.col("start").alias("at"), F.lit(1).alias("turn")),
            F.struct((F.col("end") + scope).alias("at"), F.lit(2).alias("turn")),
        )
    )
    events = rows.select("*", F.explode(asks).alias("event")).select("*", "event.*").drop("event")
    so_far = Window.partitionBy("key").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)

    def reach(condition: Column) -> Column:
        return F.coalesce(F.max(F.when((F.col("turn") == 1) & condition, F.col("end"))).over(so_far), F.lit(-1 - 2 * scope))

    seen = events.select(
        "*", reach(F.col("is_base")).alias("base_end"), reach(F.col("role") == "secret").alias("secret_end"), reach(F.col("role") != "secret").alias("other_end")
    )
    asked = seen.where((F.col("turn") != 1) & ~F.col("is_base"))
    other = F.when(F.col("role") == "secret", F.col("other_end")).otherwise(F.col("secret_end"))
    verdict = asked.groupBy("key", "start", "rank", "end").agg(
        F.bool_or((F.col("turn") == 0) & (F.col("base_end") > F.col("start"))).alias("covered"),
        F.bool_or((F.col("turn") == 2) & (other >= F.col("start") - scope)).alias("linked"),
    )
    return verdict.where("linked and not covered").groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def scanned(docs: DataFrame, scratch: Scratch, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_assign, n_access, n_hex, base and linked (arrays of spans) for each row."""
    text = F.col("text")
    long_value = lambda v: F.length(v) >= 12
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    with_colon = text.contains(":")
    found = documents(docs, id_col, text_col).select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        _spans(text, ASSIGN, "assign", keep=long_value, group=2).alias("assign"),
        _spans(text, ACCESS, "access", has=text.contains("AKIA")).alias("access"),
        _spans(text, HEX, "hex").alias("hex"),
        F.concat(
            _spans(text, WEAK_ACCESS, "id", has=text.contains("AKIA")),
            _spans(text, WEAK_ID, "id", has=with_colon | text.contains("=")),
            _spans(text, WEAK_SECRET, "secret", keep=mixed),
            _spans(text, ENDPOINT, "endpoint", has=with_colon),
        ).alias("weak"),
    )
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    parts = found.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("key"), *counts, F.concat(*KINDS[:3]).alias("base"), "weak")
    parts = scratch.table(parts, "parts")
    return parts.join(_linked(parts, scope), "key", "left").withColumn("linked", F.coalesce("linked", F.array().cast(f"array<{_SPAN}>")))


def secret_scan(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row."""
    with Scratch(docs.sparkSession, "secret-scan") as scratch:
        every = scanned(docs, scratch, scope, id_col, text_col)
        return scratch.keep(
            every.select(
                "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                _joined(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"),
            )
        )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span replaced; spans that overlap are replaced together."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= state["at"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    return F.aggregate(F.array_sort(spans), start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with all reported spans replaced in the text; all columns and rows stay."""
    with Scratch(docs.sparkSession, "redact") as scratch:
        found = scanned(docs, scratch, scope, id_col, text_col)
        spans = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.concat("base", "linked").alias("_spans")).where("size(_spans) > 0")
        spans = scratch.keep(spans.dropDuplicates(["_id", "_hash"]), "spans")
    keys = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = keys.join(spans.withColumnRenamed("_id", "_found").withColumnRenamed("_hash", "_found_hash"), F.col("_id").eqNullSafe(F.col("_found")) & (F.col("_hash") == F.col("_found_hash")), "left")
    masked = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(_masked(F.col(text_col), F.col("_spans"), mask))
    return joined.withColumn(text_col, masked).select(docs.columns)
