"""Cleaning rules as data, held against the cells of a row in one generic pass.

A row's mapped texts become an array of cells (field, kind, raw text, ...). Facts are added to each cell
(is it missing, its number, its date, its label), and every rule of a table is tried on every cell of
its kinds. The plan has one expression for each rule and fact, however many columns a file has, and no
row is shuffled: the cells stay in their row and are folded back by their places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.schema import FIELDS

LOG = "array<struct<column:string,original:string,cleaned:string,action:string,reason:string,severity:string>>"
TEXTS, NUMBERS, DATES = ("category", "id", "text"), ("number", "money"), ("date",)


@dataclass(frozen=True)
class Rule:
    """What is noted about cells of some kinds.

    when, original, cleaned: SQL over a cell ``c``. flag: beginning of a flag that the field's name ends.
    empties: whether the value goes.
    """

    kinds: tuple[str, ...]
    when: str
    action: str
    reason: str
    severity: str
    cleaned: str = "NULL"
    original: str = "c.raw"
    flag: str = ""
    empties: bool = False


#: In the order in which they are noted. Outliers and stages need other rows and cells; they are not here.
RULES = [
    Rule(TEXTS, "c.text <> c.raw AND lower(c.text) <> lower(c.tidy)", "label_standardized", "another spelling of the label", "info", "c.text"),
    Rule(TEXTS, "c.text <> c.raw AND lower(c.text) = lower(c.tidy) AND c.text <> c.tidy", "label_standardized", "another capitalisation of the label", "info", "c.text"),
    Rule(TEXTS, "c.text <> c.raw AND c.text = c.tidy", "whitespace_trimmed", "stray spaces", "info", "c.text"),
    Rule(("category",), "c.gone", "missing_value", "no value", "warning"),
    Rule(DATES, "c.format <> c.main", "date_standardized", "another date format", "info", "c.text"),
    Rule(DATES, "c.ambiguous", "ambiguous_date", "day and month could be exchanged", "warning", "c.text"),
    Rule(NUMBERS, "c.formatted", "text_to_number", "number written as text", "info", "CAST(c.number AS STRING)"),
    Rule((*DATES, *NUMBERS), "c.gone", "missing_value", "no value", "warning"),
    Rule(DATES, "NOT c.gone AND c.mark IS NULL", "unreadable_value", "not a date", "error", flag="unreadable_"),
    Rule(NUMBERS, "NOT c.gone AND c.mark IS NULL", "unreadable_value", "not a number", "error", flag="unreadable_"),
    Rule(NUMBERS, "c.number < 0 AND c.field <> 'margin'", "invalid_value_removed", "negative", "error", original="CAST(c.number AS STRING)", flag="negative_", empties=True),
]


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _holds(rule: Rule) -> str:
    return f"c.kind IN ({', '.join(map(_text, rule.kinds))}) AND coalesce({rule.when}, false)"


def _each(cases: list[str]) -> str:
    """SQL for the cases that aren't NULL, over all cells."""
    return f"flatten(transform(_cells, c -> filter(array({', '.join(cases)}), e -> e IS NOT NULL)))"


def fields_of(columns: list[str]) -> list[str]:
    """The columns that rules look at, in order."""
    return [c for c in columns if c in FIELDS and FIELDS[c].kind in (*TEXTS, *DATES, *NUMBERS) and c != "year"]


def with_cells(df: DataFrame, labels: Column | None = None, joined: dict[str, str] | None = None, main: dict[str, str] | None = None, day_first: bool = True) -> DataFrame:
    """df with _cells: the facts of each field's text.

    labels: a map from field and tidy text (put together by KEY) to another spelling; joined: columns of df that
    hold a field's other spelling; main: the usual date format of a field.
    """
    joined, main = joined or {}, main or {}
    none = F.lit(None).cast("string")
    cells = [F.struct(F.lit(c).alias("field"), F.lit(FIELDS[c].kind).alias("kind"), F.col(c).cast("string").alias("raw"), (F.col(joined[c]) if c in joined else none).alias("other"), F.lit(main.get(c)).cast("string").alias("main")) for c in fields_of(df.columns)]
    kind = lambda x, kinds: x["kind"].isin(*kinds)

    def read(x: Column) -> Column:
        gone = X.is_missing(x["raw"])
        mark = F.when(kind(x, NUMBERS), X.number_mark(x["raw"])).when(kind(x, DATES), X.date_mark(x["raw"], day_first))
        return F.struct(*(x[n].alias(n) for n in ("field", "kind", "raw", "other", "main")), gone.alias("gone"), F.when(kind(x, TEXTS) & ~gone, X.tidy(x["raw"])).alias("tidy"), mark.alias("mark"))

    def told(x: Column) -> Column:
        known = F.coalesce(x["other"], labels[F.concat(x["field"], F.lit(KEY), x["tidy"])], x["tidy"]) if labels is not None else F.coalesce(x["other"], x["tidy"])
        date = kind(x, DATES)
        text = F.when(date, F.substring(x["mark"], 1, 10)).when(kind(x, TEXTS), known)
        number = F.when(kind(x, NUMBERS), X.number_value(x["mark"]))
        return F.struct(
            *(x[n].alias(n) for n in ("field", "kind", "raw", "main", "gone", "tidy", "mark")), text.alias("text"), number.alias("number"),
            F.when(date, X.date_format_of(x["mark"])).alias("format"), F.when(date, X.ambiguous_day(x["mark"])).alias("ambiguous"), F.when(kind(x, NUMBERS), x["mark"].startswith("F")).alias("formatted"),
        )

    return df.withColumn("_cells", F.transform(F.transform(F.array(*cells), read), told) if cells else F.array())


#: Stands between a field and a text in the keys of a map of labels.
KEY = "\u0001"


def applied(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The cells' values in the place of the texts, with dq_flags and _log. df comes from with_cells."""
    names = fields_of([c for c in df.columns if c != "_cells"])
    if not names:
        return df.drop("_cells").withColumns({"dq_flags": F.array().cast("array<string>"), "_log": F.array().cast(LOG)})
    entry = "named_struct('column', c.field, 'original', {o}, 'cleaned', CAST({c} AS STRING), 'action', {a}, 'reason', {r}, 'severity', {s})"
    notes = [f"CASE WHEN {_holds(r)} THEN {entry.format(o=r.original, c=r.cleaned, a=_text(r.action), r=_text(r.reason), s=_text(r.severity))} END" for r in rules]
    flags = [f"CASE WHEN {_holds(r)} THEN concat({_text(r.flag)}, c.field) END" for r in rules if r.flag]
    empties = " OR ".join(f"({_holds(r)})" for r in rules if r.empties) or "false"
    values = F.expr(f"transform(_cells, c -> CASE WHEN {empties} THEN named_struct('text', CAST(NULL AS STRING), 'number', CAST(NULL AS DOUBLE)) ELSE named_struct('text', c.text, 'number', c.number) END)")
    df = df.select("*", values.alias("_values"), F.expr(_each(flags) if flags else "array()").cast("array<string>").alias("dq_flags"), F.expr(_each(notes)).cast(LOG).alias("_log"))

    def folded(c: str) -> Column:
        cell = F.get("_values", F.lit(names.index(c)))
        kind = FIELDS[c].kind
        return (cell["number"] if kind in NUMBERS else cell["text"].try_cast("date") if kind in DATES else cell["text"]).alias(c)

    return df.select(*(folded(c) if c in names else F.col(f"`{c}`") for c in df.columns if c not in ("_cells", "_values")))
