"""Text to typed values, and values to display text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "no value", currency marks, names of date formats.
MISSING = ["", "n/a", "na", "null", "-", "none", "nan", "#n/a"]
CURRENCY = r"(?i)(?:₹|rs\.?|inr|usd|\$|€|£)"
DAY_FIRST = ["DD/MM/YYYY", "DD-MM-YYYY", "DD.MM.YYYY"]
US_FORMAT = "MM/DD/YYYY (US)"
LAKH, CRORE = 1e5, 1e7

_NUMBER = r"^-?(\d+(\.\d+)?|\.\d+)$"


def tidy(text: Column) -> Column:
    """Without blanks at the ends, and with runs of any white space as one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_missing(text: Column) -> Column:
    """NULL, or a token that means no value."""
    return F.coalesce(F.lower(tidy(text)).isin(MISSING), F.lit(True))


def number_mark(text: Column) -> Column:
    """A number's digits after P (plain) or F (formatted), NULL where missing or unreadable.

    One string, so that a plan that uses it more than once keeps it as a column of its own. Reads
    currency words and symbols, Indian and Western grouping, (negatives) and European decimals.
    """
    bare = tidy(text)
    body = F.translate(F.regexp_replace(bare, CURRENCY, ""), " ", "")
    negative = body.startswith("(") & body.endswith(")")
    core = F.when(negative, F.substring(body, F.lit(2), F.length(body) - 2)).otherwise(body)
    sign = F.when(negative, "-").otherwise("")
    european = core.rlike(r"^-?\d{1,3}(\.\d{3})+,\d+$|^-?\d+,\d{1,2}$")
    grouped = core.rlike(r"^-?\d{1,3}(,\d{2,3})+(\.\d+)?$")
    digits = F.when(european, F.translate(F.translate(core, ".", ""), ",", ".")).when(grouped, F.translate(core, ",", "")).otherwise(core)
    used = F.when(bare.rlike(CURRENCY) | european | grouped, "F").otherwise("P")
    formatted = F.when(digits.rlike(_NUMBER), F.regexp_replace(F.concat(used, sign, digits), "--", ""))
    return F.when(bare.rlike(_NUMBER), F.concat(F.lit("P"), bare)).when(~is_missing(text), formatted)


def parse_number(text: Column) -> Column:
    """struct(value, formatted): NULL where missing or unreadable; formatted where marks or separators were used."""
    mark = number_mark(text)
    return F.struct(number_value(mark).alias("value"), F.coalesce(mark.startswith("F"), F.lit(False)).alias("formatted"))


def number_value(mark: Column) -> Column:
    return F.substring(mark, 2, 400).try_cast("double")


_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def date_mark(text: Column, day_first: bool = True) -> Column:
    """yyyy-MM-dd and the name of the first format that fits, NULL where none does.

    What stands between runs of digits and letters tells the form, the runs are the parts. No formatter is tried.
    """

    def split(bare: Column) -> Column:
        return F.struct(bare.alias("bare"), F.regexp_replace(bare, "[0-9]+|[A-Za-z]+", "#").alias("glue"), F.regexp_extract_all(bare, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0)).alias("parts"))

    return F.when(~is_missing(text), once(F.trim(text), lambda bare: once(split(bare), lambda s: _dated(s["bare"], s["glue"], s["parts"], day_first))))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _dated(bare: Column, glue: Column, parts: Column, day_first: bool) -> Column:
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    year = lambda p: p.rlike("^[0-9]{4}$") & (p > "0000")
    short = lambda p: p.rlike("^[0-9]{1,2}$")
    named = lambda p: F.array_position(F.array(*(F.lit(m) for m in _MONTHS)), F.lower(p))
    brief = lambda p: F.array_position(F.array(*(F.lit(m[:3]) for m in _MONTHS)), F.lower(p))

    def made(name: str, y: Column, m: Column, d: Column) -> Column:
        day = F.concat_ws("-", y, m, d).try_cast("date")
        return F.when(year(y) & short(d), F.when(day.isNotNull(), F.concat(day.cast("string"), F.lit(name))))

    def month(name: str, y: Column, m: Column, d: Column) -> Column:
        place = F.when(F.length(m) == 3, brief(m)).otherwise(named(m))
        return F.when(place > 0, made(name, y, place.cast("string"), d))

    numeric = lambda name, y, m, d: F.when(short(m), made(name, y, m, d))
    worded = lambda sep, y, m, d: F.when(F.length(m) == 3, month(sep.format("Mon"), y, m, d)).otherwise(month(sep.format("Month"), y, m, d))
    time = F.element_at(F.split(bare, " "), -1)
    slashes = [numeric("DD/MM/YYYY", c, b, a), numeric(US_FORMAT, c, a, b)]
    return (
        F.when(glue == "#-#-#", F.when(F.length(a) == 4, numeric("YYYY-MM-DD", a, b, c)).otherwise(F.coalesce(numeric("DD-MM-YYYY", c, b, a), worded("D-{}-YYYY", c, b, a))))
        .when(glue == "#-#-# #:#:#", F.when(time.rlike("^([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$"), numeric("YYYY-MM-DD hh:mm:ss", a, b, c)))
        .when(glue == "#/#/#", F.when(F.length(a) == 4, numeric("YYYY/MM/DD", a, b, c)).otherwise(F.coalesce(*(slashes if day_first else slashes[::-1]))))
        .when(glue == "#.#.#", numeric("DD.MM.YYYY", c, b, a))
        .when(glue == "# # #", worded("D {} YYYY", c, b, a))
        .when(glue == "# #, #", worded("{} D, YYYY", c, a, b))
    )


def date_value(mark: Column) -> Column:
    return F.substring(mark, 1, 10).try_cast("date")


def date_format_of(mark: Column) -> Column:
    return F.substring(mark, 11, 40)


def parse_date(text: Column, day_first: bool = True) -> Column:
    """struct(value, format): the first format that fits, day first or month first; NULL where none does."""
    mark = date_mark(text, day_first)
    return F.when(mark.isNotNull(), F.struct(date_value(mark).alias("value"), date_format_of(mark).alias("format")))


def ambiguous_day(mark: Column) -> Column:
    """A day-first reading that a month-first one would also allow."""
    day, month = F.substring(mark, 9, 2), F.substring(mark, 6, 2)
    return F.coalesce(date_format_of(mark).isin(DAY_FIRST) & (day <= "12") & (day != month), F.lit(False))


SUMMARY_ROW = r"(?i)^\s*(grand\s+total|sub[\s-]?total|total)\b"


def is_summary(text: Column) -> Column:
    return F.coalesce(text.rlike(SUMMARY_ROW), F.lit(False))


def header_key(name: Column) -> Column:
    """A header as words: lower case, no bracketed units, % as percent, no currency words, single spaces."""
    text = F.regexp_replace(F.lower(name), r"\([^)]*\)|\[[^\]]*\]", " ")
    text = F.regexp_replace(F.replace(text, F.lit("%"), F.lit(" percent ")), r"[^a-z0-9]+", " ")
    return tidy(F.regexp_replace(text, r"\b(inr|usd|eur|gbp|rs)\b", " "))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


# display

NA = "N/A"


def indian(whole: Column) -> Column:
    """Whole numbers with the last three digits and then pairs set apart."""
    text = F.abs(whole.cast("long")).cast("string")
    return F.concat(F.when(whole < 0, "-").otherwise(""), F.regexp_replace(text, r"(?<=\d)(?=(\d\d)*\d{3}$)", ","))


def _fixed(x: Column, places: int, plus: str = "") -> Column:
    """Ties go to the even digit."""
    return F.format_string(f"%{plus}.{places}f", F.bround(x, places))


def rupees(value: Column, compact: bool = False) -> Column:
    size = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")
    paise = (size < 100) & (size != F.floor(size))
    whole = F.floor(F.bround(size, 2)).cast("long")
    small = F.concat(indian(whole), F.substring(_fixed(F.bround(size, 2) - whole, 2), 2, 3))
    full = F.concat(sign, F.lit("₹"), F.when(paise, small).otherwise(indian(F.bround(size, 0).cast("long"))))
    if compact:
        full = F.when(size >= CRORE, F.concat(sign, F.lit("₹"), _fixed(size / CRORE, 1), F.lit(" Cr"))).when(size >= LAKH, F.concat(sign, F.lit("₹"), _fixed(size / LAKH, 1), F.lit(" L"))).otherwise(full)
    return F.coalesce(full, F.lit(NA))


def count_text(value: Column) -> Column:
    return F.coalesce(indian(F.bround(value, 0).cast("long")), F.lit(NA))


def percent_text(value: Column, signed: bool = False) -> Column:
    """One decimal; two below 1 and three below 0.1, so that small shares don't show as 0."""
    size, plus = F.abs(value), "+" if signed else ""
    text = F.when((size == 0) | (size >= 1), _fixed(value, 1, plus)).when(size < 0.1, _fixed(value, 3, plus)).otherwise(_fixed(value, 2, plus))
    return F.coalesce(F.when(value.isNotNull(), F.concat(text, F.lit("%"))), F.lit(NA))


def ratio_text(value: Column) -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.concat(_fixed(value, 2), F.lit("x"))), F.lit(NA))


def value_text(value: Column, kind: str) -> Column:
    return {"money": rupees, "percent": percent_text, "ratio": ratio_text, "count": count_text}[kind](value)


def date_text(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "d MMM yyyy"), F.lit(NA))


def date_range_text(start: Column, end: Column) -> Column:
    return F.when(start == end, date_text(start)).otherwise(F.concat_ws(" to ", date_text(start), date_text(end)))


def stamp_text(utc: Column) -> Column:
    """A UTC time as India's."""
    return F.concat(F.date_format(F.from_utc_timestamp(utc, "Asia/Kolkata"), "d MMM yyyy, HH:mm"), F.lit(" IST"))


def title(text: Column) -> Column:
    return F.initcap(F.replace(tidy(text), F.lit("_"), F.lit(" ")))


# numbers within a text

UNITS = {"%": 1.0, "x": 1.0, "Cr": CRORE, "crore": CRORE, "L": LAKH, "lakh": LAKH, "lakhs": LAKH}
#: Amounts, words (with dots inside), the point of a number without a whole part, single signs.
_TOKEN = r"\d[\d,]*(?:\.\d+)?|[\p{L}_][\p{L}\p{N}_]*(?:\.[\p{L}\p{N}_]+)*|\.(?=\d)|[^\s]"


def numbers_in(text: Column) -> Column:
    """array of struct(value, kind, grouped, tolerance) of the numbers written in a text; half a unit of the last digit is tolerated.

    A small grammar over tokens: amount = [rupee] [minus] digits [unit]; range = amount sign amount, where the
    rupee of the first and a unit of money after the second hold for both. One fold keeps the amounts so far,
    what the last token was, and whether a range is open.
    """
    start = F.struct(F.array().cast("array<struct<digits:string,money:boolean,minus:boolean,unit:string,second:boolean>>").alias("found"), F.lit("").alias("last"), F.lit(False).alias("rupee"), F.lit(False).alias("open"))

    def step(state: Column, token: Column) -> Column:
        found, last = state["found"], state["last"]
        size = F.size(found)
        amount = token.rlike(r"^\d") & (last != "point")
        unit = (last == "amount") & token.isin(list(UNITS))
        between = (last == "amount") & token.isin("-", "–", "to")
        previous = F.get(found, size - 1)
        new = F.struct(token.alias("digits"), (state["rupee"] | (state["open"] & previous["money"])).alias("money"), (last == "minus").alias("minus"), F.lit("").alias("unit"), F.coalesce(state["open"], F.lit(False)).alias("second"))
        of = lambda x, u: F.struct(x["digits"].alias("digits"), x["money"].alias("money"), x["minus"].alias("minus"), u.alias("unit"), x["second"].alias("second"))
        before = F.get(found, size - 2)
        both = previous["second"] & previous["money"] & (before["unit"] == "") & ~token.isin("%", "x")
        with_unit = F.when(both, F.concat(F.slice(found, 1, size - 2), F.array(of(before, token), of(previous, token)))).otherwise(F.concat(F.slice(found, 1, size - 1), F.array(of(previous, token))))
        kind = F.when(amount, "amount").when(unit, "unit").when(between, "between").when(token == "₹", "rupee").when(token == "-", "minus").when(token == ".", "point").otherwise("")
        return F.struct(
            F.when(amount, F.concat(found, F.array(new))).when(unit, with_unit).otherwise(found).alias("found"),
            kind.alias("last"),
            (kind.isin("rupee") | (state["rupee"] & (kind == "minus"))).alias("rupee"),
            (between | (state["open"] & kind.isin("rupee", "minus"))).alias("open"),
        )

    def one(x: Column) -> Column:
        factor = F.coalesce(F.create_map(*(F.lit(v) for pair in UNITS.items() for v in pair))[x["unit"]], F.lit(1.0))
        kind = F.when(x["money"], "money").when(x["unit"] == "%", "percent").when(x["unit"] == "x", "ratio").otherwise("plain")
        digits = F.rtrim(x["digits"], F.lit(","))
        places = F.when(digits.contains("."), F.length(F.substring_index(digits, ".", -1))).otherwise(0)
        value = F.translate(digits, ",", "").try_cast("double") * factor
        return F.struct(F.when(x["minus"], -value).otherwise(value).alias("value"), kind.alias("kind"), digits.contains(",").alias("grouped"), (F.lit(0.5) * F.pow(F.lit(10.0), -places) * factor).alias("tolerance"))

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.transform(F.aggregate(tokens, start, step, lambda state: state["found"]), one)


def checkable(number: Column) -> Column:
    """Not a small bare count, and not a year; a year has no grouping comma."""
    v = number["value"]
    bare = (number["kind"] == "plain") & (number["tolerance"] <= 0.5)
    year = (v == F.floor(v)) & v.between(1900, 2100) & ~number["grouped"]
    return ~(bare & ((v < 100) | year))


def matches(number: Column, evidence: Column, relative: float = 0.01) -> Column:
    """Some number of the evidence is equal within rounding or one percent."""

    def near(e: Column) -> Column:
        gap = F.abs(F.abs(number["value"]) - F.abs(e["value"]))
        alike = (number["kind"] == e["kind"]) | (number["kind"].isin("plain", "money") & e["kind"].isin("plain", "money"))
        return alike & ((gap <= number["tolerance"] + e["tolerance"] + 1e-9) | (gap <= relative * F.abs(e["value"])))

    return F.exists(evidence, near)
