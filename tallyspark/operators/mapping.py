"""Source columns to canonical fields, from header words, value types and vocabularies.

This is metadata: a file has tens to hundreds of headers, whatever its rows. Only top values, found
by a grouped count, come from the data. The lists below are what is built in; a deployment adds its own
by ``Knowledge``, for example from tables that it keeps.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.schema import FIELDS

from .labels import token_sort_ratio

ACCEPT, SUGGEST = 88.0, 75.0  # fixed thresholds of the fuzzy score

# Words of public ad platforms' export headers, by field. Where two columns of a file claim a field, the earlier word wins.
SYNONYMS = {
    "campaign_name": ["campaign", "campaign name", "ad campaign", "campaign title"],
    "campaign_id": ["campaign id", "campaign code", "campaign number"],
    "campaign_type": ["campaign type", "campaign subtype"],
    "objective": ["objective", "campaign objective", "goal"],
    "channel": ["channel", "marketing channel", "medium", "source medium", "traffic channel"],
    "platform": ["platform", "network", "publisher platform", "ad network", "source"],
    "date": ["date", "day", "reporting date", "report date", "reporting starts", "date start", "start date", "order date"],
    "week": ["week", "week start", "week of", "iso week"],
    "month": ["month", "month name", "reporting month"],
    "quarter": ["quarter", "fiscal quarter"],
    "year": ["year", "fiscal year"],
    "country": ["country", "country name"],
    "state": ["state", "province"],
    "city": ["city", "town"],
    "region": ["region", "zone", "territory"],
    "market": ["market", "geo"],
    "city_tier": ["city tier", "tier"],
    "customer_id": ["customer id", "client id", "user id"],
    "customer_segment": ["customer segment", "segment", "audience segment", "audience"],
    "age": ["age", "age group", "age range"],
    "gender": ["gender", "sex"],
    "customer_type": ["customer type", "client type"],
    "new_returning": ["new returning", "new vs returning"],
    "spend": ["spend", "cost", "amount spent", "ad spend", "media spend", "total spend", "media cost", "advertising cost"],
    "budget": ["budget", "daily budget", "planned spend", "campaign budget"],
    "impressions": ["impressions", "views served", "ad impressions"],
    "reach": ["reach", "unique reach", "people reached"],
    "clicks": ["clicks", "link clicks", "ad clicks", "all clicks"],
    "engagements": ["engagements", "interactions", "post engagements"],
    "views": ["views", "video views"],
    "leads": ["leads", "form leads", "enquiries", "inquiries", "new leads", "lead count"],
    "qualified_leads": ["qualified leads", "mqls", "mql", "sqls", "marketing qualified leads"],
    "opportunities": ["opportunities", "opps"],
    "conversions": ["conversions", "purchases", "deals won", "enrolments"],
    "customers": ["customers", "new customers", "customers acquired"],
    "orders": ["orders", "order count", "transactions"],
    "revenue": ["net revenue", "net sales", "revenue", "total revenue", "conversion value", "purchase value", "sales amount", "deal value", "gross revenue"],
    "average_order_value": ["average order value", "aov"],
    "gross_profit": ["gross profit", "gross margin amount"],
    "margin": ["margin", "margin percent", "gross margin", "profit margin"],
    "product": ["product", "product name", "item"],
    "product_category": ["product category", "category", "course category", "product type"],
    "sku": ["sku", "item id", "product id"],
}
SHORT = {"impr": "impressions", "imps": "impressions", "conv": "conversions", "amt": "amount", "avg": "average", "cust": "customer", "rev": "revenue", "cat": "category", "camp": "campaign", "qty": "quantity", "clks": "clicks", "spnd": "spend", "chnl": "channel"}
FILLERS = {"total", "sum", "of", "the", "all", "no", "number"}

# Fixed rules of what is never taken by itself.
AMBIGUOUS = {
    "results": ["leads", "conversions"],
    "result": ["leads", "conversions"],
    "sales": ["revenue", "conversions", "orders"],
    "amount": ["spend", "revenue"],
    "value": ["revenue", "average_order_value"],
    "total": ["spend", "revenue"],
    "actions": ["leads", "conversions", "engagements"],
    "goal completions": ["leads", "conversions"],
    "key events": ["leads", "conversions"],
    "signups": ["leads", "conversions"],
    "sign ups": ["leads", "conversions"],
    "registrations": ["leads", "conversions"],
}
PROFIT = ["profit", "net profit", "operating profit", "net income", "profit amount", "contribution", "margin amount", "net margin amount"]
NOT_SPEND = [
    "total cost", "total costs", "product cost", "product costs", "cogs", "cost of goods", "cost of goods sold", "operating cost", "operating costs", "operating expense", "operating expenses", "opex", "shipping cost",
    "fulfilment cost", "fulfillment cost", "unit cost", "cost price", "production cost", "landed cost", "total expense", "total expenses",
]
MARKETING_COSTS = ["marketing cost", "marketing costs", "marketing spend", "marketing expense", "marketing expenses", "promotion cost", "promotional cost", "investment"]
DERIVED_WORDS = ["rate", "ratio", "percent", "percentage", "pct", "ctr", "cpc", "cpm", "cpl", "cpa", "cac", "roas", "roi", "aov", "average", "avg", "per", "cvr", "share"]
DERIVED_NAMES = ["frequency", "return on ad spend", "cost conversions"]
#: Fields that are ratios themselves.
RATIO_FIELDS = ["margin"]
# Known columns that have no part in the analysis.
RECOGNISED = [
    "reporting ends", "end date", "stop date", "day of week", "hour", "ad set name", "ad set", "ad name", "ad id", "ad group", "placement", "status", "campaign status", "bid strategy", "currency", "account name", "account id", "keyword",
    "search term", "match type", "landing page", "url", "device", "browser", "language", "sessions", "users", "new users", "page views", "bounces", "opens", "unsubscribes", "subject", "email", "phone", "customer name", "notes", "comment",
    "description", "discount", "coupon code", "refunds", "shipping", "tax", "quantity", "units sold", "order id", "payment method", "brand", "deal stage", "lifetime value", "likes", "comments", "shares", "followers", "app installs",
]
VOCABULARY = {
    "channel": ["email", "paid search", "paid social", "organic search", "organic social", "display", "affiliate", "direct", "referral", "seo", "sms", "video", "ppc", "sem", "influencer"],
    "platform": ["google", "google ads", "meta", "facebook", "instagram", "linkedin", "youtube", "bing", "tiktok", "x", "twitter", "snapchat", "pinterest", "amazon ads"],
    "gender": ["male", "female", "m", "f", "other", "unknown"],
    "new_returning": ["new", "returning", "repeat", "existing"],
}
#: Words of a campaign's objective, and what "Results" count then.
LEAD_WORDS, SALE_WORDS = ["lead", "leads", "leadgen", "lead generation"], ["sale", "sales", "purchase", "purchases", "catalog sales"]
#: These decide only where they are the whole value.
SALE_VALUES = ["conversion", "conversions"]


@dataclass(frozen=True)
class Knowledge:
    """More headers and values than the built-in ones, which come first."""

    synonyms: dict[str, list[str]] = field(default_factory=dict)
    recognised: list[str] = field(default_factory=list)
    derived: list[str] = field(default_factory=list)
    vocabulary: dict[str, list[str]] = field(default_factory=dict)
    short: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Match:
    column: str
    field: str | None
    score: float
    status: str  # mapped, suggested, not_used, derived, unmapped, user, ignored
    reason: str
    candidates: tuple[str, ...] = ()
    place: int = 0  # of the header among its field's words


def words(header: str, short: dict[str, str] | None = None) -> str:
    """A header as plain words: camel case split, units dropped, short forms written out."""
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", header)
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text).lower().replace("%", " percent ")
    parts = [p for p in re.split(r"[^a-z0-9]+", text) if p and p not in ("inr", "usd", "eur", "gbp", "rs", "rupees")]
    return " ".join(((short or {}) | SHORT).get(p, p) for p in parts)


def stripped(key: str) -> str:
    left = [w for w in key.split() if w not in FILLERS]
    return " ".join(left) or key


def fits(field_name: str, kind: str) -> bool:
    """Whether a column of an inferred type may hold a field."""
    want = FIELDS[field_name].kind
    if kind == "empty":
        return True
    if want == "date":
        return kind in ("date", "mixed")
    if want in ("number", "money"):
        return kind in ("number", "money", "mixed")
    return kind in ("text", "mixed", "number", "date")


def vocabulary_field(values: list[str], vocabulary: dict[str, list[str]] | None = None) -> str | None:
    """The field whose known words make up at least 80 % of the top values, at least two of them."""
    keys = [" ".join(v.lower().split()) for v in values]
    for name, known in (vocabulary or VOCABULARY).items():
        hits = sum(k in known for k in keys)
        if keys and hits >= 2 and hits / len(keys) >= 0.8:
            return name
    return None


def objective_meaning(value: Column) -> Column:
    """leads or conversions for an objective, else NULL; words of leads come first."""
    key = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))
    holds = lambda names: key.rlike(r"\b(" + "|".join(names) + r")\b")
    return F.when(holds(LEAD_WORDS), "leads").when(holds(SALE_WORDS) | key.isin(SALE_VALUES), "conversions")


def results_meaning(df: DataFrame, objective: str, by: list[str] = ()) -> DataFrame:
    """meaning (by group): what "Results" count, if all objectives say the same; NULL if they don't or one is unknown."""
    meaning = objective_meaning(F.col(objective))
    given = F.trim(F.col(objective)) != ""
    same = (F.min(meaning) == F.max(meaning)) & (F.count(meaning) == F.count(F.when(given, 1)))
    return df.groupBy(*by).agg(F.when(same, F.min(meaning)).alias("meaning"))


class Mapper:
    """The rules in their order; the first that has an answer gives it."""

    def __init__(self, knowledge: Knowledge | None = None, results: str | None = None):
        more = knowledge or Knowledge()
        self.results, self.short = results, more.short
        listed = [(name, s) for name in FIELDS for s in [*SYNONYMS.get(name, []), *more.synonyms.get(name, [])]]
        self.known: dict[str, tuple[str, int]] = {}
        for place, (name, s) in enumerate(listed):
            self.known.setdefault(words(s, self.short), (name, place))
        self.recognised = {words(s, self.short) for s in [*RECOGNISED, *more.recognised]}
        self.derived = {words(s, self.short) for s in [*DERIVED_NAMES, *more.derived]}
        self.vocabulary = {k: [*VOCABULARY.get(k, []), *more.vocabulary.get(k, [])] for k in {**VOCABULARY, **more.vocabulary}}
        self.rules: list[Callable[..., Match | None]] = [self._ratio, self._cost, self._profit, self._ambiguous, self._exact, self._not_analysed, self._ratio_values, self._without_fillers, self._values, self._close, self._dates]

    def propose(self, column: str, kind: str = "empty", ratio_like: bool = False, values: list[str] | None = None) -> Match:
        key = words(column, self.short)
        for rule in self.rules:
            if found := rule(column, key, kind, ratio_like, values or []):
                return found
        return Match(column, None, 0.0, "unmapped", "unknown header")

    def _ratio(self, column, key, kind, ratio_like, values):
        exact = self.known.get(key, (None,))[0] in RATIO_FIELDS
        if not exact and (key in self.derived or set(key.split()) & set(DERIVED_WORDS)):
            return Match(column, None, 100.0, "derived", "a ratio or average; it is recomputed")

    def _cost(self, column, key, kind, ratio_like, values):
        if key in NOT_SPEND:
            return Match(column, None, 100.0, "not_used", "a cost that is not media spend")
        if key in MARKETING_COSTS:
            return Match(column, None, 0.0, "suggested", "may hold fees or tools; to confirm", ("spend",))

    def _profit(self, column, key, kind, ratio_like, values):
        if key in PROFIT:
            return Match(column, None, 0.0, "suggested", "marketing cost may be taken off already; to confirm", ("gross_profit",))

    def _ambiguous(self, column, key, kind, ratio_like, values):
        if key in ("results", "result") and self.results and fits(self.results, kind):
            return Match(column, self.results, 100.0, "mapped", "all objectives say what results are")
        if key in AMBIGUOUS:
            return Match(column, None, 0.0, "suggested", "can mean several things; to confirm", tuple(f for f in AMBIGUOUS[key] if fits(f, kind)))

    def _exact(self, column, key, kind, ratio_like, values):
        if key in self.known:
            name, place = self.known[key]
            return Match(column, name, 100.0, "mapped", "known header" if fits(name, kind) else "known header; the values look otherwise", (), place)

    def _not_analysed(self, column, key, kind, ratio_like, values):
        if key in self.recognised:
            return Match(column, None, 100.0, "not_used", "known; not part of the analysis")

    def _ratio_values(self, column, key, kind, ratio_like, values):
        if ratio_like:
            return Match(column, None, 100.0, "derived", "looks like a ratio")

    def _without_fillers(self, column, key, kind, ratio_like, values):
        left = stripped(key)
        if left != key and left in self.known and left not in AMBIGUOUS and fits(self.known[left][0], kind):
            return Match(column, self.known[left][0], 95.0, "mapped", "known header but for small words", (), self.known[left][1])

    def _values(self, column, key, kind, ratio_like, values):
        if kind in ("text", "mixed", "empty") and (name := vocabulary_field(values, self.vocabulary)):
            return Match(column, name, 90.0, "mapped", "known values")

    def _close(self, column, key, kind, ratio_like, values):
        best: dict[str, float] = {}
        for s, (name, _) in self.known.items():
            if fits(name, kind):
                best[name] = max(best.get(name, 0.0), token_sort_ratio(key, s))
        ranked = sorted(((score, name) for name, score in best.items() if score >= SUGGEST), key=lambda x: (-x[0], x[1]))[:3]
        if ranked and ranked[0][0] >= ACCEPT:
            return Match(column, ranked[0][1], ranked[0][0], "mapped", "close spelling", tuple(n for _, n in ranked), len(self.known))
        if ranked and kind != "date":
            return Match(column, None, ranked[0][0], "suggested", "similar spelling; to confirm", tuple(n for _, n in ranked))

    def _dates(self, column, key, kind, ratio_like, values):
        if kind == "date":
            return Match(column, None, 0.0, "suggested", "the values are dates; to confirm", ("date",))


def propose(column: str, kind: str = "text", ratio_like: bool = False, values: list[str] | None = None) -> Match:
    return Mapper().propose(column, kind, ratio_like, values)


def map_fields(columns: list[str], kinds: dict[str, str] | None = None, overrides: dict[str, str | None] | None = None, ratio_like: set[str] = frozenset(), values: dict[str, list[str]] | None = None, knowledge: Knowledge | None = None, results: str | None = None) -> dict[str, Match]:
    """One match a column; a field goes to the user's choice, else to the highest score, then to the earlier word of the list, then to the earlier column.

    results: what a "Results" column counts, from ``results_meaning``.
    """
    kinds, overrides, values = kinds or {}, overrides or {}, values or {}
    mapper = Mapper(knowledge, results)

    def chosen(c: str) -> Match:
        return Match(c, overrides[c], 101.0, "user", "chosen") if overrides[c] else Match(c, None, 101.0, "ignored", "skipped")

    found = {c: chosen(c) if c in overrides else mapper.propose(c, kinds.get(c, "empty"), c in ratio_like, values.get(c)) for c in columns}
    owner: dict[str, str] = {}
    for c, m in found.items():
        if m.field and (m.field not in owner or (m.score, -m.place) > (found[owner[m.field]].score, -found[owner[m.field]].place)):
            owner[m.field] = c
    for c, m in found.items():
        if m.field and owner[m.field] != c:
            found[c] = replace(m, field=None, status="not_used", reason=f"{m.field} comes from {owner[m.field]}")
        elif m.candidates == ("spend",) and m.status == "suggested" and "spend" in owner:
            found[c] = replace(m, status="not_used", candidates=(), reason=f"spend comes from {owner['spend']}")
    if "conversions" not in owner and "orders" in owner:
        found[owner["orders"]] = replace(found[owner["orders"]], field="conversions", reason="orders stand in for conversions")
    return found


def active(matches: dict[str, Match]) -> dict[str, str]:
    """field -> source column."""
    return {m.field: c for c, m in matches.items() if m.field and m.status in ("mapped", "user")}


def to_confirm(matches: dict[str, Match]) -> list[str]:
    """Columns that may hold a critical field and wait for the user."""
    return [c for c, m in matches.items() if m.status == "suggested" and any(FIELDS[f].critical for f in m.candidates)]
