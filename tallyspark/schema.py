"""The canonical fields of campaign data, in the order of a clean table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # date, number, money, category, text, id
    group: str
    critical: bool = False


# Names, kinds and groups that results must share.
_FIELDS = [
    Field("campaign_name", "category", "campaign"),
    Field("campaign_id", "id", "campaign"),
    Field("campaign_type", "category", "campaign"),
    Field("objective", "category", "campaign"),
    Field("channel", "category", "campaign"),
    Field("platform", "category", "campaign"),
    Field("date", "date", "time", critical=True),
    Field("week", "text", "time"),
    Field("month", "text", "time"),
    Field("quarter", "text", "time"),
    Field("year", "number", "time"),
    Field("country", "category", "geography"),
    Field("state", "category", "geography"),
    Field("city", "category", "geography"),
    Field("region", "category", "geography"),
    Field("market", "category", "geography"),
    Field("city_tier", "category", "geography"),
    Field("customer_id", "id", "customer"),
    Field("customer_segment", "category", "customer"),
    Field("age", "category", "customer"),
    Field("gender", "category", "customer"),
    Field("customer_type", "category", "customer"),
    Field("new_returning", "category", "customer"),
    Field("spend", "money", "advertising", critical=True),
    Field("budget", "money", "advertising"),
    Field("impressions", "number", "advertising"),
    Field("reach", "number", "advertising"),
    Field("clicks", "number", "advertising"),
    Field("engagements", "number", "advertising"),
    Field("views", "number", "advertising"),
    Field("leads", "number", "funnel", critical=True),
    Field("qualified_leads", "number", "funnel"),
    Field("opportunities", "number", "funnel"),
    Field("conversions", "number", "funnel", critical=True),
    Field("customers", "number", "funnel"),
    Field("orders", "number", "funnel"),
    Field("revenue", "money", "revenue", critical=True),
    Field("average_order_value", "money", "revenue"),
    Field("gross_profit", "money", "revenue"),
    Field("margin", "number", "revenue"),
    Field("product", "category", "product"),
    Field("product_category", "category", "product"),
    Field("sku", "id", "product"),
]
FIELDS = {f.name: f for f in _FIELDS}
CALENDAR = ["week_start", "month", "quarter", "year"]
NUMERIC = [f.name for f in FIELDS.values() if f.kind in ("number", "money") and f.name != "year"]
#: Summed measures. Reach is not among them: the same person is reached on many days.
ADDITIVE = ["spend", "budget", "impressions", "clicks", "leads", "qualified_leads", "opportunities", "conversions", "customers", "orders", "revenue", "gross_profit"]
FUNNEL_STAGES = ["impressions", "clicks", "leads", "qualified_leads", "opportunities", "conversions"]
DIMENSIONS = ["channel", "platform", "campaign_type", "objective", "region", "country", "state", "city", "city_tier", "customer_segment", "age", "gender", "product_category", "product"]
OUTCOMES = ["revenue", "conversions", "leads", "clicks"]
