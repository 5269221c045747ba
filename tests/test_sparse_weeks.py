"""The detector on the weeks near each entity's own against the whole grid of entities and weeks."""

import datetime as dt
import random

import pytest

from tallyspark.operators import anomalies as A

DAY0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """Campaigns that come and go: some run all year, some pause for weeks or months, one runs for three weeks."""
    rng = random.Random(6)
    spans = {"a": [(0, 60)], "b": [(0, 20), (45, 60)], "c": [(0, 9), (14, 30), (50, 60)], "d": [(25, 60)], "e": [(40, 43)], "f": [(0, 60)], "g": [(3, 58)], "h": [(0, 12), (13, 26), (31, 60)]}
    made = []
    for name, own in spans.items():
        for first, last in own:
            for week in range(first, last):
                for day in range(7):
                    if rng.random() > 0.01:
                        level = 3.2 if rng.random() < 0.04 else 1.0
                        spend = 9000 * level * rng.uniform(0.9, 1.1)
                        made.append((DAY0 + dt.timedelta(weeks=week, days=day), name, "xy"[ord(name) % 2], spend, spend * rng.uniform(3, 5), int(spend / 11), int(spend / 300), int(spend / 900), int(spend / 2000)))
    return spark.createDataFrame(made, "date date, campaign_name string, channel string, spend double, revenue double, clicks long, leads long, qualified_leads long, conversions long")


def everywhere(rows, keys, weeks, reach=None):
    return rows.select(*keys).distinct().crossJoin(weeks)


def flags(found):
    return sorted((r["entity"], r["metric"], r["sign"], str(r["start"]), str(r["end"]), round(r["score"], 8), round(r["baseline"], 6)) for r in found.collect())


def test_periods_are_those_of_the_whole_grid(rows, monkeypatch):
    cases = [("campaign_name", "campaign", None), ("channel", "channel", "campaign_name")]
    near = [flags(A.weekly_anomalies(rows, *case)) for case in cases]
    monkeypatch.setattr(A, "near_presence", everywhere)
    whole = [flags(A.weekly_anomalies(rows, *case)) for case in cases]
    assert near == whole and len(near[0]) > 5


def test_stability_where_an_entity_has_rows(rows, monkeypatch):
    def marked():
        own = A.weekly_sums(rows, "channel", ["spend"]).select("entity", "week")
        return sorted((r["entity"], str(r["week"]), r["stable"]) for r in A.stable_composition(rows, "channel", "campaign_name").join(own, ["entity", "week"]).collect())

    near = marked()
    monkeypatch.setattr(A, "near_presence", everywhere)
    assert near == marked() and {s for *_, s in near} == {True, False}


def test_weeks_near_presence(spark):
    week = lambda n: DAY0 + dt.timedelta(weeks=n)
    weeks = spark.createDataFrame([(week(n),) for n in range(40) if n != 7], "week date")
    own = {"a": [0, 1, 12], "b": [20], "c": [39]}
    rows = spark.createDataFrame([(k, week(n)) for k, ns in own.items() for n in ns] + [("a", week(0))], "entity string, week date")
    order = [n for n in range(40) if n != 7]
    place = {n: i for i, n in enumerate(order)}
    want = sorted((k, str(week(order[i]))) for k, ns in own.items() for i in range(len(order)) if any(abs(i - place[n]) <= 3 for n in ns))
    assert sorted((r["entity"], str(r["week"])) for r in A.near_presence(rows, ["entity"], weeks, 3).collect()) == want
    assert "CartesianProduct" not in A.near_presence(rows, ["entity"], weeks)._jdf.queryExecution().executedPlan().toString()
