"""Interval joins against all pairs, and attachment in waves against a walk from incident to incident."""

import datetime as dt
import random
from collections import Counter

import pytest

from tallyspark.operators import incidents as I
from tallyspark.operators.intervals import overlapping

DAY0 = dt.date(2024, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("slack", [0, 1, 5])
def test_overlaps_are_all_pairs(spark, seed, slack):
    rng = random.Random(seed)
    lengths = [0, 0, 1, 2, 6, 30, 200, 5000, 90_000]

    def made(n):
        rows = []
        for i in range(n):
            a = rng.choice([rng.randint(-20_000, 20_000), rng.randint(0, 100)])
            rows.append((i, day(a), day(a + rng.choice(lengths))))
        return rows + rows[:2] + [(n, None, day(3)), (n + 1, day(3), None), (n + 2, day(9), day(3))]

    left, right = made(70), made(60)
    schema = "id long, start date, end date"
    got = Counter((r["a_id"], r["b_id"]) for r in overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), slack=slack).collect())
    known = lambda rows: [r for r in rows if r[1] is not None and r[2] is not None and r[1] <= r[2]]
    gap = dt.timedelta(days=slack)
    assert got == Counter((a[0], b[0]) for a in known(left) for b in known(right) if a[1] <= b[2] + gap and b[1] <= a[2] + gap)


def test_no_nested_loop(spark):
    df = spark.createDataFrame([(1, day(0), day(9))], "id long, start date, end date")
    plan = overlapping(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, ((_level") + plan.count("Join Inner, (((") >= 2 and "Cartesian" not in plan


def walk(rows, own, parts):
    """Incidents one after the other: the rule as it is told."""
    rows = sorted(rows, key=lambda r: (r[3], r[0]))
    parent = {r[0]: None for r in rows}
    gap = dt.timedelta(days=1)
    for kind in I.TAKERS:
        for number, own_kind, entity, start, end in rows:
            if own_kind != kind or parent[number] is not None:
                continue
            mine = own.get((kind, entity), set())
            fits = lambda r: r[0] != number and parent[r[0]] is None and start <= r[4] + gap and r[3] <= end + gap and own.get(r[1:3]) and own[r[1:3]] <= mine  # noqa: B023, E731
            taken = [r for r in rows if fits(r) and (r[1] != "outage" if kind == "outage" else r[1] == "campaign")]
            if kind != "outage" and len({r[2] for r in taken}) < parts:
                if taken:
                    parent[number] = taken[0][0]
                taken = []
            for r in taken:
                parent[r[0]] = number
    return parent


@pytest.mark.parametrize("seed", range(3))
def test_waves_are_the_walk(spark, seed):
    rng = random.Random(seed)
    campaigns = [f"c{i}" for i in range(9)]
    own = {("campaign", c): {c} for c in campaigns[:8]}
    own |= {(k, f"{k}{i}"): set(rng.sample(campaigns, rng.randint(0, 7))) for k in I.TAKERS for i in range(4)}
    rows = []
    for n in range(90):
        kind, entity = rng.choice([*own, ("campaign", "unknown"), ("campaign", "c1")])
        a = rng.randint(0, 60)
        rows.append((n, kind, entity, day(a), day(a + rng.randint(0, 12))))
    incidents = spark.createDataFrame(rows, "number long, entity_type string, entity string, start date, end date")
    members = spark.createDataFrame([(k, e, sorted(c)) for (k, e), c in own.items()], "entity_type string, entity string, campaigns array<string>")
    got = I.attach(incidents, members)
    assert got.columns[-1] == "parent"
    assert {r["number"]: r["parent"] for r in got.collect()} == walk(rows, own, 2)


def test_no_incidents(spark):
    none = spark.createDataFrame([], "number long, entity_type string, entity string, start date, end date")
    assert I.attach(none, spark.createDataFrame([], "entity_type string, entity string, campaigns array<string>")).collect() == []
