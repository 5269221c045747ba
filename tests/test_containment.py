"""Containment by bitmaps against sets."""

import random

import pytest

from tallyspark.operators import containment as CO


@pytest.mark.parametrize(("members", "bits"), [(12, 1 << 15), (400, 1 << 15)])
def test_contained_sets(spark, members, bits):
    rng = random.Random(members)
    names = [f"m{i}" for i in range(members)]
    outer = {f"o{i}": set(rng.sample(names, rng.randint(1, members))) for i in range(12)} | {"all": set(names)}
    inner = {f"i{i}": set(rng.sample(sorted(rng.choice(list(outer.values()))), 1)) for i in range(6)} | {f"j{i}": set(rng.sample(names, rng.randint(1, 5))) for i in range(12)}
    inner |= {"same": set(outer["o3"]), "foreign": {names[0], "elsewhere"}}
    rows = lambda sets: [(k, m) for k, own in sets.items() for m in own]
    a, b = rows(inner), rows(outer)
    a += a[:5] + [("i0", None), (None, "m1")]
    got = CO.contained(spark.createDataFrame(a, "id string, member string"), spark.createDataFrame(b, "id string, member string"))
    want = {(k, o, len(own)) for k, own in inner.items() for o, theirs in outer.items() if own <= theirs}
    assert {tuple(r) for r in got.collect()} == want


def test_many_stretches(spark):
    """Sets over more codes than one bitmap has bits."""
    n = 3 * CO.BITS + 7
    every = spark.range(n).selectExpr("'all' AS id", "id AS member")
    inner = every.selectExpr("CASE WHEN member % 7 = 0 THEN 'sevenths' ELSE 'others' END AS id", "member").unionByName(spark.range(5).selectExpr("'beyond' AS id", f"id + {n - 3} AS member"))
    got = {tuple(r) for r in CO.contained(inner, every).collect()}
    assert got == {("sevenths", "all", -(-n // 7)), ("others", "all", n - -(-n // 7))}


def test_dense_codes(spark):
    got = sorted((r["member"], r["code"]) for r in CO.dense_codes(spark.range(0, 1000, 3).selectExpr("id % 500 AS member")).collect())
    members = sorted({i % 500 for i in range(0, 1000, 3)})
    assert got == list(zip(members, range(len(members)), strict=True))


def test_empty(spark):
    none = spark.createDataFrame([], "id string, member string")
    assert CO.contained(none, none).collect() == []
