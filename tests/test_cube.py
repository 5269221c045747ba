"""The cube's answers against the rows, and what its plans read."""

import random

import pytest

from tallyspark.operators.group import group_kpis
from tallyspark.sources.cube import Cube

FIELDS = "date string, channel string, region string, spend double, impressions long, clicks long, leads long, conversions long, revenue double, margin double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    maybe = lambda v: None if rng.random() < 0.2 else v
    made = [(f"2024-0{rng.randint(1, 3)}-{rng.randint(1, 28):02d}", maybe(rng.choice("abc")), rng.choice(["x", "y"]), maybe(rng.uniform(0, 90)), maybe(rng.randint(0, 900)), maybe(rng.randint(0, 50)), maybe(rng.randint(0, 9)), maybe(rng.randint(0, 4)), maybe(rng.uniform(0, 300)), maybe(rng.choice([0.4, 35.0]))) for _ in range(600)]
    df = spark.createDataFrame(made, FIELDS)
    return df.withColumn("date", df["date"].cast("date"))


def same(a, b, keys):
    assert sorted(a.columns) == sorted(b.columns)
    x, y = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (a, b))
    assert set(x) == set(y)
    for k in x:
        for c in a.columns:
            assert (x[k][c] is None) == (y[k][c] is None) and (x[k][c] == y[k][c] or x[k][c] == pytest.approx(y[k][c])), (k, c)


@pytest.fixture(scope="module")
def cube(spark, rows, tmp_path_factory):
    cube = Cube(spark, f"file://{tmp_path_factory.mktemp('cube')}")
    cube.build("r", rows.where("date < DATE '2024-02-10'"), ["channel", "region"], [["channel"], []])
    cube.add("r", rows.where("date >= DATE '2024-02-10'"))
    cube.build("other", rows.limit(3), ["channel"])
    return cube


def test_groups_and_filters(rows, cube):
    same(cube.kpis("r", ["channel"]), group_kpis(rows, "channel"), ["channel"])
    same(cube.kpis("r", ["region"], {"channel": ["a", "c"]}), group_kpis(rows.where("channel in ('a', 'c')"), "region"), ["region"])
    view = rows.where("date between '2024-01-20' and '2024-02-20'")
    same(cube.kpis("r", ["channel", "region"], {"region": []}, "2024-01-20", "2024-02-20"), group_kpis(view, ["channel", "region"]), ["channel", "region"])
    assert cube.kpis("r", ["month"]).count() == 3 and cube.kpis("r", []).first()["rows"] == 600
    assert cube.kpis("r", ["channel"], {"channel": ["none"]}).count() == 0


def test_smallest_rollup_that_answers(cube):
    assert cube.choose("r", set())["dims"] == [] and cube.choose("r", {"channel"})["dims"] == ["channel"]
    assert set(cube.choose("r", {"region"})["dims"]) == {"channel", "region"}
    with pytest.raises(ValueError, match="gender"):
        cube.kpis("r", ["gender"])


def test_only_the_cube_is_read(cube):
    files = cube.kpis("r", ["channel"], start="2024-02-01").inputFiles()
    assert files and all("/states/run_id=r/channel/" in f for f in files)
