"""Every query of the reference's operators that SQL can express, against DuckDB."""

import pytest
from compare import assert_same, connect

from tallyspark.plans import queries as plans

#: One name for each SQL text: some operators are the same rows seen from two sides.
NAMES = list({sql: name for name, sql in reversed(plans.ORACLE_SQL.items())}.values())[::-1]
ROWS_ONLY = [n for n in plans.QUERIES if n not in plans.ORACLE_SQL]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, duck, name):
    assert_same(plans.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert "channel" in e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
