"""Queries over delimited files that are larger than what may be uploaded."""

import pytest
from compare import assert_same, connect

from tallyspark.plans import queries as plans
from tallyspark.sources import files as FILES

ROWS, LETTERS = 900, 65_000


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """Customers with long segments, 59 MB in all."""
    folder = tmp_path_factory.mktemp("long")
    path = f"{folder}/customer.parquet"
    connect(str(folder)).execute(f"COPY (SELECT i AS c_custkey, 'Customer \"' || i || '\"' AS c_name, CAST(i % 25 AS INTEGER) AS c_nationkey, i / 4 AS c_acctbal, repeat(chr(97 + CAST(i % 26 AS INTEGER)), {LETTERS - 1}) || i AS c_mktsegment FROM range({ROWS}) t(i)) TO '{path}' (FORMAT parquet)")
    assert ROWS * LETTERS > FILES.MOST_MB << 20
    return str(folder)


@pytest.mark.parametrize("name", ["src_01", "src_03", "src_04", "src_05", "src_08", "src_09", "src_10"])
def test_table_beyond_the_upload_limit(spark, long_dir, name):
    assert_same(plans.QUERIES[name](spark, long_dir).toPandas(), connect(long_dir).execute(plans.ORACLE_SQL[name]).df())
