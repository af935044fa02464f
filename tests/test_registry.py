"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as registry
from checks.compare import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_its_sql():
    assert set(registry.PLANS) <= set(registry.queries()) and set(registry.PLANS) <= set(registry.oracle_sql())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.PLANS))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, DATA, name) is None


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["l_orderkey", "revenue", "o_orderdate", "o_shippriority"] and df.count() == 10
