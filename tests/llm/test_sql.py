"""Every query of the package is registered; those with SQL equal it."""

import re

import pytest

import __spark_entry__ as registry
from checks.compare import compare, connect
from quayline.llm.queries import QUERIES
from quayline.llm.sql import SQL
from tests.llm.conftest import DATA


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES) and {*QUERIES, "pipeline"} <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(DATA), DATA, name) is None
