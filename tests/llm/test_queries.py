"""Registered queries against their SQL on the smallest tables, and their columns."""

import os

import pytest

from blockflow.llm import queries
from tests.test_catalog import DATA, duck, rows  # noqa: F401  the fixture

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, DATA)
    got = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())
