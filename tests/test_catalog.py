"""Every catalogued query against its DuckDB oracle, on the smallest test tables."""

import os

import duckdb
import pytest

from blockflow.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def canon(v):
    if isinstance(v, list | tuple):
        return tuple(map(canon, v))
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(canon(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


def test_counters_gather_beside_an_action(spark):
    from blockflow.operators import decisions as D

    rows, seen = D.observed(D.intra_in_inter(spark, DATA))
    got = rows.collect()
    assert seen.get["macroblocks"] == len(got) and seen.get["intra16"] == sum(r.use_i16 for r in got) and seen.get["intra4"] == sum(r.use_i4 for r in got)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
