"""Each query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from lattica.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(round(v[k], 9) if isinstance(v[k], float) else v[k] for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = c.sql(ORACLES[name])
    df = QUERIES[name](spark, DATA)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
