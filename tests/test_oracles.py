"""Every registered question-bank query against its DuckDB form on the smallest tables."""

import os

import duckdb
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def normal(rows):
    return sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", [*registry.QUERIES])
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = normal(df.select(*columns).collect())
    if name in registry.ORACLE:
        found = duck.sql(registry.ORACLE[name])
        assert sorted(found.columns) == columns
        assert rows == normal(found.select(*[f'"{c}"' for c in columns]).fetchall())
    else:
        assert rows
