"""Every query with SQL gives what DuckDB gives."""

import math
import os

import duckdb
import pytest
from conftest import SF

from pulsegrid import queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = rows(queries.QUERIES[name](spark, SF).toArrow())
    want = rows(duck.sql(queries.ORACLE_SQL[name]).to_arrow_table())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
