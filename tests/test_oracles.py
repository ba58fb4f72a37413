"""Every query with SQL gives the SQL's rows on the smallest tables; the others run and give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
HERE = [q for q in QUERIES if not q.startswith("op") and q != "pipeline"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows_of(df, names):
    return sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


@pytest.mark.parametrize("name", HERE)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = rows_of(df, names)
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    own = [c[0] for c in found.description]
    assert sorted(own) == names
    assert got == sorted(repr(tuple(plain(r[own.index(c)]) for c in names)) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
