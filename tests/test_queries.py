"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point

duckdb = pytest.importorskip("duckdb")
CORE = {}
for _m in entry_point._CORE:
    import importlib

    CORE |= importlib.import_module(_m).QUERIES
SQL = {k: v for k, v in entry_point.oracle_sql().items() if k in CORE}


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small_dir}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, small_dir, name):
    df = CORE[name](spark, small_dir)
    cols = sorted(df.columns)
    got = sorted((repr(tuple(norm(r[c]) for c in cols)) for r in df.collect()))
    con.execute(SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in con.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, small_dir, name):
    assert CORE[name](spark, small_dir).count() >= 0


def test_entry(spark, small_dir):
    assert entry_point.entry(spark).count() > 0
