"""Every registered query against its DuckDB counterpart at the smallest scale."""

import math

import duckdb
import pytest

from signalframe.queries import ORACLES, QUERIES

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows(columns, cur.fetchall())
        assert len(got) == len(want)
        assert all(g == w or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(g, w, strict=True)) for g, w in zip(got, want, strict=True))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
