"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = entry.queries()[name](spark, SMALL)
    rel = db.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = [tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()]
    have = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(have, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
