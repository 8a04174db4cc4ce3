"""Every query against its SQL, run by another engine on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith("op")])
def test_query_equals_sql(name, spark, other):
    got = entry.queries()[name](spark, SF)
    want = other.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_names():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {(r.series, r.period) for r in rows} >= {("model", "overall"), ("benchmark", "overall"), ("model", "train")}


def test_grid_queries(spark):
    ranks = entry.queries()["grid_rank"](spark, SF).orderBy("rank").collect()
    known = [r.train_sharpe for r in ranks if r.train_sharpe is not None]
    assert known == sorted(known, reverse=True) and len(ranks) == 6
