"""Every core query that has SQL, against it."""

import datetime
import decimal
import math
import os

import duckdb
import pandas as pd
import pytest

from weftlens.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        path = os.path.join(sf_dir, f)
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 1e-6 * max(1, abs(a), abs(b))
    return a == b


def test_every_query_has_a_callable():
    assert set(SQL) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted(([plain(x) for x in r] for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=key)
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for r, s in zip(got, want) for x, y in zip(r, s))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    assert df.columns and df.count() >= 0
