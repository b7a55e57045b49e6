"""Every query against its SQL, with sorted columns and rounded doubles."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from triagelake.plans import queries, sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_spark_equals_sql(spark, sf, duck, name):
    want = duck.sql(sql.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda table, names: Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in table)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_queries_without_sql_have_rows(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["lane", "n"] and sum(r.n for r in out.collect()) == 1500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
