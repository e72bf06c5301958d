"""Every core query against its SQL on the smallest tables, and the contract of the entry module."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from helixspark.plans import registry


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, sql, name):
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(tuple(norm(v) for v in r) for r in df.select(columns).collect())
    result = sql.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
