from __future__ import annotations

import math
import os

import duckdb
import pytest

from ragtables import queries as Q


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df, sql = Q.queries()[name](spark, sf_dir), duck.sql(Q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)


def test_every_query_has_a_twin():
    assert set(Q.queries()) == set(Q.oracle_sql())
