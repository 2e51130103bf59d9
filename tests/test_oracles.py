"""Every registered query that has an oracle against DuckDB on the same tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_agrees_with_its_oracle(name, spark, sf_dir, duck):
    df = entry_point.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    got = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(row[i]) for i in at) for row in got.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
