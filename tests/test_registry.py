"""Every registered query against its checking SQL on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from logloom.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    cur = oracle.execute(ORACLES[name])
    assert got == ordered([d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_an_oracle_and_is_offered():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


def test_entry(spark):
    df = entry.entry(spark)
    assert "session_key" in df.columns and df.count() > 0
