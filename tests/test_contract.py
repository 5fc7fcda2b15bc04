"""The registered queries against their SQL, at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from meshwright.plans import queries as graph_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(graph_queries.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    df = graph_queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    cursor = duck.execute(graph_queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()), key=str)
    assert sorted(names) == cols and len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
