"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from tidemark.plans import queries as Q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    found = duck.execute(Q.SQL[name])
    at = [[x[0] for x in found.description].index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(e.queries())
