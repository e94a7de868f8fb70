"""Every query against its oracle on the smallest tables."""

import math

import duckdb
import pytest
from conftest import DATA

from lodestar.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def rows_of(dicts, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in dicts), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_oracle(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    got = [r.asDict() for r in df.collect()]
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r, strict=True)) for r in cur.fetchall()]
    assert rows_of(got, sorted(columns)) == rows_of(want, sorted(columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
