"""Every query that has SQL gives the same rows in Spark and DuckDB."""

import math

import duckdb
import pytest

from rasterlake.queries import QUERIES, SQL

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{BASE}/{t}.parquet'")
    return con


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v if isinstance(v, (str, bool)) else float(v)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), cols)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
