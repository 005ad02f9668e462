"""Every library query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from tarmac.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "nation supplier customer part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df, rel = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(dict(zip(rel.columns, r))[c]) for c in names) for r in rel.fetchall()), key=str)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
