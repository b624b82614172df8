"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from weirflow.queries.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return v.isoformat() if isinstance(v, datetime.datetime | datetime.date) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def compare(spark, duck, query, sql):
    df = query(spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    compare(spark, duck, QUERIES[name], ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
