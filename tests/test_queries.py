"""Each query with SQL against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
from heddle.queries import QUERIES, SQL  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert mine == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_source_faults_collects_no_items(spark):
    from heddle.queries import QUERIES

    assert "collect_list" not in QUERIES["source_faults"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
