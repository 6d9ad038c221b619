"""Every query beside its SQL on the smallest tables; those without SQL must at least run."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")


def plain(v):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        cur = duck.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == columns
        assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
