"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import registry

BASE = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


def same(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
        return float(v) if v.__class__.__name__ == "Decimal" else v

    return sorted(cols), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{BASE}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, BASE)
    rows = df.collect()
    if name in registry.ORACLE:
        cur = con.execute(registry.ORACLE[name])
        assert same(df.columns, rows) == same([d[0] for d in cur.description], cur.fetchall())


def test_plans_prune_and_push(spark):
    """The scans read only the columns a query needs."""
    plan = registry.QUERIES["a17_dedupe"](spark, BASE)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<snapshot_ts:string,event_id:string,bookmaker:string,market:string,outcome:string,point:dou" in plan
