import glob
import os

import duckdb
import pytest

from tidemark.llm import queries

BASE = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, BASE)
    rows = df.collect()
    assert rows or name == "p9_limits"  # too few texts there to pile up
    if name in queries.ORACLE:
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for f in glob.glob(f"{BASE}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
        cur = con.execute(queries.ORACLE[name])
        cols = [d[0] for d in cur.description]
        assert sorted(tuple(r[c] for c in sorted(cols)) for r in rows) == sorted(tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall())


def test_one_row_per_event_and_document(spark):
    for name, key in (("p1_found", "event_id"), ("p9_found", "doc_id")):
        df = queries.QUERIES[name](spark, BASE)
        assert df.count() == df.select(key).distinct().count()
