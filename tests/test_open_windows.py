"""The hours still open when the stream ends are given too."""

import os

import pyarrow.parquet as pq

from tidemark.plans import prospective

BASE = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


def test_windows_cover_all_rows(spark):
    rows = pq.read_table(f"{BASE}/events.parquet").to_pylist()
    got = prospective.j_stream_windows(spark, BASE).collect()
    want = {}
    for r in rows:
        k = r["ts"].replace(minute=0, second=0, microsecond=0), r["event_type"]
        want[k] = want.get(k, 0) + 1
    assert {(r["start"].replace(tzinfo=None), r["event_type"]): r["n"] for r in got} == want and len(got) == len(want)
    assert sum(r["n"] for r in got) == len(rows)
