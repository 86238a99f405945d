"""Latest and first snapshots by their instants, against a reading of the texts that shares nothing with the operators."""

import os
import re
from collections import defaultdict
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pyarrow.parquet as pq

from tidemark.plans import prospective

HOURS = {"UTC": "+00:00", "GMT": "+00:00", "WET": "+00:00", "BST": "+01:00", "WEST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "JST": "+09:00", "EST": "-05:00", "EDT": "-04:00"}
BASE = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


def instant(text, tz):
    if re.fullmatch(r"\d{13}", text):
        return int(text) * 1000
    if re.fullmatch(r"\d{10}\.\d{3}", text):
        return int(text.replace(".", "")) * 1000
    text = re.sub(" ([A-Z]+)$", lambda m: HOURS[m[1]], text)
    t = datetime.strptime(text, "%d/%m/%Y %H:%M:%S") if text[2] == "/" else datetime.fromisoformat(text)
    t = t if t.tzinfo else t.replace(tzinfo=ZoneInfo(tz), fold=0)
    d = t.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def archive(base):
    tz = {r["sport_key"]: r["tz"] for r in pq.read_table(f"{base}/leagues.parquet").to_pylist()}
    rows = pq.read_table(f"{base}/odds_archive.parquet").to_pylist()
    for r in rows:
        r["at"] = instant(r["snapshot_ts"], tz[r["sport_key"]])
    return rows


def latest(rows):
    groups = defaultdict(list)
    for r in rows:
        if r["price"] is not None:
            groups[tuple(r[k] for k in prospective.PRICE_KEYS)].append(r)
    out = set()
    for key, rs in groups.items():
        top = max((r["phase"] == "CLOSE", r["at"]) for r in rs)
        out |= {(*key, r["outcome"], r["point"], r["price"]) for r in rs if (r["phase"] == "CLOSE", r["at"]) == top}
    return out


def test_latest_is_by_instant(spark):
    want = latest(archive(BASE))
    got = prospective.c12_latest_snapshot(spark, BASE).select(*prospective.PRICE_KEYS, "outcome", "point", "price").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_nearest_line_of_the_latest(spark):
    per = defaultdict(lambda: {"over": None, "under": None})
    for event, market, book, _, outcome, point, price in latest(archive(BASE)):
        if market == "alternate_totals_cards" and point is not None:
            p = per[event, book, point]
            for side in p:
                if outcome.lower().startswith(side):
                    p[side] = max(price, p[side] or 0)
    want = {}
    for (event, book, point), p in per.items():
        want[event, book] = min(want.get((event, book), (9e9,)), (abs(point - 4.5), point, p["over"], p["under"]), key=lambda x: x[:2])
    got = {(r["event_id"], r["bookmaker"]): (r["level"], r["over"], r["under"]) for r in prospective.c13_nearest_line(spark, BASE).collect()}
    assert got == {k: v[1:] for k, v in want.items()}


def test_event_table_takes_the_first_instant(spark):
    first = {}
    for r in archive(BASE):
        x = (r["at"], r["sport_key"], r["commence_time"], r["home"], r["away"])
        first[r["event_id"]] = min(first.get(r["event_id"], x), x)
    got = {r["event_id"]: (r["sport_key"], r["commence_time"], r["home"], r["away"]) for r in prospective.g9_event_table(spark, BASE).collect()}
    assert got == {k: v[1:] for k, v in first.items()}


def test_forms_zones_and_unreadable_texts(spark, tmp_path):
    cols = "snapshot_ts string, phase string, event_id string, sport_key string, commence_time string, home string, away string, bookmaker string, market string, outcome string, point double, price double, description string"
    row = lambda ts, e, price, key="k": (ts, "J1", e, key, f"at {price}", "h", "a", "b", "m", "Over", 1.0, price, None)
    rows = [
        row("2025-12-18T19:09:39+00:00", "a", 1.1), row("2025-12-18 14:15:49", "a", 1.2),  # 19:15:49 UTC
        row("01/12/2025 10:00:00", "b", 1.3), row("30/11/2025 10:00:00", "b", 1.4), row("1764000000000", "b", 1.5),
        row("9 o'clock", "c", 1.6), row("2025-12-18T19:09:39Z", "c", 1.7), row(None, "c", 1.8),
        row("noon", "d", 1.9), row("soon", "d", 2.0),
        row("2025-12-18T19:09:39Z", "e", 2.1, None), row("2025-12-18T18:09:39-05:00", "e", 2.2, "unknown"),
    ]
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/odds_archive.parquet")
    spark.createDataFrame([("k", "America/New_York")], "sport_key string, tz string").write.parquet(f"{tmp_path}/leagues.parquet")
    got = {r["event_id"]: r["price"] for r in prospective.c12_latest_snapshot(spark, str(tmp_path)).collect()}
    assert got == {"a": 1.2, "b": 1.3, "c": 1.7, "d": 2.0, "e": 2.2}
    first = {r["event_id"]: r["commence_time"] for r in prospective.g9_event_table(spark, str(tmp_path)).collect()}
    assert first == {"a": "at 1.1", "b": "at 1.5", "c": "at 1.7", "d": "at 1.9", "e": "at 2.1"}
