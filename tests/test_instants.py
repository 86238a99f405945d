from datetime import datetime, timezone

from tidemark.operators import instants


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


def run(spark, texts, tz="Europe/Paris"):
    df = spark.createDataFrame([(i, t, tz, "old") for i, t in enumerate(texts)], "i int, raw string, tz string, time_status string")
    z = instants.zone_intervals(spark, ["Europe/Paris", "America/New_York", "No/Such"], 2020, 2030)
    return [(r["utc_us"], r["time_status"]) for r in instants.normalise(df, "raw", "tz", z).orderBy("i").collect()]


def test_forms(spark):
    noon = us(2025, 3, 5, 12)
    same = ["2025-03-05T12:00:00Z", "2025-03-05T13:00:00+01:00", "2025-03-05T07:00-0500", "20250305T120000Z", "1741176000", "1741176000000", "1741176000.000", "2025-03-05 13:00 CET", "Wed, 05 Mar 2025 12:00:00 GMT", " 2025-03-05  12:00:00 UTC "]
    assert run(spark, same) == [(noon, "instant")] * len(same)
    local = ["05/03/2025 13:00", "5/3/25 13:00", "05.03.2025 13:00", "Mar 5, 2025 1:00 PM", "5 mars 2025 13h00", "2025-03-05 13:00:00"]
    assert run(spark, local) == [(noon, "direct")] * len(local)
    assert run(spark, ["2025-03-05T12:00:00.123456+00:00"]) == [(noon + 123456, "instant")]
    assert run(spark, ["1 août 2025 20h45", "Dec 1, 2025 12:30 AM"]) == [(us(2025, 8, 1, 18, 45), "direct"), (us(2025, 11, 30, 23, 30), "direct")]


def test_clock_changes(spark):
    # an hour that occurs twice is its first pass; a skipped hour takes the offset before the gap
    assert run(spark, ["26/10/2025 02:30", "30/03/2025 02:30", "26/10/2025 03:00"]) == [(us(2025, 10, 26, 0, 30), "ambiguous"), (us(2025, 3, 30, 1, 30), "nonexistent"), (us(2025, 10, 26, 2), "direct")]
    assert run(spark, ["2025-11-02 01:30:00"], "America/New_York") == [(us(2025, 11, 2, 5, 30), "ambiguous")]


def test_unusable(spark):
    out = run(spark, [None, "", "05/03/2025", "soon", "31/02/2025 10:00", "2025-03-05 25:00", "2025-03-05 10:00 XQZ", "x" * 200_000])
    assert out == [(None, s) for s in ("unreadable", "unreadable", "day_only", "unreadable", "unreadable", "unreadable", "unknown_zone", "unreadable")]
    assert run(spark, ["2025-03-05 10:00"], "No/Such") == [(None, "no_zone")] and run(spark, ["2025-03-05 10:00"], None) == [(None, "no_zone")]


def test_empty(spark):
    df = spark.createDataFrame([], "raw string, tz string")
    assert instants.normalise(df, "raw", "tz", instants.zone_intervals(spark, ["Europe/Paris"], 2024, 2025)).count() == 0
