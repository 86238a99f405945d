"""Wall times of any year, and sources that read no more than they need."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import instants
from tidemark.sources import feeds

TEXTS = [
    ("1969-07-20 20:17", "Europe/Paris"), ("1955-06-01 15:00", "Europe/Paris"), ("2101-01-05 15:00", "Europe/Paris"), ("2150-07-05 15:00", "Europe/Paris"), ("1899-03-01 12:00", "Europe/Berlin"),
    ("2105-10-25 02:30", "Europe/Paris"), ("1968-10-27 01:30", "America/New_York"), ("2024-07-01 12:00", "Europe/Paris"),
]


def test_years_outside_the_table(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(TEXTS)] + [("1950-01-01 10:00", "Nowhere/None", 99), ("2150-01-01 10:00", None, 98)], "raw string, tz string, i int")
    out = {r["i"]: r for r in instants.normalise(df, "raw", "tz", instants.zone_intervals(spark, instants.known_zones(df, "tz"))).collect()}
    for i, (raw, tz) in enumerate(TEXTS):
        t = datetime.strptime(raw, "%Y-%m-%d %H:%M").replace(tzinfo=ZoneInfo(tz), fold=0)
        d = t.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
        assert out[i]["utc_us"] == (d.days * 86400 + d.seconds) * 1_000_000, raw
    assert [out[i]["time_status"] for i in (0, 5, 6, 7)] == ["direct", "ambiguous", "ambiguous", "direct"]
    assert out[99]["time_status"] == out[98]["time_status"] == "no_zone"


def test_append_reads_the_months_concerned(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k int, m string")
    assert feeds.append_months(spark, rows((1, "2024-01"), (2, "2024-02"), (3, None)), path, ["k"], F.col("m")) == 3
    assert feeds.append_months(spark, rows((1, "2024-01"), (1, "2024-02"), (3, None), (3, "2024-01")), path, ["k"], F.col("m")) == 2
    plan = feeds.months_of(spark, path, ["2024-01"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in plan.replace("isnotnull(month", "month") and "2024-01" in plan
    assert spark.read.parquet(path).count() == 5


def test_files_of_one_header_are_one_source(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text("A,B\n" + f"{i},x\n" if i < 3 else "B,A\ny,3\n")
    df = feeds.csv_files(spark, [f"{tmp_path}/{i}.csv" for i in range(4)], {}, ["A"], ["A"], keep=["B"])
    assert sorted(map(tuple, df.collect())) == [(0.0, "x"), (1.0, "x"), (2.0, "x"), (3.0, "y")]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2


def test_shared_folder_is_demanded_on_a_cluster():
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster())


def test_broadcast_is_by_bytes(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert session.is_small(df, 11_000) and not session.is_small(df, 9_000) and session.is_small(df.where("false"))
