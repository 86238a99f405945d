"""Optional inputs, settings, expected goals, counters and CSV results."""

import json
import statistics
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.operators import fuzzy
from tidemark.sources import optional


def test_absent_and_present_tables(spark, tmp_path):
    assert optional.optional_table(spark, f"{tmp_path}/none") is None
    for m in ("2024-01", "2024-02"):
        spark.range(3).write.parquet(f"{tmp_path}/odds_{m}")
    assert optional.optional_table(spark, f"{tmp_path}/odds_*").count() == 6


def test_settings_and_listed_pairs(spark):
    z = optional.zones(spark, optional.settings(json.dumps({"L": {"releg_spots": 3, "europe_spots": 4}})))
    assert [tuple(r) for r in z.collect()] == [("L", 3, 0, 4)]
    df = spark.createDataFrame([("L", "a", "b"), ("L", "b", "a"), ("M", "a", "b"), ("L", "a", None)], "league string, home string, away string")
    assert [r["derby"] for r in optional.with_flag(df, "league", "home", "away", {"L": [("b", "a")]}, "derby").orderBy("league", "home", F.col("away").asc_nulls_last()).collect()] == [True, False, True, False]


def test_results_of_pages(spark):
    text = json.dumps([{"isResult": True, "datetime": "2024-05-01 20:00:00", "h": {"title": "A"}, "a": {"title": "B"}, "xG": {"h": "1.25", "a": "x"}}, {"isResult": False, "h": {"title": "C"}}])
    out = optional.results_of(spark.createDataFrame([(1, text), (2, "nonsense"), (3, None)], "page int, t string"), "t").collect()
    assert [tuple(r) for r in out] == [(1, date(2024, 5, 1), "A", "B", 1.25, None)]


def test_expected_goals(spark):
    n = 14
    sides = spark.createDataFrame([(f"m{i:02}", s, s, date(2024, 1, 1) + timedelta(days=i), i % 4, i % 3) for i in range(n) for s in ("home", "away")], "match_id string, side string, team string, date date, gf int, ga int")
    xg = spark.createDataFrame([(f"m{i:02}", i * 0.5, i * 0.25) for i in range(n) if i != 3], "match_id string, h double, a double")
    x = optional.side_values(sides, xg.unionByName(xg.limit(1)), "match_id", "h", "a", "xg", "xga")
    assert x.count() == 2 * n and optional.is_covered(x, "xg") and not optional.is_covered(x.withColumn("xg", F.lit(None).cast("double")), "xg") and not optional.is_covered(x.where("false"), "xg")
    out = {r["match_id"]: r for r in optional.shot_windows(x.where("side = 'away'"), ["team"], ["date"]).collect()}
    assert out["m08"]["xg_l5"] is None and out["m09"]["xg_l5"] == sum(0.25 * i for i in range(4, 9)) / 5
    assert abs(out["m09"]["xg_std_l5"] - statistics.stdev(0.25 * i for i in range(4, 9))) < 1e-12 and out["m13"]["xg_l6_10"] is None


def test_counter_and_csv(spark, tmp_path):
    assert [optional.add_to_counter(spark, f"{tmp_path}/c", "2024-01", 5) for _ in range(2)] == [5, 10]
    optional.write_csv(spark.range(3), f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 3


def test_alias(spark):
    n = spark.createDataFrame([("L", "The Reds"), ("L", "Avon Rovers")], "g string, name string")
    r = spark.createDataFrame([("L", "Avon Rovers"), ("L", "Brindle Town")], "g string, club string")
    assert {x["name"]: x["club"] for x in fuzzy.link(n, r, "g", "name", "club", alias={"The Reds": "Brindle Town"}).collect()} == {"The Reds": "Brindle Town", "Avon Rovers": "Avon Rovers"}
