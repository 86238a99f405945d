"""Rows that do not count stay out of every window's state, and still get what came before them."""

import random

from pyspark.sql import functions as F

from tidemark.operators import pit, standings
from test_core import four_teams

FLAGS = [True, True, False, None, True, None, None, True, True, None]  # null: not played
WANT = [0, 1, 2, 0, 0, 1, 1, 1, 2, 3]


def played_rows(spark, flags=FLAGS):
    return spark.createDataFrame([("e", i, f, i * 10) for i, f in enumerate(flags)], "e string, i int, v boolean, n int").withColumn("played", F.col("v").isNotNull())


def test_streak(spark):
    out = pit.streak_before(played_rows(spark), ["e"], ["i"], F.col("v"), "s", "played").orderBy("i").collect()
    assert [r["s"] for r in out] == WANT


def test_windows_against_lists(spark):
    rng = random.Random(3)
    flags = [rng.choice([True, False, None]) for _ in range(60)]
    x = played_rows(spark, flags)
    x = pit.rolling_prev(x, ["e"], ["i"], {"s": (F.col("n"), "sum")}, 3, played="played")
    x = pit.rolling_prev(x, ["e"], ["i"], {"o": (F.col("n"), "max")}, 2, offset=2, played="played")
    x = pit.lagged(x, ["e"], ["i"], "n", [1, 3], "played")
    x = pit.to_date(x, ["e"], ["i"], F.col("n"), "all", "played")
    x = pit.first_since(x, ["e"], ["i"], F.col("v"), "since", "played")
    for r in x.collect():
        past = [10 * j for j in range(r["i"]) if flags[j] is not None]
        assert r["s"] == (sum(past[-3:]) if len(past) >= 3 else None)
        assert r["o"] == (max(past[-4:-2]) if len(past) >= 4 else None)
        assert r["n_m1"] == (past[-1] if past else None) and r["n_m3"] == (past[-3] if len(past) > 2 else None)
        assert r["all_n"] == len(past) and r["all_mean"] == (sum(past) / len(past) if past else None)
        first = next((10 * j for j in range(r["i"] + 1) if flags[j]), None)
        assert r["since"] == (None if first is None else len(past) - sum(1 for p in past if p < first))


def test_table_by_day_equals_the_fold(spark):
    df, _ = four_teams(spark)
    df = df.withColumn("fthg", F.when(F.col("match_id") != "m05", F.col("fthg"))).unionByName(df.where("match_id = 'm00'").withColumns({"match_id": F.lit("none"), "date": F.lit(None).cast("date")}))
    want = {(r["date"], r["team"]): (r["pts"], r["gd"], r["gf"], r["played"], r["rank"], r["n_teams"]) for r in standings.grid(df.where("date is not null"), ["league", "season"]).collect()}
    got = {(r["date"], r["team"]): (r["pts"], r["gd"], r["gf"], r["played"], r["rank"], r["n_teams"]) for r in standings.by_day(df, ["league", "season"]).collect()}
    assert got == want and len(got) == 12 * 4
    two = standings.sides(df, standings.by_day(df, ["league", "season"]), ["league", "season"])
    assert two.count() == 2 * 12 and standings.by_day(df.where("false"), ["league", "season"]).count() == 0


def test_promotion_and_parts_of_the_table(spark):
    df, _ = four_teams(spark)
    z = spark.createDataFrame([("L", 1, 1, 2)], "league string, releg_spots int, promo_spots int, europe_spots int")
    t = standings.stakes(standings.by_day(df, ["league", "season"]), ["league", "season"], z, "league", "date")
    last = {r["team"]: r for r in t.collect() if r["date"].isoformat() == "2022-03-19"}
    assert [last[k]["top_half"] for k in "ABCD"].count(True) == 2 and last["D"]["bottom_third"] and last["D"]["up_gone"] and not last["D"]["surely_up"]
    assert last["A"]["pts_promo"] == last["A"]["pts_first"]
