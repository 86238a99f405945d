"""The sequential table holds one group at a time, not matches times teams."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import standings

SCHEMA = "league string, season string, match_id string, date date, home string, away string, fthg bigint, ftag bigint"


def played(n, teams, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        h, a = r.sample(range(teams), 2)
        goals = (None, r.randrange(3)) if r.random() < 0.1 else (r.randrange(3), r.randrange(3))
        rows.append((r.choice("AB"), "1", f"m{i}", dt.date(2024, 1, 1) + dt.timedelta(r.randrange(n // 8)), f"é{h}" if h % 3 else f"T{h}", f"é{a}" if a % 3 else f"T{a}", *goals))
    return rows


def test_equals_grid_over_many_batches(spark):
    df = spark.createDataFrame(played(400, 30, 1), SCHEMA)
    grid = standings.grid(df, ["league", "season"], strict=False)
    sides = df.select("match_id", F.explode(F.array("home", "away")).alias("team"))
    columns = ["match_id", "team", "pts", "gd", "gf", "played", "rank"]
    want = sorted(tuple(r) for r in grid.join(sides, ["match_id", "team"]).select(columns).collect())
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in standings.sequential(df, ["league", "season"]).select(columns).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 800 and got == want


def test_nulls_and_itself(spark):
    day = dt.date(2024, 1, 1)
    rows = [("A", "1", "m2", None, "x", "y", 5, 0), ("A", "1", "m1", day, "x", "x", 1, 0), ("A", "1", "m3", day, "y", None, 0, 1), ("A", "1", None, day, "x", "y", 1, 0), (None, "1", "m4", day, "x", "y", 1, 0)]
    got = {tuple(r) for r in standings.sequential(spark.createDataFrame(rows, SCHEMA), ["league", "season"]).collect()}
    # the side without a name gained three points; the match without an id counts after those with one
    assert got == {("m1", "x", 0, 0, 0, 0, 1), ("m3", "y", 0, 0, 0, 0, 2), ("m2", "x", 6, 2, 2, 2, 1), ("m2", "y", 0, -2, 0, 2, 3)}
    assert standings.sequential(spark.createDataFrame([], SCHEMA), ["league", "season"]).count() == 0


def test_query_does_not_join_matches_with_teams(spark, tmp_path):
    from tidemark.plans import form

    cards = ", ".join(f"{c} double" for c in dict.fromkeys([*form.INTS, *form.PRICES]) if c not in ("fthg", "ftag"))
    spark.createDataFrame([], SCHEMA.replace("bigint", "double") + f", referee string, recorded_at timestamp, {cards}").write.parquet(f"{tmp_path}/matches.parquet")
    plan = form.e1_standings(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
