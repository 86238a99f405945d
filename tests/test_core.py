import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fair, stats
from tidemark.operators import evaluate, fuzzy, pairs, pit, quotes, standings


def test_streak(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([True, True, False, True, None, True, True])], "e string, i int, v boolean")
    assert [r["s"] for r in pit.streak_before(df, ["e"], ["i"], F.col("v"), "s").orderBy("i").collect()] == [0, 1, 2, 0, 1, 0, 1]


def test_rolling_needs_all_values(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 6.0, 8.0])], "e string, i int, v double")
    out = pit.rolling_prev(df, ["e"], ["i"], {"s": (F.col("v"), "sum")}, 2).orderBy("i").collect()
    assert [r["s"] for r in out] == [None, None, 3.0, None, None, 10.0]


def test_range_history_sees_no_same_day(spark):
    df = spark.createDataFrame([("r", 1, 2.0), ("r", 1, 4.0), ("r", 5, 9.0), ("r", 800, 1.0)], "e string, d int, v double")
    out = pit.range_history(df, ["e"], F.col("d"), 730, F.col("v"), "h").orderBy("d", "v").collect()
    assert [(r["h_mean"], r["h_n"]) for r in out] == [(None, 0), (None, 0), (3.0, 2), (None, 0)]


def four_teams(spark):
    rows, d, n = [], date(2022, 1, 1), 0
    for h in "ABCD":
        for a in "ABCD":
            if h != a:
                g = (0, 2) if h == "D" or (a == "C" and h == "B") else (2, 0)
                rows.append((f"m{n:02}", "L", "S", d + timedelta(days=7 * n), h, a, g[0], g[1]))
                n += 1
    return spark.createDataFrame(rows, "match_id string, league string, season string, date date, home string, away string, fthg int, ftag int"), rows


def test_standings_equal_a_fold(spark):
    df, rows = four_teams(spark)
    state, want = {t: [0, 0, 0, 0] for t in "ABCD"}, {}
    for mid, _, _, _, h, a, x, y in rows:
        order = sorted(state, key=lambda t: (-state[t][0], -state[t][1], -state[t][2], t))
        want |= {(mid, t): (*state[t], order.index(t) + 1) for t in state}
        for t, f, g in ((h, x, y), (a, y, x)):
            s = state[t]
            s[0], s[1], s[2], s[3] = s[0] + (3 if f > g else f == g), s[1] + f - g, s[2] + f, s[3] + 1
    for strict in (True, False):
        got = {(r["match_id"], r["team"]): (r["pts"], r["gd"], r["gf"], r["played"], r["rank"]) for r in standings.grid(df, ["league", "season"], strict=strict).collect()}
        assert got == want


def test_stakes(spark):
    df, rows = four_teams(spark)
    z = spark.createDataFrame([("L", 1)], "league string, releg_spots int")
    t = standings.stakes(standings.grid(df, ["league", "season"]), ["league", "season"], z, "league")
    d = {r["match_id"]: r["surely_down"] for r in t.where("team = 'D'").collect()}
    assert d["m00"] is False and d["m11"] is True


def test_later_results_leave_the_past(spark):
    df, rows = four_teams(spark)
    cut = rows[6][3]
    changed = df.withColumn("fthg", F.when(F.col("date") > F.lit(cut), 9).otherwise(F.col("fthg")))
    key = lambda d: {tuple(r) for r in standings.grid(d, ["league", "season"]).where(F.col("date") <= F.lit(cut)).collect()}
    assert key(df) == key(changed)


def shin_python(c):
    q = [1 / x for x in c]
    s = sum(q)
    if s <= 1 or len(c) == 2:
        return [x / s for x in q]
    z = 0.0
    for _ in range(100):
        new = (sum(math.sqrt(z * z + 4 * (1 - z) * x * x / s) for x in q) - 2) / (len(q) - 2)
        z, last = min(0.99, max(0.0, new)), z
        if abs(new - last) < 1e-12:
            break
    p = [max(1e-9, (math.sqrt(z * z + 4 * (1 - z) * x * x / s) - z) / (2 * (1 - z))) for x in q]
    return [x / sum(p) for x in p]


def test_shin(spark):
    rng = random.Random(5)
    rows = [(2.10, 3.40, 3.60), (1.50, 4.20, 7.00), (3.0, 3.0, 4.0)] + [tuple(round(rng.uniform(1.2, 6), 2) for _ in range(3)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double").select("*", fair.shin([F.col(x) for x in "abc"]).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(shin_python([r["a"], r["b"], r["c"]]), abs=1e-9)
    first = df.first()["p"]
    assert first == pytest.approx([0.4586643893, 0.2787382169, 0.2625973938], abs=1e-9)


def test_unusable_prices(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (float("nan"), 2.0), (float("inf"), 2.0), (1.85, 1.95)], "a double, b double")
    out = [r["p"] for r in df.select(fair.proportional([F.col("a"), F.col("b")])[0].alias("p")).collect()]
    assert out[:4] == [None] * 4 and out[4] == pytest.approx(0.513158, abs=1e-6)


def test_stats(spark):
    lo, hi = stats.wilson(F.col("h"), F.col("n"))
    df = spark.createDataFrame([(0, 0, 0.0), (5, 10, 1.96), (10, 10, None)], "h int, n int, z double").select(lo.alias("lo"), hi.alias("hi"), stats.p_two_sided("z").alias("p"))
    a, b, c = df.collect()
    assert (a["lo"], a["hi"], a["p"]) == (0.0, 0.0, 1.0) and b["p"] == pytest.approx(0.05, abs=1e-3) and c["p"] is None and c["hi"] == 1.0


def test_benjamini_hochberg_never_splits_ties(spark):
    ps = [0.01, 0.02, 0.02, 0.5, 0.9, None]
    out = evaluate.benjamini_hochberg(spark.createDataFrame([(p,) for p in ps], "p double"), "p", 0.05).collect()
    assert {r["p"]: r["fdr"] for r in out} == {0.01: True, 0.02: True, 0.5: False, 0.9: False, None: False}
    assert evaluate.benjamini_hochberg(spark.createDataFrame([], "p double"), "p", 0.05).count() == 0


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.2, 0.35, 0.36, 1.0, 1.1, None)], "v double")
    assert [r["b"] for r in df.select(pairs.buckets(F.col("v"), [0, 0.2, 0.35, 0.5, 1.0]).alias("b")).collect()] == [0, 0, 1, 2, 3, None, None]


def test_blocks(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(10)], "s string")
    assert [r["b"] for r in pairs.blocks(df, "s", 3, "b").orderBy("s").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_search_equals_masks(spark):
    rng = random.Random(9)
    cols = ["A", "B", "adv_A", "adv_B", "M"]
    rows = [(i % 3, rng.random() < 0.4, rng.random(), *[rng.random() < 0.4 for _ in cols]) for i in range(400)]
    df = spark.createDataFrame(rows, "block int, hit boolean, ref double, " + ", ".join(f"{c} boolean" for c in cols))
    got = {r["combo"]: (r["n"], r["hits"]) for r in evaluate.combinations(df, ["A", "B"], ["adv_A", "adv_B"], ["M"], "hit", "ref", "block", 60, 1).collect()}
    at = {"own:A": 3, "own:B": 4, "other:adv_A": 5, "other:adv_B": 6, "match:M": 7}
    n_pair = lambda combo: sum(all(r[at[k]] for k in combo.split("&")[:2]) for r in rows)
    for combo, (n, hits) in got.items():
        mask = [r for r in rows if all(r[at[k]] for k in combo.split("&"))]
        assert (n, hits) == (len(mask), sum(r[1] for r in mask))
        assert combo.count("&") < 2 or n_pair(combo) >= 60
    assert "own:A&own:B" in got and "own:A&other:adv_B" in got


def test_predicate(spark):
    df = spark.createDataFrame([(True, None, True), (True, True, None)], "A boolean, B boolean, adv_C boolean")
    p = evaluate.predicate({"own": ["A"], "any_own": [["B"]], "any_other": [["C"]]}, df.columns)
    assert df.where(p).count() == 0 and evaluate.predicate({"own": ["Z"]}, df.columns) is None
    assert df.where(evaluate.predicate({"own": ["A"], "any_own": [["B"]]}, df.columns)).count() == 1


def test_fuzzy(spark):
    n = spark.createDataFrame([("L", "Man United"), ("L", "FC Foo"), ("L", "Nothing Like"), ("X", "Foo"), ("L", None)], "g string, name string")
    r = spark.createDataFrame([("L", "Manchester United"), ("L", "Foo"), ("L", "Foo Town")], "g string, club string")
    out = {(x["g"], x["name"]): x["club"] for x in fuzzy.link(n, r, "g", "name", "club").collect()}
    assert out == {("L", "Man United"): "Manchester United", ("L", "FC Foo"): "Foo", ("L", "Nothing Like"): None, ("X", "Foo"): None}


def test_latest_and_nearest(spark):
    rows = [("e", "J1", "2", "Over", 4.5, 1.9), ("e", "CLOSE", "1", "Over", 4.0, 1.8), ("e", "CLOSE", "1", "Under", 4.0, 2.0), ("e", "CLOSE", "1", "Over", 5.0, 2.5), ("e", "CLOSE", "1", "Over", None, 9.0)]
    df = spark.createDataFrame(rows, "e string, phase string, ts string, outcome string, point double, price double")
    x = quotes.latest(df, ["e"], (F.col("phase") == "CLOSE").cast("int"), F.col("ts"), ["outcome", "point", "price"])
    assert x.count() == 4
    r = quotes.nearest_level(x, ["e"], "point", 4.5, "outcome", "price", ["Over", "Under"]).collect()
    assert [(y["level"], y["over"], y["under"]) for y in r] == [(4.0, 1.8, 2.0)]


def test_coverage_settle_append(spark):
    df = spark.createDataFrame([("m", "b1", "e1"), ("m", "b1", "e1"), ("m", "b2", "e2"), ("n", "b1", "e1")], "market string, book string, e string")
    out = {r["market"]: (r["b1"], r["b2"], r["b3"]) for r in quotes.coverage(df, "market", "book", ["b1", "b2", "b3"], "e").collect()}
    assert out == {"m": (1, 1, 0), "n": (1, 0, 0)}
    a = spark.createDataFrame([("k", "h", 10), ("far", "h", 20), ("null", None, 10)], "k string, home string, d int")
    b = spark.createDataFrame([("m2", "h", 11), ("m1", "h", 9), ("m0", "x", 10)], "match_id string, home string, d int")
    got = quotes.settle(a, b, [("home", "home")], F.col("d"), F.col("d"), 1, ["k"], "match_id").collect()
    assert [(r["k"], r["match_id"]) for r in got] == [("k", "m1")]
    assert {r["k"] for r in quotes.append_new(a.where("k = 'k'"), a.union(a), ["k"]).collect()} == {"far", "null"}
