import random
from datetime import datetime, timedelta

import pytest

from tidemark.llm import entities, nearest

E = "event_id string, e_league string, e_home bigint, e_away bigint, e_us bigint, e_day int, extra string"
M = "match_id string, m_league string, m_home bigint, m_away bigint, m_us bigint, m_day int"
H = 3_600_000_000


def run(spark, e, m, **kw):
    e = spark.createDataFrame([(*r, "x") for r in e], E)
    out = entities.cascade(e, spark.createDataFrame(m, M), "event_id", "match_id", entities.fixture_rules(), **kw)
    return {r["event_id"]: (r["match_id"], r["rule"], r["confidence"]) for r in out.collect()}


def test_cascade(spark):
    day = 24 * H
    m = [
        ("a", "L", 1, 2, 100 * day, 100), ("abandoned", "L", 3, 4, None, 200), ("replay", "L", 3, 4, 202 * day + 5 * H, 202),
        ("far", "L", 5, 6, 300 * day, 300), ("null", "L", None, None, None, None), ("tie2", "L", 7, 8, None, 50), ("tie1", "L", 7, 8, None, 50),
    ]
    e = [
        ("kick", "L", 1, 2, 100 * day, 100), ("swap", "L", 2, 1, 100 * day, 100), ("day", "L", 1, 2, 100 * day + H, 100), ("rep", "L", 3, 4, 202 * day + 5 * H, 202), ("aban", "L", 3, 4, 200 * day, 200),
        ("late", "L", 5, 6, 304 * day, 304), ("gone", "L", 5, 6, 330 * day, 330), ("other", "X", 1, 2, 100 * day, 100), ("none", "L", None, 2, None, None), ("tie", "L", 7, 8, 50 * day, 50),
    ]
    out = run(spark, e, m)
    assert {k: v[0] for k, v in out.items()} == {"kick": "a", "swap": "a", "day": "a", "rep": "replay", "aban": "abandoned", "late": "far", "gone": None, "other": None, "none": None, "tie": "tie1"}
    assert out["kick"][1] == "kickoff" and out["swap"][1] == "kickoff_swapped" and out["late"][1] == "within_10_days"
    assert out["gone"][1:] == (None, 0.0) and out["kick"][2] == pytest.approx(3 / 4)  # two right of two labelled, smoothed


def test_given_labels(spark):
    labels = spark.createDataFrame([("k1", "a"), ("k2", "zzz")], "event_id string, match_id string")
    m = [("a", "L", 1, 2, 0, 0)]
    out = run(spark, [("k1", "L", 1, 2, 0, 0), ("k2", "L", 1, 2, 0, 0)], m, labels=labels)
    assert out["k1"][2] == pytest.approx((1 + 1) / (2 + 2))


def test_confidence_is_the_rule_s_precision_on_what_the_first_resolved(spark):
    day = 24 * H
    # three fixtures listed by kick-off; one of them has a namesake on the same day, so the day rule finds the wrong one there
    m = [("a", "L", 1, 2, 100 * day, 100), ("b", "L", 3, 4, 101 * day, 101), ("c2", "L", 5, 6, 102 * day, 102), ("c1", "L", 5, 6, None, 102), ("d", "L", 7, 8, None, 103)]
    e = [("e1", "L", 1, 2, 100 * day, 100), ("e2", "L", 3, 4, 101 * day, 101), ("e3", "L", 5, 6, 102 * day, 102), ("e4", "L", 7, 8, 103 * day, 103), ("e5", "L", 8, 7, 103 * day, 103)]
    out = run(spark, e, m)
    assert {k: v[0] for k, v in out.items()} == {"e1": "a", "e2": "b", "e3": "c2", "e4": "d", "e5": "d"}
    assert out["e4"][1:] == ("day", pytest.approx((2 + 1) / (3 + 2))) and out["e1"][1:] == ("kickoff", pytest.approx((3 + 1) / (3 + 2)))
    assert out["e5"][1:] == ("day_swapped", None)  # nothing judges it


def test_cascade_empty_and_clash(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [("k", "L", 1, 2, 0, 0)], []) == {"k": (None, None, 0.0)}
    df = spark.createDataFrame([], M)
    with pytest.raises(ValueError):
        entities.cascade(df, df, "match_id", "match_id", entities.fixture_rules())


def brute(left, right, tol):
    out = set()
    for k, e, t in left:
        c = [(abs((t - rt).total_seconds()), i) for i, re, rt in right if None not in (e, t, re, rt, i) and re == e]
        c = [x for x in c if x[0] <= tol]
        if c:
            out.add((k, min(c)[1]))
    return out


@pytest.mark.parametrize("cell_rows", [50_000, 7])
def test_nearest_against_brute_force(spark, cell_rows):
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    left = [(i, rng.choice(["hot", "hot", "hot", "b", "é", None]), t0 + timedelta(hours=rng.randrange(24 * 200)) if rng.random() > 0.03 else None) for i in range(400)]
    right = [(f"m{i}", rng.choice(["hot", "b", "é", None]), t0 + timedelta(hours=6 * rng.randrange(4 * 200))) for i in range(300)]
    right += right[:20] + [("m0x", "hot", left[0][2])]
    a = spark.createDataFrame(left + left[:5], "k int, entity string, at timestamp")
    b = spark.createDataFrame([(*r, "clash") for r in right], "match_id string, entity string, at timestamp, k string")
    out = nearest.nearest(a, b, "entity", "at", "entity", "at", "match_id", 36 * 3600, range_s=20 * 24 * 3600, entity_groups=3, cell_rows=cell_rows)
    rows = [(r["k"], r["match_id"]) for r in out.collect()]
    want = brute(left, right, 36 * 3600)
    assert set(rows) == want and len(rows) == len(want) + sum(k < 5 for k, _ in want)


def test_nearest_border_and_tie(spark):
    t = datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, "x", t)], "k int, e string, at timestamp")
    b = lambda *rows: spark.createDataFrame(rows, "id string, e string, at timestamp")
    one = lambda r: [x["id"] for x in nearest.nearest(a, r, "e", "at", "e", "at", "id", 3600).collect()]
    assert one(b(("n", "x", t + timedelta(hours=1)))) == ["n"] and one(b(("n", "x", t + timedelta(hours=1, microseconds=1)))) == []
    assert one(b(("z", "x", t - timedelta(minutes=5)), ("b", "x", t + timedelta(minutes=5)))) == ["b"]
    assert one(b(("n", "x", t)).where("false")) == []
    with pytest.raises(ValueError):
        nearest.nearest(a, a.withColumnRenamed("e", "f"), "e", "at", "f", "at", "k", 1)
