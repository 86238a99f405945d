import random
from datetime import date, datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import dyadic
from tidemark.plans.core_problems import p3_found


def cover(s, e):
    out, k = [], 0
    while s < e:
        if s & 1:
            out.append((k, s))
            s += 1
        if e & 1:
            e -= 1
            out.append((k, e))
        s, e, k = s >> 1, e >> 1, k + 1
    return sorted(out)


def test_nodes(spark):
    random.seed(3)
    pairs = [(0, dyadic.HORIZON), (5, 6), (7, 7), (1, 8)] + [tuple(sorted(random.sample(range(30000), 2))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "s int, e int").select("s", "e", dyadic.nodes(F.col("s"), F.col("e")).alias("n"))
    for r in df.collect():
        assert sorted((x["level"], x["node"]) for x in r["n"]) == cover(r["s"], r["e"])


def brute(rows):
    facts = [r for r in rows if None not in (r["id"], r["d"], r["g"], r["a"], r["rec"])]
    out = set()
    for mid, d, h, a in {(r["id"], r["d"], r["h"], r["w"]) for r in rows}:
        for side, club in (("home", h), ("away", a)):
            c = [r for r in facts if club is not None and d is not None and club in (r["h"], r["w"]) and r["d"] < d and r["rec"] < datetime.combine(d, datetime.min.time())]
            if c and mid is not None:
                b = max(c, key=lambda r: (r["d"], r["id"], r["rec"], r["g"], r["a"]))
                out.add((mid, side, b["id"], b["g"], b["a"]))
    return out


def write(spark, tmp, rows):
    schema = "match_id string, date date, home string, away string, fthg double, ftag double, recorded_at timestamp, side string, known int"
    df = spark.createDataFrame([(r["id"], r["d"], r["h"], r["w"], r["g"], r["a"], r["rec"], "clash", 9) for r in rows], schema)
    df.write.mode("overwrite").parquet(f"{tmp}/matches.parquet")


def test_as_known_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    day0, rows = date(2024, 1, 1), []
    for i in range(260):
        d = day0 + timedelta(days=rng.randrange(500))
        h, w = rng.sample(["hot", "b", "c", "d"], 2) if rng.random() > 0.05 else (None, "b")
        for _ in range(rng.choice([1, 1, 2, 3])):
            rec = datetime.combine(d, datetime.min.time()) + timedelta(days=rng.choice([0, 0, 1, 20, -1]), hours=rng.choice([0, 0, 21]))
            g = None if rng.random() < 0.15 else float(rng.randrange(4))
            rows.append({"id": f"m{i}", "d": d, "h": h, "w": w, "g": g, "a": None if g is None else float(rng.randrange(4)), "rec": rec if rng.random() > 0.03 else None})
            if rng.random() < 0.2:
                rows.append(dict(rows[-1]))
    rows.append({"id": None, "d": day0, "h": "b", "w": "c", "g": 1.0, "a": 1.0, "rec": datetime(2024, 1, 1)})
    write(spark, tmp_path, rows)
    got = {tuple(r) for r in p3_found(spark, str(tmp_path)).collect()}
    assert got == brute(rows)
    assert p3_found(spark, str(tmp_path)).count() == len(got)


def test_hot_entities_are_spread(spark):
    e = spark.createDataFrame([(i, "hot", i % 900) for i in range(2000)] + [(9000, None, 5), (9001, "hot", None)], "id int, e string, d int")
    v = spark.createDataFrame([("hot", 0, 300, "a"), ("hot", 300, dyadic.HORIZON, "b")], "e string, since int, until int, p string")
    out = {r["id"]: r["p"] for r in dyadic.as_known(e, v, "e", "d", ["id"], "since", "until", ["p"], hot=100).collect()}
    assert out == {i: "a" if i % 900 < 300 else "b" for i in range(2000)}


def test_later_rows_change_nothing(spark, tmp_path):
    base = [{"id": f"m{i}", "d": date(2024, 1, 1 + i), "h": "a", "w": "b", "g": 1.0, "a": 0.0, "rec": datetime(2024, 1, 1 + i, 22)} for i in range(8)]
    write(spark, tmp_path / "x", base)
    before = {tuple(r) for r in p3_found(spark, str(tmp_path / "x")).collect()}
    write(spark, tmp_path / "y", base + [{**r, "g": 9.0, "rec": datetime(2024, 6, 1)} for r in base])
    assert {tuple(r) for r in p3_found(spark, str(tmp_path / "y")).collect()} == before


def test_empty(spark, tmp_path):
    write(spark, tmp_path, [])
    assert p3_found(spark, str(tmp_path)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, dyadic.HORIZON - 1), st.integers(0, dyadic.HORIZON), st.integers(0, dyadic.HORIZON - 1))
def test_cover_holds_exactly_its_days(s, e, day):
    inside = any(day >> k == n for k, n in cover(s, e))
    assert inside == (s <= day < e)
