"""The search over all outcomes and conditions."""

import os
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.operators import evaluate
from tidemark.plans import form

BASE = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


def test_all_outcomes_equal_one_at_a_time(spark):
    rng = random.Random(3)
    cols = ["A", "B", "adv_A", "adv_B", "M"]
    some = lambda: rng.choice([True, False, None])
    rows = [(i % 3, some(), some(), rng.random(), rng.random(), *[rng.random() < 0.5 for _ in cols]) for i in range(500)]
    df = spark.createDataFrame(rows, "block int, x boolean, y boolean, rx double, ry double, " + ", ".join(f"{c} boolean" for c in cols))
    args = (["A", "B"], ["adv_A", "adv_B"], ["M"])
    plain = lambda r: (r["n"], r["hits"], round(r["ref"], 9), round(r["var"], 9), r["agree"])
    got = {(r["outcome"], r["combo"]): plain(r) for r in evaluate.combinations(df, *args, ["x", "y"], ["rx", "ry"], "block", 20, 20).collect()}
    one = {(o, r["combo"]): plain(r) for o in "xy" for r in evaluate.combinations(df, *args, o, f"r{o}", "block", 20, 20).collect()}
    assert got == one and {o for o, _ in got} == {"x", "y"}


def test_every_outcome_and_condition(spark):
    x = form._atoms(spark, BASE).cache()
    rows = [r.asDict() for r in x.collect()]
    assert len(rows) == form.long(spark, BASE).count()
    n, hits = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        own, other, match = [f"own:{a}" for a in form.OWN if r[a]], [f"other:adv_{a}" for a in form.OWN if r[f"adv_{a}"]], [f"match:{a}" for a in form.MATCH if r[a]]
        combos = own + other + match + [f"{a}&{b}" for a in own for b in [*other, *match, *[k for k in own if k > a]]] + [f"{a}&{b}" for a in other for b in match] + [f"{a}&{b}&{m}" for a in own for b in other for m in match]
        for c in combos:
            for o in form.OUTCOMES:
                if r[o] is not None:  # a match without a result tests nothing
                    n[c][o] += 1
                    hits[c][o] += r[o]
    got = {(r["outcome"], r["combo"]): (r["n"], r["hits"]) for r in form.x2_search_all(spark, BASE).collect()}
    assert got == {(o, c): (k, hits[c][o]) for c, ks in n.items() for o, k in ks.items() if k >= 30}
    assert len(form.OUTCOMES) == 23 and x.select(*[F.count_if(a).alias(a) for a in form.OWN]).first()["HOST"] > 0


def triples(rows, own, match):
    n = Counter(f"own:{a}&other:adv_{b}&match:{m}" for r in rows for a in own if r[a] for b in own if r[f"adv_{b}"] for m in match if r[m])
    return {c: k for c, k in n.items() if k >= 30}


def test_no_triple_is_lost(spark, monkeypatch):
    # pair (A, adv_A) has 50 rows, fewer than 60, and its triple with M 40
    cols = ["LONG_WINLESS", "WINNING", "SCORING", "LEAKING"]
    flags = ", ".join(f"{c} boolean, adv_{c} boolean" for c in cols)
    rows = [(f"s{i % 3}", "L", "home", i % 2 == 0, i < 40, False, *[i < 50] * 2, *[False] * 6) for i in range(90)]
    df = spark.createDataFrame(rows, f"season string, league string, side string, over25 boolean, AT_HOME boolean, CUP_TIE boolean, {flags}")
    monkeypatch.setattr(form, "_conditions", lambda spark, base: df)
    for search in (form.x2_search, form.x5_search_canonical):
        got = {r["combo"]: r["n"] for r in search(spark, BASE).collect() if r["combo"].count("&") == 2}
        assert got == triples([r.asDict() for r in df.collect()], cols, ["AT_HOME", "CUP_TIE"]) == {"own:LONG_WINLESS&other:adv_LONG_WINLESS&match:AT_HOME": 40}


def test_single_match_conditions_count_matches(spark, monkeypatch):
    flags = ", ".join(f"{c} boolean, adv_{c} boolean" for c in ("LONG_WINLESS", "WINNING", "SCORING", "LEAKING"))
    rows = [(f"s{i % 3}", "CUP", side, i % 4 == 0, side == "home", True, *[False] * 8) for i in range(40) for side in ("home", "away")]
    df = spark.createDataFrame(rows, f"season string, league string, side string, over25 boolean, AT_HOME boolean, CUP_TIE boolean, {flags}")
    monkeypatch.setattr(form, "_conditions", lambda spark, base: df)
    assert {r["combo"]: (r["n"], r["hits"]) for r in form.x5_search_canonical(spark, BASE).collect()} == {"match:AT_HOME": (40, 10), "match:CUP_TIE": (40, 10)}
    assert {r["combo"]: (r["n"], r["hits"]) for r in form.x2_search(spark, BASE).collect()} == {"match:AT_HOME": (40, 10), "match:CUP_TIE": (80, 20)}
