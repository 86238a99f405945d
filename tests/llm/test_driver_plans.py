"""What the driver plans, prints and broadcasts for a query is planned once: large plans are what fill its memory."""

import re

from tidemark.llm import entities, names, queries

BASE = "/root/testdata/sf0.001"


def cut_plans(monkeypatch, modules):
    plans = []
    for module in modules:
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), cut(df))[1])
    return plans


def test_times_of_both_listings_are_read_in_one_plan(spark, monkeypatch):
    plans = cut_plans(monkeypatch, (entities, names, queries))
    out = queries.p1_linked(spark, BASE)
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert sum(len(re.findall(r"Join \[_zone#", p)) for p in plans) == 1
    assert sum(map(len, plans)) < 150_000  # 285,000 while each listing had plans of its own
    assert out.count() == spark.read.parquet(f"{BASE}/api_events.parquet").select("event_id").distinct().count()


def test_names_are_parsed_apart_from_their_join(spark, monkeypatch):
    plans = cut_plans(monkeypatch, (names,))
    clubs = spark.createDataFrame([("A", "Avonbury Rovers", 1), ("A", "Brindleham Town", 2)], "league string, club string, club_id long")
    written = spark.createDataFrame([("A", "Avonbury Rvrs"), ("A", "Brindelham Town"), ("A", "Nobody")], "league string, written string")
    got = {(r["written"], r["club_id"]) for r in names.link(written, clubs).collect()}
    assert got == {("Avonbury Rvrs", 1), ("Brindelham Town", 2), ("Nobody", -1)}
    joined = [p for p in plans if "p_text" in p]
    assert len(joined) == 1 and "lower(" not in joined[0]
