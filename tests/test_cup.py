"""Cup fixtures meet all clubs."""

from tidemark.plans import prospective


def feed(spark, base):
    spark.createDataFrame([("A", "Avon Rovers"), ("B", "Brindle Town"), ("B", "Avon Rovers"), ("B", None)], "league string, club string").write.parquet(f"{base}/clubs.parquet")
    spark.createDataFrame([("a", "A"), ("b", "B"), ("cup", "CUP")], "sport_key string, league string").write.parquet(f"{base}/leagues.parquet")
    events = [("1", "cup", "Avon Rovers", " brindle town"), ("2", "cup", "Avon Rovers", "Nobody"), ("3", "a", "Avon Rovers", "Brindle Town"), ("4", "b", "Avon Rovers", "Brindle Town")]
    spark.createDataFrame(events, "event_id string, sport_key string, home_team string, away_team string").write.parquet(f"{base}/api_events.parquet")
    return str(base)


def test_composite_key(spark, tmp_path):
    out = {tuple(r) for r in prospective.c9_composite_key(spark, feed(spark, tmp_path)).select("league", "matched", "unmatched").collect()}
    assert out == {("CUP", 1, 1), ("A", 0, 1), ("B", 1, 0)}


def test_fuzzy_names(spark, tmp_path):
    out = {(r["league"], r["name"]): r["club"] for r in prospective.c10_fuzzy_names(spark, feed(spark, tmp_path)).collect()}
    assert out == {
        ("CUP", "Avon Rovers"): "Avon Rovers", ("CUP", " brindle town"): "Brindle Town", ("CUP", "Nobody"): None,
        ("A", "Avon Rovers"): "Avon Rovers", ("A", "Brindle Town"): None, ("B", "Avon Rovers"): "Avon Rovers", ("B", "Brindle Town"): "Brindle Town",
    }
