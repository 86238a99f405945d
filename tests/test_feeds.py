import json

from pyspark.sql import functions as F

from tidemark.sources import feeds, reports
from tidemark.streaming import streams


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Div,Date,HomeTeam,FTHG,HY\nL,01/08/24,Caf\xe9,2,\nL,,Foo,1,1\nL,02/08/24,Bar,x,3\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("Div,Date\nL,01/08/24\n")
    out = feeds.csv_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], {"HomeTeam": "home", "FTHG": "fthg", "HY": "hy", "Date": "day"}, ["day", "home"], ["fthg", "hy", "absent"], zeros=["hy"])
    assert {tuple(r) for r in out.collect()} == {("01/08/24", "Café", 2.0, 0.0, None), ("02/08/24", "Bar", None, 3.0, None)}
    assert feeds.csv_files(spark, [], {}, ["day"], ["fthg"]).count() == 0


def test_odds_json(spark):
    e = {"id": "1", "sport_key": "s", "commence_time": "t", "home_team": "h", "away_team": "a", "bookmakers": [{"key": "b1", "markets": [{"key": "m", "outcomes": [{"name": "Over", "price": 1.5, "point": 2.5}, {"name": "Under", "price": 2.5}]}]}, {"key": "b2", "markets": []}]}
    df = spark.createDataFrame([(json.dumps(e), "J1"), ("not json", "J1"), (None, "J1")], "raw string, phase string")
    rows = feeds.flatten_odds(df, "raw", ["b1"]).collect()
    assert [(r["phase"], r["outcome"], r["point"], r["price"]) for r in rows] == [("J1", "Over", 2.5, 1.5), ("J1", "Under", None, 2.5)]


def test_embedded_json(spark):
    page = r"<script>var datesData = JSON.parse('\x5B\x7B\x22a\x22\x3A\x22\xC3\xA9\x22\x7D\x5D')</script>"
    df = spark.createDataFrame([(page,), ("none",), (None,)], "html string").select(feeds.embedded_json(F.col("html"), "datesData").alias("j"))
    assert [r["j"] for r in df.collect()] == ['[{"a":"é"}]', None, None]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1, "2024-01"), ("a", 1, "2024-01"), ("b", None, "2024-02")], "k string, p int, m string")
    assert feeds.append_months(spark, df, path, ["k", "p"], F.col("m")) == 2
    assert feeds.append_months(spark, df, path, ["k", "p"], F.col("m")) == 0
    assert spark.read.parquet(path).count() == 2


def test_state_and_replace(spark, tmp_path):
    old = spark.createDataFrame([("a", True, "1"), ("b", False, "1")], "k string, f boolean, t string")
    new = spark.createDataFrame([("b", True, None), ("c", None, "2")], "k string, f boolean, t string")
    out = {tuple(r) for r in feeds.merge_state(old, new, ["k"]).collect()}
    assert out == {("a", True, "1"), ("b", True, "1"), ("c", False, "2")}
    path = str(tmp_path / "s")
    old.write.parquet(path)
    feeds.replace_table(spark, feeds.merge_state(spark.read.parquet(path), new, ["k"]), path)
    assert spark.read.parquet(path).count() == 3


def test_labels(spark):
    df = spark.createDataFrame([("1516", "2026-06-30", "1/8/24"), ("9900", "2026-07-01", "31/02/2024")], "c string, d string, t string")
    out = df.select(feeds.season_label(F.col("c")).alias("a"), feeds.season_of(F.to_date("d")).alias("b"), feeds.day_first(F.col("t")).alias("d")).collect()
    assert out[0]["a"] == "2015-16" and out[0]["b"] == "2025-26" and out[1]["b"] == "2026-27" and str(out[0]["d"]) == "2024-08-01" and out[1]["d"] is None


def test_reports(spark):
    df = spark.createDataFrame([("x", 1, 0.5), ("y", 2, None)], "s string, n int, v double")
    text = reports.markdown(df, "T", section="s")
    assert "## x" in text and "| 1 | 0.5 |" in text and "No rows" in reports.markdown(df.where("false"), "T")
    assert "<dd>3</dd>" in reports.html({"n": 3}, {"t": df}, "T") and reports.signed_percent(0.123) == "+12.3 %" and reports.signed_percent(None) == "–"


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in.parquet"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int").write.parquet(src)
    assert streams.drain(streams.deduped(streams.landed(spark, src), ["k"]), "t").count() == 2
    streams.append_once(streams.landed(spark, src), ["k", "v"], out)
    streams.append_once(streams.landed(spark, src), ["k", "v"], out)
    assert spark.read.parquet(out).count() == 2
