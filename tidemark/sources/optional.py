"""Inputs that may be absent, settings, and small outputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import pairs, pit

RESULTS = "array<struct<isResult:boolean,datetime:string,h:struct<title:string>,a:struct<title:string>,xG:struct<h:string,a:string>>>"


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path (or of a pattern of paths, such as a month's files), None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return spark.read.parquet(path) if found is not None and len(found) else None


def settings(text: str) -> dict:
    """Settings from YAML where the library is there, else from JSON (which is YAML too)."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def zones(spark: SparkSession, config: dict[str, dict[str, int]]) -> DataFrame:
    """(league, releg_spots, promo_spots, europe_spots) from league -> spots; absent ones are 0."""
    keys = ("releg_spots", "promo_spots", "europe_spots")
    return spark.createDataFrame([(k, *[int(v.get(c, 0)) for c in keys]) for k, v in config.items()], "league string, " + ", ".join(f"{c} int" for c in keys))


def with_flag(df: DataFrame, group: str, a: str, b: str, listed: dict[str, list[tuple[str, str]]], name: str) -> DataFrame:
    """df with `name`: whether its unordered pair is listed for its group (local rivals, say). The list is a setting, so small."""
    rows = {(g, *sorted(p)) for g, ps in listed.items() for p in ps}
    t = df.sparkSession.createDataFrame(sorted(rows), "_g string, _a string, _b string")
    lo, hi = F.least(a, b), F.greatest(a, b)
    x = df.join(F.broadcast(t.withColumn("_hit", F.lit(True))), (F.col(group) == F.col("_g")) & (lo == F.col("_a")) & (hi == F.col("_b")), "left")
    return x.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.coalesce("_hit", F.lit(False)).alias(name))


def results_of(pages: DataFrame, text: str) -> DataFrame:
    """One row per finished match of each page's JSON list: (other columns, date, home, away, xg_home, xg_away); unreadable texts give none."""
    keep = [F.col(f"`{c}`") for c in pages.columns if c != text]
    x = pages.select(*keep, F.explode(F.from_json(text, RESULTS)).alias("_r")).where("_r.isResult")
    return x.select(*keep, F.substring("_r.datetime", 1, 10).try_cast("date").alias("date"), F.col("_r.h.title").alias("home"), F.col("_r.a.title").alias("away"), F.col("_r.xG.h").try_cast("double").alias("xg_home"), F.col("_r.xG.a").try_cast("double").alias("xg_away"))


def side_values(sides: DataFrame, values: DataFrame, key: str, home: str, away: str, own: str, other: str) -> DataFrame:
    """sides (one row per match and side) with a match table's two values as the side's own and the other's; null without."""
    v = pairs.two_sided(values.dropDuplicates([key]), [key], {own: (home, away), other: (away, home)})
    return sides.join(v, [key, "side"], "left")


def is_covered(df: DataFrame, column: str, share: float = 0.3) -> bool:
    """Whether more than `share` of the rows have a value: a gate for what is derived from it. One row is fetched."""
    return (df.agg(F.avg(F.col(column).isNotNull().cast("int"))).first()[0] or 0.0) > share


def shot_windows(sides: DataFrame, entity: list[str], order: list[str], played: str | None = None) -> DataFrame:
    """Windows over expected goals (own `xg`, other `xga`): the last five, their deviation, and the five before those."""
    x = pit.rolling_prev(sides, entity, order, {"xg_l5": (F.col("xg"), "avg"), "xga_l5": (F.col("xga"), "avg"), "gf_sum_l5": (F.col("gf"), "sum"), "xg_sum_l5": (F.col("xg"), "sum"), "xg_std_l5": (F.col("xg"), "std")}, 5, played=played)
    return pit.rolling_prev(x, entity, order, {"xg_l6_10": (F.col("xg"), "avg"), "xga_l6_10": (F.col("xga"), "avg")}, 5, offset=5, played=played)


def add_to_counter(spark: SparkSession, path: str, name: Column | str, amount: int) -> int:
    """A named count kept in a small table; gives the new value. The table is replaced whole, so a failed run leaves the old one."""
    from tidemark.sources import feeds

    old = optional_table(spark, path)
    rows = {r["name"]: r["n"] for r in old.collect()} if old is not None else {}  # counters, a few
    rows[name] = rows.get(name, 0) + amount
    feeds.replace_table(spark, spark.createDataFrame(sorted(rows.items()), "name string, n bigint"), path)
    return rows[name]


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header: for reports, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
