"""Landed files to typed tables: CSV files of differing headers, JSON snapshots, JSON embedded in pages; and what writes them back."""

from __future__ import annotations

import codecs
import csv
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

ODDS = "id string, sport_key string, commence_time string, home_team string, away_team string, bookmakers array<struct<key:string, markets:array<struct<key:string, outcomes:array<struct<name:string, price:double, point:double, description:string>>>>>>"


def season_label(code: Column) -> Column:
    """1516 -> 2015-16."""
    return F.concat(F.lit("20"), F.substring(code, 1, 2), F.lit("-"), F.substring(code, 3, 2))


def season_of(day: Column) -> Column:
    y = F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def day_first(text: Column) -> Column:
    """d/m/yyyy or d/m/yy to a day, null if it is neither."""
    year = F.regexp_extract(text, r"^\d{1,2}/\d{1,2}/(\d{4}|\d{2})$", 1)
    return F.when(F.length(year) == 4, F.try_to_date(text, "d/M/yyyy")).when(F.length(year) == 2, F.try_to_date(text, "d/M/yy"))


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "ISO-8859-1")).readLine() or ""
    finally:
        stream.close()


def csv_files(spark: SparkSession, paths: list[str], rename: dict[str, str], required: list[str], numbers: list[str], zeros: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """The union of CSV files whose headers differ. Files without a required column are skipped, lines that do not parse are dropped.

    Columns absent from a file are null; `numbers` become doubles or null, those in `zeros` 0 instead; rows lacking a required value go.
    The driver reads the first line of each file and no more; files of one header are read as one source, so the plan
    grows with the number of different headers, not of files.
    """
    wanted = list(dict.fromkeys([*required, *numbers, *keep]))
    by_header: dict[str, list[str]] = {}
    for p in paths:
        by_header.setdefault(_first_line(spark, p), []).append(p)
    out = None
    for header, files in by_header.items():
        names = [n.strip() for n in next(csv.reader([header.removeprefix("\u00ef\u00bb\u00bf")]), [])]
        columns = [rename.get(n, n) for n in names]
        if not set(required) <= set(columns):
            continue
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
        df = spark.read.csv(files, schema=schema, header=True, encoding="ISO-8859-1", mode="DROPMALFORMED", enforceSchema=True)
        df = df.select(*[F.col(f"c{columns.index(c)}").alias(c) if c in columns else F.lit(None).cast("string").alias(c) for c in wanted])
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` {'double' if c in numbers else 'string'}" for c in wanted))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in zeros else F.col(c).try_cast("double")
    return out.withColumns({c: F.nanvl(number(c), F.lit(None).cast("double")) for c in numbers}).na.drop(subset=required)


def flatten_odds(events: DataFrame, json: str, books: list[str] | None = None) -> DataFrame:
    """One row per bookmaker, market and outcome of each event's JSON; unreadable JSON gives no rows."""
    e = events.withColumn("_e", F.from_json(json, ODDS)).where(F.col("_e.id").isNotNull())
    keep = [c for c in events.columns if c != json]
    x = e.select(*keep, F.col("_e.id").alias("event_id"), "_e.sport_key", "_e.commence_time", F.col("_e.home_team").alias("home"), F.col("_e.away_team").alias("away"), F.explode("_e.bookmakers").alias("b"))
    if books is not None:
        x = x.where(F.col("b.key").isin(books))
    x = x.select("*", F.explode("b.markets").alias("m")).select("*", F.explode("m.outcomes").alias("o"))
    return x.select(*keep, "event_id", "sport_key", "commence_time", "home", "away", F.col("b.key").alias("bookmaker"), F.col("m.key").alias("market"), F.col("o.name").alias("outcome"), "o.point", "o.price", "o.description")


def embedded_json(html: Column, variable: str) -> Column:
    r"""The text of `variable = JSON.parse('...')` in a page, with its \xNN escapes resolved; null where there is none."""

    def unescape(s: pd.Series) -> pd.Series:
        one = lambda t: codecs.decode(t.encode("latin-1", "backslashreplace"), "unicode_escape").encode("latin-1", "ignore").decode("utf-8", "replace") if t else None
        return s.map(one)

    found = F.regexp_extract(html, rf"(?s){re.escape(variable)}\s*=\s*JSON\.parse\('(.*?)'\)", 1)
    return pandas_udf(unescape, StringType())(F.when(found != "", found))


def months_of(spark: SparkSession, path: str, months: list) -> DataFrame:
    """The rows of a table partitioned by month in the given months (null among them or not): other folders are not read."""
    known = F.col("month").isin([m for m in months if m is not None])
    return spark.read.parquet(path).where(known | F.col("month").isNull() if None in months else known)


def append_months(spark: SparkSession, new: DataFrame, path: str, key: list[str], month: Column) -> int:
    """Adds the rows of `new` whose key its month lacks; returns how many. Only the months concerned are read and new files are added,
    so a failed run leaves nothing half written and a repeated run adds nothing. The months of `new` (few) are fetched to prune."""
    x = new.withColumn("month", month.cast("string")).dropDuplicates([*key, "month"])
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        months = [r[0] for r in x.select("month").distinct().collect()]
        old = months_of(spark, path, months).select(*key, F.col("month").cast("string").alias("month"))
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*key, "month"]]
        x = x.alias("n").join(old.alias("o"), same, "left_anti")
    n = x.count()
    if n:
        x.write.mode("append").partitionBy("month").parquet(path)
    return n


def merge_state(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keyed state after an update: a flag once set stays, other values take the new one if there is one."""
    o, n = old.alias("o"), new.alias("n")
    kinds = dict(old.dtypes)
    pick = lambda c: (F.coalesce(F.col(f"o.{c}"), F.lit(False)) | F.coalesce(F.col(f"n.{c}"), F.lit(False))) if kinds[c] == "boolean" else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return o.join(n, [F.col(f"o.{c}") == F.col(f"n.{c}") for c in key], "full_outer").select(*[F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in key], *[pick(c).alias(c) for c in old.columns if c not in key])


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Overwrites a table that df may itself have been read from: written beside it, then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    target, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    fs = target.getFileSystem(conf)
    fs.delete(target, True)
    fs.rename(new, target)
