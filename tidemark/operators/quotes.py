"""Time series of quotes: latest as of a moment, nearest level, settlement, idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], prefer: Column, at: Column, columns: list[str]) -> DataFrame:
    """Per key the rows at the preferred, then latest moment: one aggregation finds the moment, an equi-join keeps its rows."""
    best = F.struct(prefer.alias("p"), at.alias("t"))
    x = df.withColumn("_b", best)
    top = x.groupBy(*keys).agg(F.max("_b").alias("_top"))
    y = x.join(top.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_top"), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).where(F.col("_b") == F.col("_top"))
    return y.select(*keys, *columns).distinct()


def nearest_level(df: DataFrame, keys: list[str], level: str, target: float, outcome: str, price: str, names: list[str]) -> DataFrame:
    """Per key the level nearest to the target (ties: the lower) and the best price of each named outcome at it, in one aggregation each."""
    per = df.where(F.col(level).isNotNull()).groupBy(*keys, level).agg(*[F.max(F.when(F.lower(outcome).startswith(n.lower()), F.col(price))).alias(n.lower()) for n in names])
    best = F.min(F.struct(F.abs(F.col(level) - target).alias("d"), F.col(level).alias("level"), *[F.col(n.lower()) for n in names]))
    return per.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.level", *[f"m.{n.lower()}" for n in names])


def settle(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_day: Column, right_day: Column, days: int, key: list[str], right_id: str) -> DataFrame:
    """Each left key with the first right row (by id) of equal attributes at most `days` days away.

    The interval becomes an equality: left rows are repeated for the days around theirs.
    """
    x = left.withColumn("_d", F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda i: left_day + i)))
    y = right.select(*[F.col(b).alias(f"_r_{b}") for _, b in on], right_day.alias("_rd"), F.col(right_id)).distinct()
    cond = [F.col(a) == F.col(f"_r_{b}") for a, b in on] + [F.col("_d") == F.col("_rd")]
    return x.join(y, cond).groupBy(*key).agg(F.min(right_id).alias(right_id))


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """incoming rows whose key is not there yet, each key once: what an idempotent run adds."""
    return incoming.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def coverage(df: DataFrame, row: str, column: str, values: list[str], unit: str) -> DataFrame:
    """Distinct units per row value and column value, as a matrix with a given list of columns."""
    return df.select(row, column, unit).distinct().groupBy(row).pivot(column, values).count().na.fill(0)
