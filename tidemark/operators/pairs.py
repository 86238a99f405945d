"""Paired-competition tables: one row per match to one row per side, and back to the other side's view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The last recorded row of each key; repeats collapse. One partial aggregation instead of a sort of all versions."""
    return df.groupBy(key).agg(F.max(F.struct(version, *columns)).alias("_x")).select(key, *[F.col("_x")[c].alias(c) for c in columns])


def two_sided(df: DataFrame, shared: list[str], swapped: dict[str, tuple[str, str]]) -> DataFrame:
    """Each row as its home and its away side: name -> (column seen from home, column seen from away). One scan, no union."""
    view = lambda side, k: F.struct(F.lit(side).alias("side"), *[F.col(v[k]).alias(n) for n, v in swapped.items()])
    return df.select(*shared, F.inline(F.array(view("home", 0), view("away", 1))))


def opponent_view(df: DataFrame, key: str, columns: list[str], prefix: str = "adv_") -> DataFrame:
    """The other side's columns beside each side's own: one exchange on the key, no self-join."""
    w = Window.partitionBy(key)
    other = lambda c: F.when(F.col("side") == "home", F.max(F.when(F.col("side") == "away", F.col(c))).over(w)).otherwise(F.max(F.when(F.col("side") == "home", F.col(c))).over(w))
    return df.select("*", *[other(c).alias(prefix + c) for c in columns])


def unordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("pair_a"), F.greatest(a, b).alias("pair_b")]


def buckets(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed interval that holds the value, the first also at its left end; null outside or for null."""
    out = F.when((value >= edges[0]) & (value <= edges[1]), 0)
    for i in range(1, len(edges) - 1):
        out = out.when((value > edges[i]) & (value <= edges[i + 1]), i)
    return out


def blocks(df: DataFrame, column: str, parts: int, name: str) -> DataFrame:
    """The column's distinct values in order, cut into `parts` blocks of equal number; the last takes the rest.

    The distinct values (seasons) are few and numbered apart from the rows.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    w = Window.orderBy(column)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    values = values.select(column, (F.row_number().over(w) - 1).alias("_i"), n.alias("_n"))
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / parts))
    return df.join(values.select(column, F.least(F.floor(F.col("_i") / size), F.lit(parts - 1)).cast("long").alias(name)), column, "left")
