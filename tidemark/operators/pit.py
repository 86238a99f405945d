"""Point-in-time windows over any ordered entity table: what was known before each row.

All take the entity and order columns by name and add columns; windows of one entity and order share one exchange.
The order must be total (end it with a unique column). Rows see earlier rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAST = (Window.unboundedPreceding, -1)


def over(entity: list[str], order: list[str]):
    return Window.partitionBy(*entity).orderBy(*order)


def placed(df: DataFrame, entity: list[str], order: list[str], played: str) -> tuple[DataFrame, str]:
    """df with each row's place among the entity's rows that count (`played`): one more than those before it.

    A row that does not count (an event yet to come, or called off) has the place that the next would have. Frames over places
    then reach back over rows that count only, whichever row asks. One place column per entity, reused.
    """
    name = "_at_" + "_".join(entity)
    if name not in df.columns:
        df = df.withColumn(name, F.count(F.when(F.col(played), 1)).over(over(entity, order).rowsBetween(*PAST)) + 1)
    return df, name


def before(df: DataFrame, entity: list[str], order: list[str], played: str | None, first: int, last: int):
    """(df, window, mask): the window from `first` to `last` rows before (negative numbers), and what hides values of rows that do not count."""
    if played is None:
        return df, over(entity, order).rowsBetween(first, last), lambda c: c
    df, at = placed(df, entity, order, played)
    return df, Window.partitionBy(*entity).orderBy(at).rangeBetween(first, last), lambda c: F.when(F.col(played), c)


def streak_before(df: DataFrame, entity: list[str], order: list[str], flag: Column, name: str, played: str | None = None) -> DataFrame:
    """Length of the run of true values that ends at the previous row; 0 at the first. A null flag breaks the run; rows that do not
    count (played given and not true) neither break nor lengthen it."""
    false = ~F.coalesce(flag, F.lit(False))
    if played is None:
        w = over(entity, order)
        x = df.withColumn("_false", false).withColumn("_i", F.row_number().over(w))
        last_false = F.max(F.when(F.col("_false"), F.col("_i"))).over(w.rowsBetween(*PAST))
        return x.withColumn(name, (F.col("_i") - 1 - F.coalesce(last_false, F.lit(0))).cast("long")).drop("_false", "_i")
    x, w, mask = before(df, entity, order, played, *PAST)
    _, at = placed(x, entity, order, played)
    return x.withColumn(name, (F.col(at) - 1 - F.coalesce(F.max(mask(F.when(false, F.col(at)))).over(w), F.lit(0))).cast("long"))


def rolling_prev(df: DataFrame, entity: list[str], order: list[str], columns: dict[str, tuple[Column, str]], width: int, offset: int = 0, least: int | None = None, played: str | None = None) -> DataFrame:
    """For each name -> (value, fn): fn over the `width` rows that end `offset` rows before this one; null unless `least` (width) of them have a value."""
    x, w, mask = before(df, entity, order, played, -width - offset, -1 - offset)
    fns = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp, "count": F.count}
    return x.select("*", *[F.when(F.count(mask(v)).over(w) >= (width if least is None else least), fns[fn](mask(v)).over(w)).alias(n) for n, (v, fn) in columns.items()])


def lagged(df: DataFrame, entity: list[str], order: list[str], column: str, steps: list[int], played: str | None = None) -> DataFrame:
    """The column's value some rows earlier, of rows that count."""
    if played is None:
        return df.select("*", *[F.lag(column, k).over(over(entity, order)).alias(f"{column}_m{k}") for k in steps])
    for k in steps:
        df, w, mask = before(df, entity, order, played, -k, -k)
        df = df.withColumn(f"{column}_m{k}", F.max(mask(F.col(column))).over(w))
    return df


def to_date(df: DataFrame, entity: list[str], order: list[str], value: Column, name: str, played: str | None = None) -> DataFrame:
    """Mean and count over all previous rows of the entity (give the season as part of it for season to date)."""
    x, w, mask = before(df, entity, order, played, *PAST)
    return x.select("*", F.avg(mask(value)).over(w).alias(f"{name}_mean"), F.count(mask(F.lit(1))).over(w).alias(f"{name}_n"))


def range_history(df: DataFrame, entity: list[str], day: Column, days: int, value: Column, name: str) -> DataFrame:
    """Mean and count over the rows of the `days` days before this row's day; rows of the same day are not seen."""
    w = Window.partitionBy(*entity).orderBy(F.col("_day")).rangeBetween(-days, -1)
    return df.withColumn("_day", day).select("*", F.avg(value).over(w).alias(f"{name}_mean"), F.count(value).over(w).alias(f"{name}_n")).drop("_day")


def first_since(df: DataFrame, entity: list[str], order: list[str], flag: Column, name: str, played: str | None = None) -> DataFrame:
    """Rows since the flag was first true, counting this one's place; null before that."""
    if played is None:
        w = over(entity, order)
        x = df.withColumn("_i", F.row_number().over(w))
        first = F.min(F.when(flag, F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return x.withColumn(name, (F.col("_i") - first).cast("long")).drop("_i")
    x, w, mask = before(df, entity, order, played, *PAST)
    _, at = placed(x, entity, order, played)
    seen = mask(F.when(flag, F.col(at)))
    return x.withColumn(name, (F.col(at) - F.coalesce(F.min(seen).over(w), seen)).cast("long"))
