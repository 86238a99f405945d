"""Probabilities from prices that hold a margin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(prices: list[Column]) -> Column:
    ok = None
    for p in prices:
        c = F.coalesce((p > 1.0) & ~F.isnan(p) & (p < float("inf")), F.lit(False))
        ok = c if ok is None else ok & c
    return ok


def proportional(prices: list[Column]) -> list[Column]:
    """Inverse prices scaled to sum to 1; null unless all prices are above 1."""
    total = sum((1 / p for p in prices[1:]), 1 / prices[0])
    return [F.when(usable(prices), (1 / p) / total) for p in prices]


def shin(prices: list[Column], steps: int = 100) -> Column:
    """Array of probabilities under the insider model: a fixed point for the insiders' share z, as a fold in SQL.

    Two outcomes, or prices without a margin, are scaled proportionally. Null unless all prices are above 1.
    """
    n = len(prices)
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  evaluated once
    total_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    scaled = lambda xs: let(total_of(xs), lambda t: F.transform(xs, lambda x: x / t))

    def fitted(q: Column) -> Column:
        def with_squares(sq: Column) -> Column:  # x^2 / total, all that the root needs
            root = lambda z, s: F.sqrt(z * z + 4 * (1 - z) * s)

            def step(acc: Column, _: Column) -> Column:
                move = let((F.aggregate(sq, F.lit(0.0), lambda a, s: a + root(acc["z"], s)) - 2) / (n - 2), lambda new: F.struct(F.least(F.lit(0.99), F.greatest(F.lit(0.0), new)).alias("z"), (F.abs(new - acc["z"]) < 1e-12).alias("done")))
                return F.when(acc["done"], acc).otherwise(move)

            z = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("z"), F.lit(False).alias("done")), step)["z"]
            return scaled(let(z, lambda v: F.transform(sq, lambda s: F.greatest(F.lit(1e-9), (root(v, s) - v) / (2 * (1 - v))))))

        return let(total_of(q), lambda t: F.when(t <= 1, F.transform(q, lambda x: x / t)).otherwise(let(F.transform(q, lambda x: x * x / t), with_squares)))

    q = F.array(*[1 / p for p in prices])
    return F.when(usable(prices), scaled(q) if n == 2 else let(q, fitted))
