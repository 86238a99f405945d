"""Statistics on aggregated result columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def z_score(hits: Column, ref: Column, var: Column) -> Column:
    return F.when(var > 0, (hits - ref) / F.sqrt(var)).otherwise(F.lit(0.0))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a proportion, clamped to [0, 1]; (0, 0) without observations."""
    p = F.when(n > 0, hits / n)
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def p_two_sided(z: Column | str) -> Column:
    """Two-sided normal p-value; for result tables, as Spark has no erf. Null for null."""

    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if pd.notna(x) else None).astype("float64")

    return pandas_udf(tail, DoubleType())(z)
