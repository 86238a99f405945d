"""Matching records by nearest time within a tolerance.

Both tables are co-grouped by cells of entity and time range; a candidate falls into every range that its tolerance
reaches, so no pair is cut by a border. Within a cell both sides are sorted once and every record finds its
neighbours by a vectorised binary search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, left_entity: str, left_time: str, right_entity: str, right_time: str, right_id: str, tolerance_s: float, range_s: float | None = None, entity_groups: int | None = None, cell_rows: int = 50_000) -> DataFrame:
    """left rows with `right_id` of the right row of the same entity nearest in time, at most tolerance_s away.

    Entities compare character for character; null entities or times match nothing. Two right rows equally near: the one with
    the least id. left rows without a partner are left out; repeated left rows are each answered. right rows of one entity and
    time count as one, the least id. left must not have a column named as right_id; times are timestamps. Empty tables
    give an empty result.

    Cells: groups of entities by hash (as many as there are shuffle partitions, if not given) by time ranges of range_s seconds
    (64 tolerances, if not given), which holds at most a range's worth of distinct times of an entity. One entity or time may hold a large
    part of all rows: cells are counted beforehand on both sides and cut into shorter time ranges (of one tolerance at least)
    until neither side has more than cell_rows; left rows of a range that is still too full are dealt out, and only for these
    the right side is repeated.
    """
    tol, width = round(tolerance_s * 1e6), round((range_s or 64 * tolerance_s) * 1e6)
    if right_id in left.columns:
        raise ValueError(f"{right_id} is a column of both tables")
    groups = entity_groups or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    x = left.where(F.col(f"`{left_entity}`").isNotNull() & F.col(f"`{left_time}`").isNotNull())
    x = x.withColumn("_t", F.unix_micros(F.col(f"`{left_time}`").cast("timestamp"))).withColumn("_e", F.col(f"`{left_entity}`"))
    coarse = lambda t: F.floor(t / width).cast("int")
    x = x.withColumn("_g", group(F.col("_e"))).withColumn("_c", coarse(F.col("_t")))
    y = right.where(F.col(right_entity).isNotNull() & F.col(right_time).isNotNull() & F.col(right_id).isNotNull())
    y = y.groupBy(F.col(right_entity).alias("_e"), F.unix_micros(F.col(right_time).cast("timestamp")).alias("_t")).agg(F.min(right_id).alias("_id")).withColumn("_g", group(F.col("_e")))
    # how many parts a cell's time range is cut into, by the fuller side: a power of two, so that parts nest
    most = max(1, width // max(1, tol))
    both = x.select("_g", "_c", F.lit(1).alias("_x"), F.lit(0).alias("_y")).unionByName(y.select("_g", coarse(F.col("_t")).alias("_c"), F.lit(0).alias("_x"), F.lit(1).alias("_y")))
    counts = both.groupBy("_g", "_c").agg(F.sum("_x").alias("_nx"), F.sum("_y").alias("_ny"))
    need = F.ceil(F.greatest("_nx", "_ny") / cell_rows)
    cuts = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(need, F.lit(1))))), F.lit(most)).cast("int")
    counts = counts.select("_g", "_c", cuts.alias("_cuts"))
    named = lambda p: counts.select(F.col("_g").alias(f"_g{p}"), F.col("_c").alias(f"_c{p}"), F.col("_cuts").alias(f"_cuts{p}"))
    # a part is known by its cell and number; its borders are the cell's, cut evenly
    part = lambda t, c, cuts: F.floor((t - c * F.lit(width)) * cuts / F.lit(width)).cast("int")
    x = x.join(named("x"), (F.col("_g") == F.col("_gx")) & (F.col("_c") == F.col("_cx"))).withColumn("_r", part(F.col("_t"), F.col("_c"), F.col("_cutsx")))
    parts = x.groupBy("_g", "_c", "_r").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("_parts"))
    shared = lambda p: parts.select(F.col("_g").alias(f"_pg{p}"), F.col("_c").alias(f"_pc{p}"), F.col("_r").alias(f"_pr{p}"), F.col("_parts").alias(f"_n{p}"))
    at = lambda p: (F.col("_g") == F.col(f"_pg{p}")) & (F.col("_c") == F.col(f"_pc{p}")) & (F.col("_r") == F.col(f"_pr{p}"))
    x = x.join(shared("x"), at("x")).withColumn("_s", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("_nx")).cast("int"))
    # a candidate falls into every cell, and of it into every part, that its tolerance reaches
    reach = F.sequence(F.floor((F.col("_t") - tol) / width).cast("int"), F.floor((F.col("_t") + tol) / width).cast("int"))
    y = y.withColumn("_c", F.explode(reach)).join(named("y"), (F.col("_g") == F.col("_gy")) & (F.col("_c") == F.col("_cy")))
    lo, hi = part(F.col("_t") - tol, F.col("_c"), F.col("_cutsy")), part(F.col("_t") + tol, F.col("_c"), F.col("_cutsy"))
    y = y.withColumn("_r", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.col("_cutsy") - 1))))
    y = y.join(shared("y"), at("y")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))

    columns = list(left.columns)

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = a[columns].assign(**{right_id: None})
        if not len(a) or not len(b):
            return out.iloc[:0]
        names, code = np.unique(np.concatenate([a["_e"].to_numpy(str), b["_e"].to_numpy(str)]), return_inverse=True)
        low = min(a["_t"].min(), b["_t"].min())
        span = int(max(a["_t"].max(), b["_t"].max()) - low) + 2 * tol + 2
        # one axis for all entities: entities lie further apart than any two times within one
        at_a = code[: len(a)].astype(np.int64) * span + (a["_t"].to_numpy() - low)
        at_b = code[len(a) :].astype(np.int64) * span + (b["_t"].to_numpy() - low)
        order = np.argsort(at_b, kind="stable")
        at_b, ids = at_b[order], b["_id"].to_numpy()[order]
        after = np.searchsorted(at_b, at_a, side="left")
        far = np.int64(np.iinfo(np.int64).max)
        up = np.where(after < len(at_b), at_b[np.minimum(after, len(at_b) - 1)] - at_a, far)
        down = np.where(after > 0, at_a - at_b[np.maximum(after - 1, 0)], far)
        id_up, id_down = ids[np.minimum(after, len(ids) - 1)], ids[np.maximum(after - 1, 0)]
        tie = (up == down) & (up <= tol)
        pick_up = (up < down) | (tie & np.array([p < q for p, q in zip(id_up, id_down)], dtype=bool))
        ok = np.minimum(up, down) <= tol
        return out.assign(**{right_id: np.where(pick_up, id_up, id_down)})[ok]

    kind = dict(right.dtypes)[right_id]
    schema = ", ".join([f"`{c}` {t}" for c, t in left.dtypes] + [f"`{right_id}` {kind}"])
    return x.groupBy("_g", "_c", "_r", "_s").cogroup(y.groupBy("_g", "_c", "_r", "_s")).applyInPandas(cell, schema)
