"""Attributes as known at event time.

Facts become versions with a place on two axes: their rank (what is later in the world overrides) and the day on
which they became known. On the axis of knowledge each version holds a half-open validity interval, up to the day on
which a fact of higher rank became known. Intervals are cut into dyadic nodes (a node of level k covers 2^k days);
an event joins the nodes of all levels that enclose its day by plain equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checked_broadcast

LEVELS = 17  # at most; 2^17 days are 358 years
HORIZON = 1 << LEVELS
SALT_FROM = 6  # up to 2^6 days a node meets the events of 2^6 days only
HOT = 200_000  # events of one entity beyond which they are spread


def validity(versions: DataFrame, entity: str, rank: list[str], known: str, block: Column) -> DataFrame:
    """Adds `until` to versions (entity, rank columns, known day): the first day on which something of higher rank was known.

    until is the least `known` among the entity's versions of higher rank, a minimum over the rest of the entity's history.
    As one entity may hold a large part of all rows, the minimum is taken within blocks (`block` must not decrease with
    the rank) and then over the blocks, of which an entity has few. Versions that never hold (until <= known) are dropped.
    """
    x = versions.withColumn("_b", block)
    later = Window.partitionBy(entity, "_b").orderBy(*[F.desc(c) for c in rank]).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.min(known).over(later))
    blocks = x.groupBy(F.col(entity).alias("_e"), F.col("_b").alias("_bb")).agg(F.min(known).alias("_k"))
    after = Window.partitionBy("_e").orderBy(F.desc("_bb")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_after", F.min("_k").over(after)).drop("_k")
    x = x.join(blocks, (F.col(entity) == F.col("_e")) & (F.col("_b") == F.col("_bb")))
    x = x.withColumn("until", F.coalesce(F.least("_in", "_after"), F.lit(HORIZON)))
    return x.where(F.col("until") > F.col(known)).drop("_b", "_bb", "_e", "_in", "_after")


def nodes(since: Column, until: Column, levels: int = LEVELS) -> Column:
    """The canonical dyadic cover of [since, until) within [0, 2^levels): array of (level, node), at most two per level."""

    def level(k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("int")
        lo = F.floor((since + size - 1) / size).cast("int")
        hi = F.floor(until / size).cast("int")
        live = lo < hi
        return F.array(
            F.when(live & (lo % 2 == 1), F.struct(k.alias("level"), lo.alias("node"))),
            F.when(live & (hi % 2 == 1), F.struct(k.alias("level"), (hi - 1).alias("node"))),
        )

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), level)))


def as_known(events: DataFrame, versions: DataFrame, entity: str, day: str, event_key: list[str], since: str, until: str, payload: list[str], hot: int = HOT) -> DataFrame:
    """events with the payload of the version that holds on their day; events without one are left out.

    events: entity, day (days since the epoch, int) and event_key; versions: entity, [since, until) and payload.
    Versions of one entity are disjoint, so an event meets at most one, whatever the order of rows. Null entities or
    days match nothing.

    A node of a high level meets all events of its entity. Entities with more than `hot` events are counted out beforehand (one
    row per `hot` events at most; broadcast if their bytes are few); their nodes of level k > 6 are repeated up to 2^(k-6) times and
    the events spread among the copies. An entity has at most one node of level k per 2^k days, so the copies stay few.
    """
    # the days that occur set the axis: only levels up to their range are needed
    lo, hi = events.agg(F.min(day), F.max(day)).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    levels = max(1, (hi - lo).bit_length())
    counts = events.groupBy(F.col(entity).alias("_hot")).agg(F.count("*").alias("_n")).where((F.col("_n") > hot) & F.col("_hot").isNotNull())
    counts = checked_broadcast(counts.select("_hot", F.ceil(F.col("_n") / hot).cast("int").alias("_parts")))
    copies = lambda level: F.greatest(F.lit(1), F.least(F.coalesce("_parts", F.lit(1)), F.pow(F.lit(2), F.greatest(F.lit(0), level - SALT_FROM)).cast("int")))
    n = versions.select(F.col(entity).alias("_e"), F.col(since).alias("_since"), F.col(until).alias("_until"), *payload, F.explode(nodes(F.greatest(F.col(since) - lo, F.lit(0)), F.least(F.col(until) - lo, F.lit(hi - lo + 1)), levels)).alias("_n"))
    n = n.select("_e", "_since", "_until", *payload, F.col("_n.level").alias("_l"), F.col("_n.node").alias("_node"))
    n = n.join(counts, F.col("_e") == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies(F.col("_l")) - 1)))
    n = n.drop("_hot", "_parts")
    e = events.join(counts, F.col(entity) == F.col("_hot"), "left")
    e = e.select(*event_key, F.col(entity).alias("_ent"), F.col(day).alias("_day"), "_parts", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_lev"))
    e = e.withColumn("_at", F.floor((F.col("_day") - lo) / F.pow(F.lit(2), F.col("_lev"))).cast("int"))
    e = e.withColumn("_s", F.pmod(F.xxhash64(*event_key), copies(F.col("_lev"))).cast("int")).drop("_parts")
    on = [F.col("_ent") == F.col("_e"), F.col("_lev") == F.col("_l"), F.col("_at") == F.col("_node"), F.col("_s") == F.col("_salt")]
    x = e.join(n, reduce(lambda a, b: a & b, on))
    return x.where((F.col("_since") <= F.col("_day")) & (F.col("_day") < F.col("_until"))).select(*event_key, *payload)
