"""Running league tables: the state of every entity of a group at the start of each day on which the group plays.

The fold over results becomes sums over earlier days. All matches of a day see one table, so there are days times entities
rows, of the order of the matches themselves, and two rows a match come out; a group of many entities that meet seldom (a cup)
does not multiply its matches by its entities. sequential() is the fold in which matches of a day see each other: one pass over
the sorted matches of each group. grid() lays out the state of every entity before every match, for small groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship


def grid(matches: DataFrame, group: list[str], match_id: str = "match_id", day: str = "date", home: str = "home", away: str = "away", gf: str = "fthg", ga: str = "ftag", strict: bool = True) -> DataFrame:
    """(group, match_id, team, pts, gd, gf, played, rank, n_teams) before each match.

    strict: only matches of earlier days count; else also those of the same day with a smaller match_id (the sequential fold).
    A match without both goals earns nothing. rank: points, goal difference, goals, then name.
    """
    m = matches.select(*group, match_id, day, home, away, F.col(gf).alias("_g"), F.col(ga).alias("_a"))
    teams = m.select(*group, F.explode(F.array(home, away)).alias("team")).distinct()
    x = m.join(teams, group)
    mine = F.when(F.col("team") == F.col(home), 1).when(F.col("team") == F.col(away), -1)
    margin = mine * (F.col("_g") - F.col("_a"))
    played = margin.isNotNull()
    earned = {
        "pts": F.when(margin > 0, 3).when(margin == 0, 1).otherwise(0),
        "gd": F.coalesce(margin, F.lit(0)),
        "gf": F.when(played, F.when(mine == 1, F.col("_g")).otherwise(F.col("_a"))).otherwise(0),
        "played": F.when(played, 1).otherwise(0),
    }
    x = x.select(*group, match_id, day, "team", *[v.cast("long").alias(f"_{k}") for k, v in earned.items()])
    w = Window.partitionBy(*group, "team")
    w = w.orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1) if strict else w.orderBy(day, match_id).rowsBetween(Window.unboundedPreceding, -1)
    x = x.select(*group, match_id, day, "team", *[F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)).cast("long").alias(k) for k in earned])
    per_match = Window.partitionBy(*group, match_id)
    rank = F.row_number().over(per_match.orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), "team"))
    return x.select("*", rank.cast("long").alias("rank"), F.count(F.lit(1)).over(per_match).alias("n_teams"))


def sequential(matches: DataFrame, group: list[str], match_id: str = "match_id", day: str = "date", home: str = "home", away: str = "away", gf: str = "fthg", ga: str = "ftag") -> DataFrame:
    """(match_id, team, pts, gd, gf, played, rank) of the two sides of each match, with all earlier matches of the group counted, those of the same day with a smaller match_id too.

    The rows of grid(strict=False) for the teams that play, without laying out matches times teams: a task goes through the sorted matches of its groups and holds the
    table of one group. Nulls come last: matches without a day, among equal teams one without a name (which has a place in the table, but no row). A match without both goals
    earns nothing; one without a group or match_id has no row; a team against itself has one.
    """
    ship(matches.sparkSession)
    m = matches.dropna(subset=group)
    goals = [F.col(c).cast("long").alias(n) for c, n in ((gf, "_f"), (ga, "_a"))]
    rows = m.select(*group, F.lit(1).alias("_kind"), F.col(day).alias("_day"), F.col(match_id).alias("_id"), F.col(home).alias("_home"), F.col(away).alias("_away"), *goals)
    # the teams of a group come before its matches, by name
    teams = m.select(*group, F.explode(F.array(home, away)).alias("_home")).distinct().withColumn("_kind", F.lit(0))
    x = rows.unionByName(teams, allowMissingColumns=True).repartition(*group)
    x = x.sortWithinPartitions(*group, "_kind", F.asc_nulls_last("_day"), F.asc_nulls_last("_id"), F.asc_nulls_last("_home")).drop("_day")
    columns, n = ["_kind", "_id", "_home", "_away", "_f", "_a"], len(group)
    names = [match_id, "team", "pts", "gd", "gf", "played", "rank"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, state, places = None, {}, {}, []
        for b in batches:
            out, ids = [], b.column("_id")
            taken = []
            for i, (g, (kind, id_, h, a, f, against)) in enumerate(zip(zip(*[b.column(j).to_pylist() for j in range(n)]), zip(*[b.column(c).to_pylist() for c in columns]))):
                if g != at:
                    at, number, state, places = g, {}, {}, []
                if not kind:
                    # pts, gd and gf negated, as the least key is first; then the name's place
                    number[h] = len(number)
                    state[h] = (0, 0, 0, number[h], 0)
                    places.append(state[h][:4])
                    continue
                two = (h,) if h == a else (h, a)
                if id_ is not None:
                    for team in two:
                        if team is not None:
                            p, d, q, _, played = state[team]
                            out.append((team, -p, -d, -q, played, bisect_left(places, state[team][:4]) + 1))
                            taken.append(i)
                if f is None or against is None:
                    continue
                for team, own, other in zip(two, (f, against), (against, f)):
                    if team is not None:
                        p, d, q, no, played = state[team]
                        del places[bisect_left(places, (p, d, q, no))]
                        p -= 3 if own > other else own == other
                        state[team] = (p, d - (own - other), q - own, no, played + 1)
                        insort(places, state[team][:4])
            if out:
                team, *numbers = zip(*out)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(taken)), pa.array(team, b.column("_home").type), *[pa.array(c, pa.int64()) for c in numbers]], names=names)

    kinds = dict(matches.dtypes)
    return x.mapInArrow(fold, f"`{match_id}` {kinds[match_id]}, team {kinds[home]}, pts bigint, gd bigint, gf bigint, played bigint, rank bigint")


def by_day(matches: DataFrame, group: list[str], day: str = "date", home: str = "home", away: str = "away", gf: str = "fthg", ga: str = "ftag") -> DataFrame:
    """(group, day, team, pts, gd, gf, played, rank, n_teams) at the start of each day of the group, for all its teams.

    A match without both goals earns nothing; matches without a day or group are left out. rank: points, goal difference, goals, then name.
    """
    side = lambda t, f, a: F.struct(F.col(t).alias("team"), F.col(f).alias("_f"), F.col(a).alias("_a"))
    x = matches.where(F.col(day).isNotNull()).select(*group, day, F.inline(F.array(side(home, gf, ga), side(away, ga, gf))))
    margin = F.col("_f") - F.col("_a")
    earned = {"pts": F.when(margin > 0, 3).when(margin == 0, 1).otherwise(0), "gd": F.coalesce(margin, F.lit(0)), "gf": F.when(margin.isNotNull(), F.col("_f")).otherwise(0), "played": F.when(margin.isNotNull(), 1).otherwise(0)}
    x = x.groupBy(*group, "team", day).agg(*[F.sum(v).cast("long").alias(k) for k, v in earned.items()])
    # each team's days, merged into all days of its group
    own = x.groupBy(*group, "team").agg(F.map_from_entries(F.collect_list(F.struct(day, F.struct(*earned)))).alias("_own"))
    days = x.groupBy(*group).agg(F.collect_set(day).alias("_days"), F.count_distinct("team").alias("n_teams"))
    x = own.join(days, group).select(*group, "team", "n_teams", "_own", F.explode("_days").alias(day))
    x = x.select(*group, day, "team", "n_teams", *[F.col("_own")[F.col(day)][k].alias(f"_{k}") for k in earned])
    w = Window.partitionBy(*group, "team").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    x = x.select(*group, day, "team", "n_teams", *[F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)).cast("long").alias(k) for k in earned])
    rank = F.row_number().over(Window.partitionBy(*group, day).orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), "team"))
    return x.select(*group, day, "team", "pts", "gd", "gf", "played", rank.cast("long").alias("rank"), "n_teams")


def sides(matches: DataFrame, table: DataFrame, group: list[str], match_id: str = "match_id", day: str = "date", home: str = "home", away: str = "away") -> DataFrame:
    """The two sides of each match with their rows of a table by day: (match_id, side, group, day, team, table's columns)."""
    side = lambda name, c: F.struct(F.lit(name).alias("side"), F.col(c).alias("team"))
    x = matches.select(match_id, *group, day, F.inline(F.array(side("home", home), side("away", away))))
    return x.join(table, [*group, day, "team"])


def stakes(table: DataFrame, group: list[str], zones: DataFrame, zone_key: str, match_id: str = "match_id") -> DataFrame:
    """The table with what is still open: rounds left, how many can no longer be caught or can no longer catch up, points at zone borders.

    match_id names the moment that a table's rows share: a match in grid(), the day in by_day(). zones: zone_key, releg_spots and, if
    there are, promo_spots and europe_spots.
    """
    w = Window.partitionBy(*group, match_id)
    more = [c for c in ("promo_spots", "europe_spots") if c in zones.columns]
    x = table.join(zones, zone_key, "left").withColumn("left_rounds", 2 * (F.col("n_teams") - 1) - F.col("played"))
    x = x.withColumn("most", F.col("pts") + 3 * F.col("left_rounds"))
    # teams by points held and by points still possible: far fewer values than teams
    same = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*group, match_id, c))
    x = x.withColumn("_held", F.struct(F.col("pts").alias("v"), same("pts").alias("n"))).withColumn("_most", F.struct(F.col("most").alias("v"), same("most").alias("n")))
    x = x.withColumn("_held", F.collect_set("_held").over(w)).withColumn("_most", F.collect_set("_most").over(w))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    above = total(F.filter("_held", lambda s: s["v"] > F.col("most")))
    below = total(F.filter("_most", lambda s: s["v"] < F.col("pts")))
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("pts"))).over(w)
    x = x.select(
        "*", above.alias("out_of_reach"), below.alias("beaten"), at(F.lit(1)).alias("pts_first"),
        at(F.col("n_teams") - F.col("releg_spots")).alias("pts_last_safe"), at(F.col("n_teams") - F.col("releg_spots") + 1).alias("pts_first_down"),
        *[at(F.col(c)).alias(f"pts_{c.removesuffix('_spots')}") for c in more],
    )
    return x.drop("_held", "_most").select(
        "*",
        (F.col("out_of_reach") >= F.col("n_teams") - F.col("releg_spots")).alias("surely_down"),
        (F.col("beaten") >= F.col("releg_spots")).alias("surely_safe"),
        (F.col("out_of_reach") >= 1).alias("title_gone"),
        *([((F.col("promo_spots") > 0) & (F.col("beaten") >= F.col("n_teams") - F.col("promo_spots"))).alias("surely_up"), ((F.col("promo_spots") > 0) & (F.col("out_of_reach") >= F.col("promo_spots"))).alias("up_gone")] if "promo_spots" in more else []),
        (F.col("rank") <= F.floor(F.col("n_teams") / 2)).alias("top_half"),
        (F.col("rank") > F.col("n_teams") - F.greatest(F.lit(1), F.floor(F.col("n_teams") / 3))).alias("bottom_third"),
    )
