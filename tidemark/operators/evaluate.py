"""Evaluating conditions against outcomes, and searching combinations of conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicate(spec: dict[str, list], columns: list[str], prefix: str = "adv_") -> Column | None:
    """AND over `own` and `other`, and over each OR-group of `any_own` and `any_other`; null counts as false; None if a column is missing."""
    need = [*spec.get("own", []), *[prefix + c for c in spec.get("other", [])]]
    groups = [*spec.get("any_own", []), *[[prefix + c for c in g] for g in spec.get("any_other", [])]]
    if any(c not in columns for c in [*need, *[c for g in groups for c in g]]):
        return None
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    parts = [true(c) for c in need] + [reduce(lambda a, b: a | b, [true(c) for c in g]) for g in groups]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def base_rates(df: DataFrame, keys: list[str], outcomes: list[str]) -> DataFrame:
    """(outcome, keys, base): all outcomes' rates in one aggregation, then unpivoted."""
    g = df.groupBy(*keys).agg(*[F.avg(F.col(o).cast("int")).alias(o) for o in outcomes])
    pairs = ", ".join(f"'{o}', `{o}`" for o in outcomes)
    return g.select(*keys, F.expr(f"stack({len(outcomes)}, {pairs}) as (outcome, base)"))


def hypotheses(df: DataFrame, specs: dict[str, tuple[Column, list[str]]], keys: list[str], outcomes: list[str], season: str = "season", least: int = 10) -> DataFrame:
    """(id, outcome, n, hits, ref, var, seasons, seasons_up) for every hypothesis and outcome in one scan.

    Each row is repeated for the hypotheses true of it and for their outcomes; sums are taken per season first (map-side), then over
    seasons. The reference is the outcome's rate among rows with the same keys.
    """
    w = Window.partitionBy(*keys)
    x = df.select(season, *[c.alias(f"_h_{i}") for i, (c, _) in specs.items()], *[F.struct(F.col(o).cast("int").alias("hit"), F.avg(F.col(o).cast("int")).over(w).alias("ref")).alias(f"_o_{o}") for o in outcomes])
    true = [F.when(F.col(f"_h_{i}"), F.struct(F.lit(i).alias("id"), F.lit(o).alias("outcome"), F.col(f"_o_{o}")["hit"].alias("hit"), F.col(f"_o_{o}")["ref"].alias("ref"))) for i, (_, os) in specs.items() for o in os]
    x = x.select(season, F.inline(F.array_compact(F.array(*true)))).where("hit is not null and ref is not null")
    s = x.groupBy("id", "outcome", season).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("ref").alias("ref"), F.sum(F.col("ref") * (1 - F.col("ref"))).alias("var"))
    big = F.col("n") >= least
    return s.groupBy("id", "outcome").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("ref").alias("ref"), F.sum("var").alias("var"),
        F.count_if(big).alias("seasons"), F.count_if(big & (F.col("hits") - F.col("ref") > 0)).alias("seasons_up"),
    )


def combinations(df: DataFrame, own: list[str], other: list[str], match: list[str], outcome: str | list[str], ref: str | list[str], block: str, prune: int, least: int, canonical: bool = False, prefix: str = "adv_", once: str | None = None) -> DataFrame:
    """(combo, n, hits, ref, var, blocks, agree) of single conditions, pairs and triples (own x other x match), with at least `least` rows.

    outcome, ref: one column each, or as many refs as outcomes: then all outcomes of a combination are counted in the same
    aggregation, and a column `outcome` says which a row is about. Rows where an outcome or its ref is null do not count for it.
    Each row carries the conditions true of it; singles and pairs are counted first, and only pairs of own and other with `prune` rows
    go on to triples (a triple has no more rows than its pair: with prune <= least none is lost). blocks: those that hold 50
    rows at least; agree: those of them whose difference has the sign of the whole.
    canonical: of own x other only the orientation whose own condition comes first or is the same, for outcomes that do
    not tell the sides apart, so that no pair is tested twice as its mirror image; and no conditions of the other side alone.
    once: a column true of one of the two rows of a match; single match conditions are counted on such rows only.
    """
    outcomes, refs = ([outcome], [ref]) if isinstance(outcome, str) else (outcome, ref)
    true = lambda cols, tag: F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(f"{tag}:{c}")) for c in cols]))
    seen = lambda o, r: F.col(o).isNotNull() & F.col(r).isNotNull()
    some = reduce(lambda p, q: p | q, [seen(o, r) for o, r in zip(outcomes, refs, strict=True)])
    numbers = [c for i, (o, r) in enumerate(zip(outcomes, refs)) for c in (F.when(seen(o, r), F.col(o).cast("int")).alias(f"_h{i}"), F.when(seen(o, r), F.col(r)).alias(f"_r{i}"))]
    kept = [f"_{k}{i}" for i in range(len(outcomes)) for k in "hr"] + ["block"]
    x = df.where(some).select(*numbers, F.col(block).alias("block"), true(own, "own").alias("s"), true(other, "other").alias("a"), true(match, "match").alias("m"), F.coalesce(F.col(once), F.lit(False)).alias("_once") if once else F.lit(True).alias("_once"))
    cross = lambda p, q: F.flatten(F.transform(p, lambda u: F.transform(q, lambda v: F.concat_ws("&", u, v))))
    upper = F.flatten(F.transform("s", lambda u: F.transform(F.filter("s", lambda v: v > u), lambda v: F.concat_ws("&", u, v))))
    name = lambda c: F.regexp_replace(c, f"^[a-z]+:({prefix})?", "")
    facing = F.flatten(F.transform("s", lambda u: F.transform(F.filter("a", lambda v: name(u) <= name(v)), lambda v: F.concat_ws("&", u, v)))) if canonical else cross(F.col("s"), F.col("a"))
    alone = F.when(F.col("_once"), F.col("m")).otherwise(F.array().cast("array<string>"))
    first = F.concat(F.col("s"), alone, facing, cross(F.col("s"), F.col("m")), upper, *([] if canonical else [F.col("a"), cross(F.col("a"), F.col("m"))]))

    def blocks(rows: DataFrame) -> DataFrame:
        sums = lambda i: (F.count(f"_r{i}").alias(f"n{i}"), F.sum(f"_h{i}").alias(f"h{i}"), F.sum(f"_r{i}").alias(f"r{i}"), F.sum(F.col(f"_r{i}") * (1 - F.col(f"_r{i}"))).alias(f"v{i}"))
        return rows.groupBy("combo", "block").agg(F.count("*").alias("rows"), *[c for i in range(len(outcomes)) for c in sums(i)])

    def counted(b: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(o).alias("outcome"), *[F.col(f"{k[0]}{i}").alias(k) for k in ("n", "hits", "ref", "var")]) for i, o in enumerate(outcomes)])
        b = b.select("combo", F.inline(each.cast("array<struct<outcome:string,n:bigint,hits:bigint,ref:double,var:double>>"))).where("n > 0")
        t = b.groupBy("combo", "outcome").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("ref").alias("ref"), F.sum("var").alias("var"), F.collect_list(F.when(F.col("n") >= 50, F.signum(F.round(F.col("hits") - F.col("ref"), 9)))).alias("_signs"))
        whole = F.signum(F.round(F.col("hits") - F.col("ref"), 9))
        return t.withColumn("agree", F.size(F.filter("_signs", lambda s: (s == whole) & (s != 0))).cast("long")).withColumn("blocks", F.size("_signs").cast("long")).drop("_signs")

    low = blocks(x.select(*kept, F.explode(first).alias("combo")))
    pairs = low.where(F.col("combo").rlike(r"^own:[^&]+&other:[^&]+$")).groupBy(F.col("combo").alias("pair")).agg(F.sum("rows").alias("rows")).where(F.col("rows") >= prune).select("pair")
    wide = x.withColumn("f", facing).where(F.size("m") > 0).select(*kept, "m", F.explode(F.col("f")).alias("pair"))
    high = blocks(wide.join(pairs, "pair").select(*kept, F.explode(F.transform("m", lambda u: F.concat_ws("&", F.col("pair"), u))).alias("combo")))
    out = counted(low.unionByName(high)).where(F.col("n") >= least)
    return out.drop("outcome") if isinstance(outcome, str) else out


def benjamini_hochberg(df: DataFrame, p: str, q: float, name: str = "fdr") -> DataFrame:
    """Flags the tests that pass at level q; null p-values are no tests. For result tables: one row per test, ranked on one task."""
    tests = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_k"))
    w = Window.orderBy("_p")
    ranked = tests.select("_p", F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_r"), F.sum("_k").over(Window.partitionBy()).alias("_m"))
    cut = ranked.agg(F.max(F.when(F.col("_p") <= q * F.col("_r") / F.col("_m"), F.col("_p"))).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(name, F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")
