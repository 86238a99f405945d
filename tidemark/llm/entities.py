"""Matching entities across sources without keys: a deterministic cascade of exact joins.

Each rule is an equi-join on fewer or weaker attributes than the one before. What a rule resolves is anti-joined away
before the next. The confidence of a pair is the labelled precision of its rule, (right + 1) / (labelled + 2). Labels are given, or
the first and strictest rule supplies them: every later rule is also put to the records that the first resolved, without the
attributes it does not read, and is right where it finds the same partner. The first rule itself is judged by a column
that it does not read. A rule that no label judges has a null confidence.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """name; the right columns; for each alternative (suffix of the name, left columns) to equal them, the first that matches wins;
    what prefers a candidate (least first); label: true or false where a column that the rule leaves aside can judge the pair,
    else null (used for the first rule); spread: (left day, right day, most days apart) besides the equalities; nearer: fewer days
    apart that come first and have a name and confidence of their own, `{name}_{days}_days`."""

    name: str
    right: tuple[str, ...]
    lefts: tuple[tuple[str, tuple[str, ...]], ...]
    prefer: tuple[Column, ...] = ()
    label: Column | None = None
    spread: tuple[str, str, int] | None = field(default=None)
    nearer: tuple[int, ...] = ()


def _best(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rule: Rule) -> DataFrame:
    """(left_id, right_id, rule, _names, _label): the candidate that the rule prefers for each left row that has one. _names: the rule and,
    with a spread, its wider forms, which find the same candidate."""
    ways = F.array(*[F.struct(F.lit(i).alias("_alt"), F.lit(suffix).alias("_suffix"), *[F.col(c).alias(f"_k{j}") for j, c in enumerate(cols)]) for i, (suffix, cols) in enumerate(rule.lefts)])
    a = left.select("*", F.inline(ways))
    on = [F.col(f"_k{j}") == F.col(c) for j, c in enumerate(rule.right)]
    names, tier = F.array(F.lit(rule.name)), F.lit(0)
    if rule.spread:
        # days apart stay an equality: of spans of 2d + 1 days a left row's surroundings touch two at the most
        x, y, d = rule.spread
        span = lambda c: F.floor(c / (2 * d + 1))
        a = a.withColumn("_span", F.explode(F.sequence(span(F.col(x) - d), span(F.col(x) + d))))
        right = right.withColumn("_its", span(F.col(y)))
        apart = F.abs(F.col(x) - F.col(y))
        on += [F.col("_span") == F.col("_its"), apart <= d]
        steps = sorted({*rule.nearer, d})
        tier = reduce(lambda out, n: F.when(apart <= n, n).otherwise(out), reversed(steps), F.lit(d))
        names = F.transform(F.filter(F.array(*[F.lit(n) for n in steps]), lambda n: n >= tier), lambda n: F.concat(F.lit(f"{rule.name}_"), n.cast("string"), F.lit("_days")))
    label = rule.label if rule.label is not None else F.lit(None).cast("boolean")
    order = F.struct(tier.alias("tier"), "_alt", *[c.alias(f"p{i}") for i, c in enumerate(rule.prefer)], F.col(right_id).alias("id"), F.transform(names, lambda n: F.concat(n, "_suffix")).alias("names"), label.alias("label"))
    best = a.join(right, reduce(lambda p, q: p & q, on)).groupBy(left_id).agg(F.min(order).alias("m"))
    return best.select(left_id, F.col("m.id").alias(right_id), F.col("m.names")[0].alias("rule"), F.col("m.names").alias("_names"), F.col("m.label").alias("_label"))


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: list[Rule], labels: DataFrame | None = None, computed: bool = False) -> DataFrame:
    """(left_id, right_id, rule, confidence) with one row per left row; right_id and rule null and confidence 0 for the unmatched.

    left and right have distinct column names and one row per id; rows with a null id are left out; nulls in attributes
    equal nothing. Ties under `prefer` go to the least right_id. A right row may be the match of several left rows.
    labels: optional (left_id, right_id) of known pairs, used for the confidences in place of the first rule's pairs.
    A rule without labels: null confidence. Empty tables give an empty or all-unmatched result.
    computed: left and right read a checkpoint or a staged table already, and are not written again.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    everyone, right = left.where(F.col(left_id).isNotNull()), right.where(F.col(right_id).isNotNull())
    if not computed:
        everyone, right = cut_lineage(everyone), cut_lineage(right)
    first = cut_lineage(_best(everyone, right, left_id, right_id, rules[0]))
    pairs = judged = first
    if labels is not None:
        gold = labels.select(F.col(left_id).alias("_l"), F.col(right_id).alias("_gold")).groupBy("_l").agg(F.min("_gold").alias("_gold"))
        judged = first.drop("_label").join(gold, F.col(left_id) == F.col("_l")).withColumn("_label", F.col("_gold") == F.col(right_id))
    else:
        gold = first.select(F.col(left_id).alias("_l"), F.col(right_id).alias("_gold"))
    judged = judged.select("rule", "_label")
    done = None  # what rules after the first resolved
    for rule in rules[1:]:
        rest = everyone if done is None else everyone.join(done.select(left_id), left_id, "left_anti")
        if labels is not None:
            rest = rest.join(first.select(left_id), left_id, "left_anti")
        found = cut_lineage(_best(rest, right, left_id, right_id, rule).drop("_label").join(gold, F.col(left_id) == F.col("_l"), "left").drop("_l"))
        judged = judged.unionByName(found.where("_gold is not null").select(F.explode("_names").alias("rule"), (F.col("_gold") == F.col(right_id)).alias("_label")))
        # records that the first rule resolved only judge
        new = (found if labels is not None else found.where("_gold is null")).drop("_gold", "_names")
        done = new if done is None else done.unionByName(new)
        pairs = pairs.select(left_id, right_id, "rule").unionByName(new)
    right_n, n_all = F.sum(F.when(F.col("_label"), 1).otherwise(0)), F.count("_label")
    # one row per rule
    confidence = judged.groupBy("rule").agg(F.when(n_all > 0, (right_n + 1) / (n_all + 2)).alias("confidence"))
    pairs = pairs.select(left_id, right_id, "rule").join(F.broadcast(confidence), "rule", "left")
    out = everyone.select(left_id).join(pairs, left_id, "left")
    return out.select(left_id, right_id, "rule", F.when(F.col(right_id).isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"))


def fixture_rules(far: int = 10) -> list[Rule]:
    """Rules for two listings of fixtures: e_* against m_* (league, clubs, local day, kick-off in microseconds).

    Kick-off and clubs; then the day; then days around it, for listings whose time was not kept up to date; each time first
    with the clubs in the listed order, then swapped.
    """
    gap = F.abs(F.col("e_us") - F.col("m_us"))
    days = F.abs(F.col("e_day") - F.col("m_day"))
    right = ("m_league", "m_home", "m_away")
    straight, swapped = ("e_league", "e_home", "e_away"), ("e_league", "e_away", "e_home")
    # the match day is a column of its own, recorded apart from the kick-off text
    same_day = F.col("e_day") == F.col("m_day")
    ways = lambda *more: (("", (*straight, *more)), ("_swapped", (*swapped, *more)))
    return [
        Rule("kickoff", (*right, "m_us"), ways("e_us"), (days,), same_day),
        Rule("day", (*right, "m_day"), ways("e_day"), (F.coalesce(gap, F.lit(0)),)),
        Rule("within", right, ways(), (days, F.coalesce(gap, F.lit(0))), None, ("e_day", "m_day", far), (1,)),
    ]
