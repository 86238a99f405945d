"""Queries of further operators: held-out seasons, upcoming rows, fallbacks, returns, stable findings, ordered reports; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import evaluate, pairs, pit
from tidemark.plans import form, form_sql, prospective
from tidemark.plans.form import r6
from tidemark.session import table

VENUE = ["league", "season", "side"]


def b6_holdout(spark, base):
    """Matches of all seasons but the last, which is held out before anything is derived; the filter reaches the scan."""
    m = table(spark, base, "matches").select("match_id", "season", "date")
    last = m.agg(F.max("season")).first()[0]  # one value
    return m.where(~F.col("season").isin([last])).groupBy("season").agg(F.count_distinct("match_id").alias("n"))


def b15_upcoming(spark, base):
    """Open signals as rows of matches yet to come, after the history of both clubs: what their windows hold."""
    m = form.now(spark, base).select("match_id", "league", "date", "home", "away", "fthg", "ftag")
    j = table(spark, base, "journal").where("not regle").select(F.concat(F.lit("VIRT_"), "event_id").alias("match_id"), "league", F.to_date("commence").alias("date"), F.col("home_fd").alias("home"), F.col("away_fd").alias("away"))
    j = j.groupBy("match_id").agg(F.min(F.struct("league", "date", "home", "away")).alias("x")).select("match_id", "x.*")
    x = pairs.two_sided(m.unionByName(j, allowMissingColumns=True), ["match_id", "date"], {"team": ("home", "away"), "gf": ("fthg", "ftag"), "ga": ("ftag", "fthg")})
    x = x.withColumn("played", F.col("gf").isNotNull() & F.col("ga").isNotNull())
    x = pit.streak_before(x, form.TEAM, form.ORDER, F.coalesce(F.col("gf") <= F.col("ga"), F.lit(False)), "winless", "played")
    x = pit.rolling_prev(x, form.TEAM, form.ORDER, {"gf_l5": (F.col("gf"), "avg")}, 5, played="played")
    return x.where(F.col("match_id").startswith("VIRT_")).select("match_id", "side", "team", "winless", r6(F.col("gf_l5")).alias("gf_l5"))


def c5_base_fallback(spark, base):
    """For each league, season and side the rate of over25 in the season before; where there is none, the mean of all groups' rates."""
    rates = evaluate.base_rates(form._outcomes(spark, base), VENUE, ["over25"]).where("base is not null")
    order = rates.select("season").distinct().select("season", F.row_number().over(Window.orderBy("season")).alias("i"))  # the seasons, a few
    now = rates.join(F.broadcast(order), "season")
    before = now.select("league", "side", (F.col("i") + 1).alias("i"), F.col("base").alias("_before"))
    mean = rates.agg(F.avg("base").alias("_mean"))  # one row
    x = now.join(before, ["league", "side", "i"], "left").join(F.broadcast(mean))
    return x.select(*VENUE, r6(F.coalesce("_before", "_mean")).alias("ref"), F.col("_before").isNull().alias("fallback"))


def g2_returns(spark, base):
    """Flat stakes on the own win per hypothesis: rows with a price, mean and deviation of the gain, interval, share priced at the close."""
    x = form._conditions(spark, base).withColumn("close", F.when(F.col("side") == "home", F.col("psch")).otherwise(F.col("psca")))
    x = x.withColumn("paid", F.coalesce("close", "price")).where(F.col("paid").isNotNull() & F.col("win_own").isNotNull())
    gain = F.when(F.col("win_own"), F.col("paid") - 1).otherwise(-1.0)
    true = F.array_compact(F.array(*[F.when(evaluate.predicate(s, x.columns), F.lit(i)) for i, (s, _) in form.SPECS.items()]))
    g = x.select(gain.alias("gain"), F.col("close").isNotNull().cast("int").alias("close"), F.explode(true).alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.avg("gain").alias("m"), F.coalesce(F.stddev_samp("gain"), F.lit(0.0)).alias("sd"), F.avg("close").alias("c"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return g.select("id", "n", r6(F.col("m")).alias("roi"), r6(F.col("sd")).alias("sd"), r6(F.col("m") - half).alias("low"), r6(F.col("m") + half).alias("high"), r6(F.col("c")).alias("at_close"))


def g7_mean_base(spark, base):
    """The mean of the venue's rate over the rows of each hypothesis, rows without a rate left out."""
    x = form._conditions(spark, base)
    rate = evaluate.base_rates(x, VENUE, ["over25"]).drop("outcome")
    true = F.array_compact(F.array(*[F.when(evaluate.predicate(s, x.columns), F.lit(i)) for i, (s, _) in form.SPECS.items()]))
    y = x.select(*VENUE, F.explode(true).alias("id")).groupBy("id", *VENUE).agg(F.count("*").alias("n")).join(F.broadcast(rate), VENUE).where("base is not null")
    return y.groupBy("id").agg(r6(F.sum(F.col("base") * F.col("n")) / F.sum("n")).alias("base"), F.sum("n").alias("n"))


def g10_intervals(spark, base):
    """Wilson intervals of each candidate's settled signals."""
    g = prospective.g10_scorecard(spark, base)
    lo, hi = stats.wilson(F.col("hits"), F.col("n"))
    return g.select("candidat", "n", "hits", r6(lo).alias("low"), r6(hi).alias("high"))


def s2_results(spark, base):
    """Results in the order of a report: those that pass first, then by hypothesis size, then by difference."""
    return form.g4_fdr(spark, base).orderBy(F.desc("fdr"), F.desc("n"), F.desc("z"), "id", "outcome")


def s5_unmatched(spark, base):
    """The first 30 names that no club was found for: a report of fixed length."""
    return prospective.c10_fuzzy_names(spark, base).where("club is null").select("name").distinct().orderBy("name").limit(30)


def x7_stable(spark, base):
    """Conditions whose difference has one sign in two blocks, or in all that hold 50 rows if these are fewer (one at least)."""
    own = ["LONG_WINLESS", "WINNING", "SCORING", "LEAKING"]
    x = pairs.blocks(form._ref(form._conditions(spark, base)), "season", 3, "block")
    c = evaluate.combinations(x, own, ["adv_" + o for o in own], ["AT_HOME", "CUP_TIE"], "over25", "ref", "block", 30, 30)
    return c.select("combo", "n", "blocks", (F.col("agree") >= F.greatest(F.least(F.lit(2), F.col("blocks")), F.lit(1))).alias("stable"))


def x9_tests(spark, base):
    """How many tests had the support, and how many of these could be computed (some variance)."""
    own = ["LONG_WINLESS", "WINNING", "SCORING", "LEAKING"]
    x = pairs.blocks(form._ref(form._conditions(spark, base)), "season", 3, "block")
    c = evaluate.combinations(x, own, ["adv_" + o for o in own], ["AT_HOME", "CUP_TIE"], "over25", "ref", "block", 30, 30)
    return c.agg(F.count("*").alias("supported"), F.count_if(F.col("var") > 0).alias("computed"))


QUERIES = {f.__name__: f for f in (b6_holdout, b15_upcoming, c5_base_fallback, g2_returns, g7_mean_base, g10_intervals, s2_results, s5_unmatched, x7_stable, x9_tests)}

_S = form_sql
_WHERE = {i: w for i, w, _ in _S._H}
_EACH = lambda src: " UNION ALL ".join(f"SELECT '{i}' AS id, * FROM {src} WHERE {w}" for i, w in _WHERE.items())
ORACLE = {
    "b6_holdout": "SELECT season, count(DISTINCT match_id) AS n FROM matches WHERE season < (SELECT max(season) FROM matches) GROUP BY season",
    "b15_upcoming": _S.M + """,
v AS (SELECT 'VIRT_' || event_id AS match_id, min((league, CAST(commence AS DATE), home_fd, away_fd)) AS x FROM journal WHERE NOT regle GROUP BY event_id),
a AS (SELECT match_id, date, home, away, fthg, ftag FROM m UNION ALL SELECT match_id, x[2], x[3], x[4], NULL, NULL FROM v),
s AS (SELECT match_id, date, 'home' AS side, home AS team, fthg AS gf, ftag AS ga FROM a UNION ALL SELECT match_id, date, 'away', away, ftag, fthg FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, match_id) AS i FROM s WHERE gf IS NOT NULL AND ga IS NOT NULL),
u AS (SELECT s.match_id, s.side, s.team, (SELECT count(*) FROM p WHERE p.team = s.team AND (p.date, p.match_id) < (s.date, s.match_id)) AS k FROM s WHERE match_id LIKE 'VIRT_%')
SELECT match_id, side, team, k - coalesce((SELECT max(i) FROM p WHERE p.team = u.team AND p.i <= u.k AND gf > ga), 0) AS winless,
  CASE WHEN k >= 5 THEN (SELECT round(avg(gf), 6) FROM p WHERE p.team = u.team AND p.i > u.k - 5 AND p.i <= u.k) END AS gf_l5 FROM u""",
    "c5_base_fallback": _S.OC + """, r AS (SELECT league, season, side, avg(CAST(over25 AS INT)) AS base FROM oc GROUP BY ALL HAVING count(over25) > 0), s AS (SELECT season, row_number() OVER (ORDER BY season) AS i FROM (SELECT DISTINCT season FROM r)),
n AS (SELECT r.*, i FROM r JOIN s ON r.season = s.season) SELECT a.league, a.season, a.side, round(coalesce(b.base, (SELECT avg(base) FROM r)), 6) AS ref, b.base IS NULL AS fallback FROM n a LEFT JOIN n b ON a.league = b.league AND a.side = b.side AND b.i = a.i - 1""",
    "g2_returns": _S.COND + f""", y AS (SELECT *, CASE WHEN side = 'home' THEN psch ELSE psca END AS cl FROM c), w AS (SELECT *, CASE WHEN win_own THEN coalesce(cl, price) - 1 ELSE -1 END AS gain FROM y WHERE coalesce(cl, price) IS NOT NULL AND win_own IS NOT NULL),
e AS ({_EACH('w')}), g AS (SELECT id, count(*) AS n, avg(gain) AS m, coalesce(stddev_samp(gain), 0) AS sd, avg(CASE WHEN cl IS NOT NULL THEN 1 ELSE 0 END) AS k FROM e GROUP BY id)
SELECT id, n, round(m, 6) AS roi, round(sd, 6) AS sd, round(m - 1.96 * sd / sqrt(n), 6) AS low, round(m + 1.96 * sd / sqrt(n), 6) AS high, round(k, 6) AS at_close FROM g""",
    "g7_mean_base": _S.COND + f""", w AS (SELECT *, avg(CAST(over25 AS INT)) OVER (PARTITION BY league, season, side) AS rate FROM c), e AS ({_EACH('w')}) SELECT id, round(avg(rate), 6) AS base, count(rate) AS n FROM e GROUP BY id HAVING count(rate) > 0""",
    "g10_intervals": f"""WITH j AS (SELECT DISTINCT ON (event_id, candidat, team_fd) * FROM journal), g AS (SELECT candidat, count(*) FILTER (regle AND issue IS NOT NULL) AS n, CAST(coalesce(sum(CAST(issue AS INT)) FILTER (regle), 0) AS BIGINT) AS hits FROM j GROUP BY candidat)
SELECT candidat, n, hits, CASE WHEN n > 0 THEN round(greatest(0.0, {_S._WIL('hits', 'n')[0]}), 6) ELSE 0.0 END AS low, CASE WHEN n > 0 THEN round(least(1.0, {_S._WIL('hits', 'n')[1]}), 6) ELSE 0.0 END AS high FROM g""",
    "s2_results": _S.ORACLE["g4_fdr"],
    "s5_unmatched": f"SELECT DISTINCT name FROM ({prospective.ORACLE['c10_fuzzy_names']}) WHERE club IS NULL ORDER BY name LIMIT 30",
    "x7_stable": _S.SEARCH + ", b AS (SELECT combo, count(*) FILTER (n >= 50) AS blocks FROM kb GROUP BY combo) SELECT kr.combo, kr.n, blocks, agree >= greatest(least(2, blocks), 1) AS stable FROM kr JOIN b ON kr.combo = b.combo",
    "x9_tests": _S.SEARCH + ", v AS (SELECT combo, sum(r * (1 - r)) AS var FROM k GROUP BY combo) SELECT count(*) AS supported, count(*) FILTER (var > 0) AS computed FROM kr JOIN v ON kr.combo = v.combo",
}
