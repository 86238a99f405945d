"""Queries: reshaping, ordered windows, standings and grouped evaluation over the match tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import fair, stats
from tidemark.operators import evaluate, pairs, pit, standings
from tidemark.plans import form_sql
from tidemark.session import table

INTS = ["fthg", "ftag", "hthg", "htag", "hy", "ay", "hr", "ar"]
PRICES = ["psh", "psd", "psa", "psch", "pscd", "psca", "p_o25", "p_u25", "pc_o25", "pc_u25"]
TEAM, ORDER, GROUP = ["team"], ["date", "match_id"], ["league", "season"]
PLAYED = "played"  # the column that says whether a row counts
# What each outcome token means, seen from one side.
OUTCOMES = {
    "win_own": "gf > ga", "win_other": "ga > gf", "not_lost": "gf >= ga", "not_won": "ga >= gf", "over25": "gf + ga >= 3", "under25": "gf + ga <= 2", "over35": "gf + ga >= 4",
    "under15": "gf + ga <= 1", "both_score": "gf > 0 AND ga > 0", "half_over05": "ht_gf + ht_ga >= 1", "half_over15": "ht_gf + ht_ga >= 2", "half_none": "ht_gf + ht_ga = 0",
    "half_own": "ht_gf > ht_ga", "half_other": "ht_ga > ht_gf", "second_own": "gf - ht_gf > ga - ht_ga", "second_other": "ga - ht_ga > gf - ht_gf", "cards_over45": "cards + cards_opp >= 5",
    "own_over15": "gf >= 2", "other_over15": "ga >= 2", "own_under15": "gf <= 1", "other_under15": "ga <= 1", "clean_own": "ga = 0", "clean_other": "gf = 0",
}


def now(spark: SparkSession, base: str) -> DataFrame:
    """matches as last recorded, one row per match_id, goals and cards as whole numbers."""
    m = pairs.current(table(spark, base, "matches"), "match_id", "recorded_at", ["league", "season", "date", "home", "away", "referee", *INTS, *PRICES])
    return m.withColumns({c: F.col(c).cast("long") for c in INTS})


def long(spark: SparkSession, base: str) -> DataFrame:
    """One row per match and side, with derived columns; an unplayed match is neither won, drawn nor lost, and not `played`."""
    m = now(spark, base).withColumns({"hc": F.coalesce("hy", F.lit(0)) + F.coalesce("hr", F.lit(0)), "ac": F.coalesce("ay", F.lit(0)) + F.coalesce("ar", F.lit(0))})
    swapped = {"team": ("home", "away"), "opp": ("away", "home"), "gf": ("fthg", "ftag"), "ga": ("ftag", "fthg"), "ht_gf": ("hthg", "htag"), "ht_ga": ("htag", "hthg"), "cards": ("hc", "ac"), "cards_opp": ("ac", "hc"), "price": ("psh", "psa")}
    x = pairs.two_sided(m, ["match_id", "league", "season", "date", "referee", "psch", "pscd", "psca"], swapped)
    no = lambda c: F.coalesce(c, F.lit(False))
    return x.withColumns({"win": no(F.col("gf") > F.col("ga")), "loss": no(F.col("gf") < F.col("ga")), "draw": no(F.col("gf") == F.col("ga")), "margin": F.col("gf") - F.col("ga"), "total": F.col("gf") + F.col("ga"), "played": F.col("gf").isNotNull() & F.col("ga").isNotNull()})


def r6(c: Column) -> Column:
    return F.round(c, 6)


def a17_dedupe(spark, base):
    """Distinct archive rows by the snapshot key, counted by event."""
    key = ["snapshot_ts", "event_id", "bookmaker", "market", "outcome", "point"]
    return table(spark, base, "odds_archive").select(*key).distinct().groupBy("event_id").agg(F.count("*").alias("n"))


def a8_surrogate_key(spark, base):
    w = Window.partitionBy("league", "season").orderBy("date", "home", "away", "match_id")
    return now(spark, base).select("match_id", F.concat_ws("_", "league", "season", (F.row_number().over(w) - 1).cast("string")).alias("new_id"))


def a10_price_coverage(spark, base):
    return now(spark, base).groupBy("league").agg(r6(F.avg(F.col("psch").isNotNull().cast("int"))).alias("share"))


def b1_two_sided(spark, base):
    return long(spark, base).select("match_id", "side", "team", "opp", "gf", "ga", "win", "draw", "loss", "margin", "total", "cards")


def b7_opponent_view(spark, base):
    x = pit.streak_before(long(spark, base), TEAM, ORDER, F.col("win"), "run", PLAYED)
    return pairs.opponent_view(x.select("match_id", "side", "run"), "match_id", ["run"])


def w1_streak_before(spark, base):
    x = long(spark, base)
    for name, flag in (("won", F.col("win")), ("winless", ~F.col("win")), ("drawn", F.col("draw")), ("goalless", F.coalesce(F.col("gf") == 0, F.lit(False)))):
        x = pit.streak_before(x, TEAM, ORDER, flag, name, PLAYED)
    return x.select("match_id", "side", "won", "winless", "drawn", "goalless")


def w2_rolling_prev(spark, base):
    ind = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    x = pit.rolling_prev(long(spark, base), TEAM, ORDER, {"gf_l5": (F.col("gf"), "avg"), "ga_l5": (F.col("ga"), "avg"), "cards_l5": (F.col("cards"), "avg"), "gf_max_l5": (F.col("gf"), "max")}, 5, played=PLAYED)
    x = pit.rolling_prev(x, TEAM, ORDER, {"won_l3": (F.col("win").cast("int"), "sum")}, 3, played=PLAYED)
    x = pit.rolling_prev(x, TEAM, ORDER, {"over35_l4": (ind(F.col("total") >= 4), "sum"), "half_l4": (ind(F.col("ht_gf") + F.col("ht_ga") >= 2), "sum"), "gf_std_l4": (F.col("gf"), "std")}, 4, played=PLAYED)
    return x.select("match_id", "side", *[r6(F.col(c)).alias(c) for c in ("gf_l5", "ga_l5", "cards_l5", "gf_std_l4")], "gf_max_l5", "won_l3", "over35_l4", "half_l4")


def w3_lags(spark, base):
    x = pit.lagged(pit.lagged(long(spark, base), TEAM, ORDER, "margin", [1, 2, 3], PLAYED), TEAM, ORDER, "price", [1], PLAYED)
    return x.select("match_id", "side", "margin_m1", "margin_m2", "margin_m3", "price_m1")


def w9_rest_days(spark, base):
    x = pit.lagged(long(spark, base), TEAM, ORDER, "date", [1], PLAYED)
    return x.select("match_id", "side", F.datediff("date", "date_m1").cast("long").alias("rest"))


def w11_venue_streak(spark, base):
    return pit.streak_before(long(spark, base), ["team", "side"], ORDER, F.col("win"), "run", PLAYED).select("match_id", "side", "run")


def w12_season_to_date(spark, base):
    x = pit.to_date(long(spark, base), ["team", "side", "season"], ORDER, F.col("win").cast("int"), "won", PLAYED)
    return x.select("match_id", "side", r6(F.col("won_mean")).alias("won_mean"), "won_n")


def w16_offset_window(spark, base):
    x = pit.rolling_prev(long(spark, base), TEAM, ORDER, {"gf_l6_10": (F.col("gf"), "avg")}, 5, offset=5, played=PLAYED)
    return x.select("match_id", "side", r6(F.col("gf_l6_10")).alias("gf_l6_10"))


def w17_season_end(spark, base):
    """Win rate over the last 8 matches of each season, and how many of the three seasons before had one of 0.65 at least."""
    x = long(spark, base)
    w = Window.partitionBy("team", "season").orderBy(F.desc("date"), F.desc("match_id"))
    last = x.where(PLAYED).withColumn("_n", F.row_number().over(w)).where("_n <= 8").groupBy("team", "season").agg(F.avg(F.col("win").cast("int")).alias("rate"), F.count("*").alias("_k")).where("_k = 8")
    numbered = x.select("season").distinct().select("season", F.row_number().over(Window.orderBy("season")).alias("i"))  # the seasons, a few
    mine = x.select("team", "season").distinct().join(numbered, "season")
    past = last.join(numbered, "season").select("team", F.col("i").alias("pi"), "rate")
    past = past.select("team", F.explode(F.array(*[F.col("pi") + k for k in (1, 2, 3)])).alias("i"), "rate")
    s = past.groupBy("team", "i").agg(F.count_if(F.col("rate") >= 0.65).alias("strong"))
    out = mine.join(s, ["team", "i"], "left").join(last.select("team", "season", "rate"), ["team", "season"], "left")
    return out.select("team", "season", r6(F.col("rate")).alias("rate"), F.coalesce("strong", F.lit(0)).cast("long").alias("strong"))


def _meetings(spark, base):
    return now(spark, base).select("match_id", "date", "home", "away", "fthg", "ftag", (_cards()).alias("cards"), (F.col("fthg").isNotNull() & F.col("ftag").isNotNull()).alias("played"), *pairs.unordered(F.col("home"), F.col("away")))


def _cards():
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("ay", "hr", "ar")), F.coalesce(F.col("hy"), F.lit(0)))


def _n(c):
    return F.coalesce(c, F.lit(0))


PAIR = ["pair_a", "pair_b"]


def w18_pair_last5(spark, base):
    x, w, past = pit.before(_meetings(spark, base), PAIR, ORDER, PLAYED, -5, -1)
    count = lambda c: _n(F.sum(past(c.cast("int"))).over(w))
    return x.select("match_id", F.count(past(F.lit(1))).over(w).alias("n"), count((F.col("fthg") > 0) & (F.col("ftag") > 0)).alias("both"), count(F.col("fthg") + F.col("ftag") <= 2).alias("under"))


def w19_same_host(spark, base):
    x, w3, past = pit.before(_meetings(spark, base), ["home", "away"], ORDER, PLAYED, -3, -1)
    x, w5, _ = pit.before(x, ["home", "away"], ORDER, PLAYED, -5, -1)
    count = lambda c, w: _n(F.sum(past(c.cast("int"))).over(w))
    return x.select("match_id", F.count(past(F.lit(1))).over(w3).alias("n3"), count(F.col("fthg") > F.col("ftag"), w3).alias("host_won"), count(F.col("ftag") > F.col("fthg"), w5).alias("guest_won"))


def w20_last_loser(spark, base):
    """Who lost the last meeting by two goals at least."""
    loser = F.when(F.col("fthg") - F.col("ftag") >= 2, F.col("away")).when(F.col("ftag") - F.col("fthg") >= 2, F.col("home"))
    return pit.lagged(_meetings(spark, base).withColumn("loser", loser), PAIR, ORDER, "loser", [1], PLAYED).select("match_id", F.col("loser_m1").alias("loser"))


def w21_pair_cards(spark, base):
    """Mean cards of the last five meetings, of three at least."""
    x = pit.rolling_prev(_meetings(spark, base), PAIR, ORDER, {"m": (F.col("cards"), "avg")}, 5, least=3, played=PLAYED)
    return x.select("match_id", r6(F.col("m")).alias("cards_mean"))


def w22_range_history(spark, base):
    """Mean cards and matches of the referee in the 730 days before."""
    m = now(spark, base).where("referee is not null").withColumn("cards", F.when(F.col("fthg").isNotNull(), _cards()))
    x = pit.range_history(m, ["referee"], F.unix_date("date"), 730, F.col("cards"), "cards")
    return x.select("match_id", r6(F.col("cards_mean")).alias("cards_mean"), "cards_n")


def w4_streak_earlier(spark, base):
    """The winless run as it stood three matches before."""
    x = pit.streak_before(long(spark, base), TEAM, ORDER, ~F.col("win"), "winless", PLAYED)
    return pit.lagged(x, TEAM, ORDER, "winless", [3], PLAYED).select("match_id", "side", "winless_m3")


def _halves(x: DataFrame) -> DataFrame:
    """Windows over the halves: four matches, and five for what was conceded."""
    ind = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    half, late = F.col("ht_gf") + F.col("ht_ga"), F.col("gf") - F.col("ht_gf")
    x = pit.rolling_prev(x, TEAM, ORDER, {"ga2_l5": (ind(F.col("ga") >= 2), "sum"), "ht_ga_l5": (F.col("ht_ga"), "sum")}, 5, played=PLAYED)
    return pit.rolling_prev(x, TEAM, ORDER, {
        "ht_for": (ind(F.col("ht_gf") > 0), "sum"), "ht_gf_l4": (F.col("ht_gf"), "avg"), "ht_against": (ind(F.col("ht_ga") > 0), "sum"), "ht_ga_l4": (F.col("ht_ga"), "avg"), "late_for": (ind(late > 0), "sum"), "late_diff": (late - (F.col("ga") - F.col("ht_ga")), "avg"),
        "h15_l4": (ind(half >= 2), "sum"), "h0_l4": (ind(half == 0), "sum"), "o35_l4": (ind(F.col("total") >= 4), "sum"), "u15_l4": (ind(F.col("total") <= 1), "sum"),
    }, 4, played=PLAYED)


HALVES = ["ga2_l5", "ht_ga_l5", "ht_for", "ht_gf_l4", "ht_against", "ht_ga_l4", "late_for", "late_diff", "h15_l4", "h0_l4", "o35_l4", "u15_l4"]


def w8_halves(spark, base):
    return _halves(long(spark, base)).select("match_id", "side", *[r6(F.col(c)).alias(c) if c.endswith(("gf_l4", "ga_l4", "diff")) else c for c in HALVES])


def w14_home_last10(spark, base):
    """Goals conceded and clean sheets over the last ten matches at home."""
    x = pit.rolling_prev(long(spark, base), ["team", "side"], ORDER, {"ga_l10": (F.col("ga"), "avg"), "clean_l10": ((F.col("ga") == 0).cast("int"), "sum")}, 10, played=PLAYED)
    return x.where("side = 'home'").select("match_id", r6(F.col("ga_l10")).alias("ga_l10"), "clean_l10")


def w24_first_since(spark, base):
    return pit.first_since(long(spark, base), ["team", "season"], ORDER, F.col("margin") <= -3, "since", PLAYED).select("match_id", "side", "since")


def e1_standings(spark, base):
    """The sequential fold: matches of a day see those of the same day before them."""
    return standings.sequential(now(spark, base), GROUP)


def e1_standings_strict(spark, base):
    m = now(spark, base)
    return standings.sides(m, standings.by_day(m, GROUP), GROUP).select("match_id", "team", "pts", "gd", "gf", "played", "rank")


def _stakes(spark, base):
    z = table(spark, base, "leagues").select("league", "releg_spots", "promo_spots", "europe_spots").dropDuplicates(["league"])
    m = now(spark, base)
    return standings.sides(m, standings.stakes(standings.by_day(m, GROUP), GROUP, z, "league", "date"), GROUP)


def e7_stakes(spark, base):
    return _stakes(spark, base).select("match_id", "team", "left_rounds", "out_of_reach", "beaten", "pts_first", "pts_last_safe", "pts_first_down", "pts_promo", "pts_europe", "surely_down", "surely_safe", "title_gone", "surely_up", "up_gone", "top_half", "bottom_third")


def _records(x: DataFrame, spark, base) -> DataFrame:
    """x (sides of matches) with the season's record so far against opponents then in the top half and in the bottom third."""
    m = now(spark, base)
    t = standings.sides(m, standings.by_day(m, GROUP), GROUP).select("match_id", F.col("team").alias("opp"), (F.col("rank") <= F.floor(F.col("n_teams") / 2)).alias("_top"), (F.col("rank") > F.col("n_teams") - F.greatest(F.lit(1), F.floor(F.col("n_teams") / 3))).alias("_bottom"))
    x = x.join(t, ["match_id", "opp"], "left")
    w = pit.over(["team", "season"], ORDER).rowsBetween(*pit.PAST)
    total = lambda c: _n(F.sum(F.coalesce(c & F.col(PLAYED), F.lit(False)).cast("int")).over(w))
    return x.select("*", total(F.col("_top")).alias("top_n"), total(F.col("_top") & (F.col("win") | F.col("draw"))).alias("top_taken"), total(F.col("_bottom")).alias("low_n"), total(F.col("_bottom") & F.col("win")).alias("low_won"))


def w23_record_vs_top(spark, base):
    return _records(long(spark, base), spark, base).select("match_id", "side", "top_taken", "top_n", "low_won", "low_n")


def _outcomes(spark, base):
    """Sides of matches with all outcomes, null where there is no result."""
    return long(spark, base).withColumns({k: F.when(F.col(PLAYED), F.expr(v)) for k, v in OUTCOMES.items()})


def l_outcomes(spark, base):
    return _outcomes(spark, base).select("match_id", "side", *OUTCOMES)


def g1_base_rates(spark, base):
    return evaluate.base_rates(_outcomes(spark, base), ["league", "season", "side"], list(OUTCOMES)).select("outcome", "league", "season", "side", r6(F.col("base")).alias("base"))


def _conditions(spark, base):
    x = _outcomes(spark, base)
    x = pit.streak_before(x, TEAM, ORDER, ~F.col("win"), "winless", PLAYED)
    x = pit.streak_before(x, TEAM, ORDER, F.col("win"), "won", PLAYED)
    x = pit.rolling_prev(x, TEAM, ORDER, {"gf_l5": (F.col("gf"), "sum"), "ga_l5": (F.col("ga"), "sum")}, 5, played=PLAYED)
    no = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumns({"LONG_WINLESS": no(F.col("winless") >= 3), "WINNING": no(F.col("won") >= 2), "SCORING": no(F.col("gf_l5") >= 8), "LEAKING": no(F.col("ga_l5") >= 8), "AT_HOME": F.col("side") == "home", "CUP_TIE": F.col("league") == "CUP"})
    return pairs.opponent_view(x, "match_id", ["LONG_WINLESS", "WINNING", "SCORING", "LEAKING"])


SPECS = {
    "H1": ({"own": ["LONG_WINLESS"]}, ["win_other", "not_won"]), "H2": ({"own": ["WINNING"], "other": ["LONG_WINLESS"]}, ["win_own", "own_over15"]), "H3": ({"own": ["LEAKING"], "other": ["LEAKING"]}, ["over25", "both_score"]),
    "H4": ({"own": ["SCORING", "AT_HOME"]}, ["win_own"]), "H5": ({"own": ["CUP_TIE"], "any_own": [["WINNING", "SCORING"]]}, ["over25"]),
}


def g2_hypotheses(spark, base):
    x = _conditions(spark, base)
    specs = {i: (evaluate.predicate(s, x.columns), os) for i, (s, os) in SPECS.items()}
    h = evaluate.hypotheses(x, specs, ["league", "season", "side"], sorted({o for _, os in SPECS.values() for o in os}))
    return h.select("id", "outcome", "n", "hits", r6(F.col("ref")).alias("ref"), r6(F.col("var")).alias("var"), "seasons", "seasons_up")


def g4_fdr(spark, base):
    """z of each hypothesis and which pass Benjamini-Hochberg at 0.1."""
    h = g2_hypotheses(spark, base).withColumn("z", stats.z_score(F.col("hits"), F.col("ref"), F.col("var"))).withColumn("p", stats.p_two_sided("z"))
    lo, hi = stats.wilson(F.col("hits"), F.col("n"))
    return evaluate.benjamini_hochberg(h, "p", 0.1).select("id", "outcome", "n", r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"), r6(lo).alias("low"), r6(hi).alias("high"), "fdr")


def f17_wilson(spark, base):
    g = _outcomes(spark, base).where(PLAYED).groupBy("league", "side").agg(F.count("*").alias("n"), F.sum(F.col("win").cast("int")).alias("hits"))
    lo, hi = stats.wilson(F.col("hits"), F.col("n"))
    return g.select("league", "side", "n", "hits", r6(lo).alias("low"), r6(hi).alias("high"))


def _ref(x: DataFrame) -> DataFrame:
    return x.withColumn("ref", F.avg(F.col("over25").cast("int")).over(Window.partitionBy("league", "season", "side")))


def x2_search(spark, base):
    """Single, double and triple conditions for over25 with at least 30 rows."""
    x = pairs.blocks(_ref(_conditions(spark, base)), "season", 3, "block")
    own = ["LONG_WINLESS", "WINNING", "SCORING", "LEAKING"]
    c = evaluate.combinations(x, own, ["adv_" + o for o in own], ["AT_HOME", "CUP_TIE"], "over25", "ref", "block", 30, 30)
    return c.select("combo", "n", "hits", r6(F.col("ref")).alias("ref"), "agree")


def x5_search_canonical(spark, base):
    """The same search without mirror images; single match conditions count each match once."""
    x = pairs.blocks(_ref(_conditions(spark, base)), "season", 3, "block")
    own = ["LONG_WINLESS", "WINNING", "SCORING", "LEAKING"]
    c = evaluate.combinations(x, own, ["adv_" + o for o in own], ["AT_HOME", "CUP_TIE"], "over25", "ref", "block", 30, 30, canonical=True, once="AT_HOME")
    return c.select("combo", "n", "hits", r6(F.col("ref")).alias("ref"), "agree")


OWN = [
    "WON_RUN", "WON_RUN_WIDE", "WINLESS_RUN", "DRAWN_RUN", "BLUNT", "PROLIFIC", "LEAKY", "REVIVED", "AFTER_HEAVY_LOSS", "AFTER_WIDE_WIN", "AFTER_UPSET",
    "STRONG_FIRST_HALF", "LEAKY_FIRST_HALF", "TIGHT_FIRST_HALF", "STRONG_SECOND_HALF", "HALF_OVER15_OFTEN", "HALF_NONE_OFTEN", "OVER35_OFTEN", "UNDER15_OFTEN", "CARDED",
    "FORTRESS", "WEAK_AT_HOME", "TRAVELS_WELL", "WEAK_AWAY", "SHUT_AT_HOME", "SHORT_REST", "LONG_REST", "STRONG_FINISHES", "SOFT_TO_TOP", "BEATS_BOTTOM", "FAVOURITE", "OUTSIDER", "HOST", "GUEST",
]
MATCH = ["STRICT_REFEREE", "H2H_BOTH", "H2H_UNDER", "CUP_TIE"]
NEUTRAL = ["over25", "under25", "over35", "under15", "both_score", "half_over05", "half_over15", "half_none", "cards_over45"]


def _atoms(spark, base):
    """Every side of a match with all outcomes, their rates in the league, season and venue (`ref_*`), and the conditions OWN, their mirror images and MATCH; null counts as false."""
    x, ind = _outcomes(spark, base), lambda c: c.cast("int")
    for name, flag in (("won", F.col("win")), ("winless", ~F.col("win")), ("drawn", F.col("draw")), ("goalless", F.coalesce(F.col("gf") == 0, F.lit(False)))):
        x = pit.streak_before(x, TEAM, ORDER, flag, name, PLAYED)
    roll = lambda x, width, cols: pit.rolling_prev(x, TEAM, ORDER, cols, width, played=PLAYED)
    x = roll(x, 3, {"won_l3": (ind(F.col("win")), "sum")})
    x = roll(x, 5, {"gf_l5": (F.col("gf"), "avg"), "ga_l5": (F.col("ga"), "avg"), "cards_l5": (F.col("cards"), "avg")})
    x = _halves(x)
    for column, steps in (("margin", [1, 2, 3]), ("price", [1]), ("winless", [3]), ("date", [1])):
        x = pit.lagged(x, TEAM, ORDER, column, steps, PLAYED)
    x = x.withColumn("rest", F.datediff("date", "date_m1"))
    at_venue = ["team", "side"]
    x = pit.streak_before(pit.streak_before(x, at_venue, ORDER, F.col("win"), "v_won", PLAYED), at_venue, ORDER, ~F.col("win"), "v_winless", PLAYED)
    x = pit.rolling_prev(x, at_venue, ORDER, {"v_ga": (F.col("ga"), "avg"), "v_clean": (ind(F.col("ga") == 0), "sum")}, 10, played=PLAYED)
    x = pit.to_date(x, [*at_venue, "season"], ORDER, ind(F.col("win")), "v", PLAYED)
    x = _records(x, spark, base)
    x = x.join(w17_season_end(spark, base).select("team", "season", "strong"), ["team", "season"], "left")
    x = x.join(w18_pair_last5(spark, base).select("match_id", F.col("n").alias("met"), "both", "under"), "match_id", "left").join(w22_range_history(spark, base), "match_id", "left")
    home, guest = F.col("side") == "home", F.col("side") == "away"
    m = [F.col(f"margin_m{i}") for i in (1, 2, 3)]
    flags = {
        "WON_RUN": F.col("won") >= 3, "WON_RUN_WIDE": (F.col("won") >= 4) & ((m[0] + m[1] + m[2]) / 3 >= 1.5), "WINLESS_RUN": F.col("winless") >= 4, "DRAWN_RUN": F.col("drawn") >= 3,
        "BLUNT": (F.col("gf_l5") <= 0.5) | (F.col("goalless") >= 3), "PROLIFIC": F.col("gf_l5") >= 2, "LEAKY": (F.col("ga_l5") >= 2) & (F.col("ga2_l5") >= 3), "REVIVED": (F.col("won_l3") >= 2) & (F.col("winless_m3") >= 4),
        "AFTER_HEAVY_LOSS": m[0] <= -3, "AFTER_WIDE_WIN": m[0] >= 3, "AFTER_UPSET": (m[0] > 0) & (F.col("price_m1") >= 3),
        "STRONG_FIRST_HALF": (F.col("ht_for") >= 3) & (F.col("ht_gf_l4") >= 0.9), "LEAKY_FIRST_HALF": (F.col("ht_against") >= 3) & (F.col("ht_ga_l4") >= 0.8), "TIGHT_FIRST_HALF": F.col("ht_ga_l5") <= 1, "STRONG_SECOND_HALF": (F.col("late_for") >= 3) & (F.col("late_diff") >= 0.5),
        "HALF_OVER15_OFTEN": F.col("h15_l4") >= 3, "HALF_NONE_OFTEN": F.col("h0_l4") >= 3, "OVER35_OFTEN": F.col("o35_l4") >= 3, "UNDER15_OFTEN": F.col("u15_l4") >= 3, "CARDED": F.col("cards_l5") >= 2.5,
        "FORTRESS": home & (F.col("v_mean") >= 0.7) & (F.col("v_n") >= 5) & (F.col("v_won") >= 3), "WEAK_AT_HOME": home & (F.col("v_winless") >= 4), "TRAVELS_WELL": guest & (F.col("v_mean") >= 0.6) & (F.col("v_n") >= 5) & (F.col("v_won") >= 2), "WEAK_AWAY": guest & (F.col("v_winless") >= 4),
        "SHUT_AT_HOME": home & (F.col("v_ga") <= 0.7) & (F.col("v_clean") >= 5), "SHORT_REST": F.col("rest") <= 4, "LONG_REST": F.col("rest") >= 7, "STRONG_FINISHES": F.col("strong") >= 2,
        "SOFT_TO_TOP": (F.col("top_n") >= 5) & (F.col("top_taken") <= 0.2 * F.col("top_n")), "BEATS_BOTTOM": (F.col("low_n") >= 4) & (F.col("low_won") >= 0.75 * F.col("low_n")), "FAVOURITE": F.col("price") <= 1.6, "OUTSIDER": F.col("price") >= 3.5, "HOST": home, "GUEST": guest,
        "STRICT_REFEREE": (F.col("cards_n") >= 15) & (F.col("cards_mean") >= 5), "H2H_BOTH": (F.col("met") >= 4) & (F.col("both") >= 4), "H2H_UNDER": (F.col("met") >= 4) & (F.col("under") >= 4), "CUP_TIE": F.col("league") == "CUP",
    }
    rate = Window.partitionBy("league", "season", "side")
    x = x.select("match_id", "side", "season", *OUTCOMES, *[F.avg(ind(F.col(o))).over(rate).alias(f"ref_{o}") for o in OUTCOMES], *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()])
    return pairs.blocks(pairs.opponent_view(x, "match_id", OWN), "season", 3, "block")


def _search_all(spark, base, outcomes, canonical):
    c = evaluate.combinations(_atoms(spark, base), OWN, ["adv_" + o for o in OWN], MATCH, outcomes, [f"ref_{o}" for o in outcomes], "block", 30, 30, canonical=canonical, once="HOST" if canonical else None)
    return c.select("outcome", "combo", "n", "hits", r6(F.col("ref")).alias("ref"), "agree")


def x2_search_all(spark, base):
    """Single, double and triple conditions of all that the windows give, for every outcome, with at least 30 rows."""
    return _search_all(spark, base, list(OUTCOMES), False)


def x5_search_canonical_all(spark, base):
    """The same search without mirror images, for the outcomes that do not tell the sides apart."""
    return _search_all(spark, base, NEUTRAL, True)


def s3_top_differences_all(spark, base):
    """For every outcome the 20 conditions with the greatest difference: a report of fixed length."""
    x = x2_search_all(spark, base).withColumn("delta", r6(F.col("hits") / F.col("n") - F.col("ref") / F.col("n")))
    w = Window.partitionBy("outcome").orderBy(F.desc(F.abs("delta")), "combo")
    return x.withColumn("place", F.row_number().over(w)).where("place <= 20").select("outcome", "combo", "n", "delta")


def e10_rounds_since_safe(spark, base):
    """For each side of a match, how many of its matches ago it became certain not to go down."""
    t = _stakes(spark, base).select("league", "season", "match_id", "team", "surely_safe")
    x = long(spark, base).select("match_id", "date", "side", "team", "league", "season").join(t, ["league", "season", "match_id", "team"])
    return pit.first_since(x, ["league", "season", "team"], ORDER, F.col("surely_safe"), "since").select("match_id", "side", "since")


def f12_proportional(spark, base):
    p = fair.proportional([F.col("psch"), F.col("pscd"), F.col("psca")])
    return now(spark, base).select("match_id", *[r6(c).alias(n) for c, n in zip(p, ("home_p", "draw_p", "away_p"))])


def f13_shin(spark, base):
    p = F.transform(fair.shin([F.col("psch"), F.col("pscd"), F.col("psca")]), lambda x: F.round(x, 9))
    return now(spark, base).select("match_id", p.alias("p")).select("match_id", *[F.get("p", i).alias(n) for i, n in enumerate(("home_p", "draw_p", "away_p"))])


def f15_source_fallback(spark, base):
    """All closing prices or else all earlier ones, never mixed."""
    full = lambda cs: F.when(fair.usable([F.col(c) for c in cs]), F.struct(*[F.col(c).alias(n) for c, n in zip(cs, ("a", "b", "c"))], F.lit(cs[0] == "psch").alias("closing")))
    x = now(spark, base).select("match_id", F.coalesce(full(["psch", "pscd", "psca"]), full(["psh", "psd", "psa"])).alias("s"))
    return x.select("match_id", "s.a", "s.b", "s.c", "s.closing")


def f20_flat_return(spark, base):
    gain = F.when(F.col("win"), F.col("price") - 1).otherwise(-1.0)
    x = long(spark, base).where("price is not null and gf is not null").groupBy("league", "side").agg(F.count("*").alias("n"), F.avg(gain).alias("m"), F.coalesce(F.stddev_samp(gain), F.lit(0.0)).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return x.select("league", "side", "n", r6(F.col("m")).alias("mean"), r6(F.col("m") - half).alias("low"), r6(F.col("m") + half).alias("high"))


def b13_cells(spark, base):
    """Matches by cells of fair probabilities, right-closed."""
    home = fair.proportional([F.col("psch"), F.col("pscd"), F.col("psca")])[0]
    over = fair.proportional([F.col("pc_o25"), F.col("pc_u25")])[0]
    x = now(spark, base).select(pairs.buckets(home, [0, 0.2, 0.35, 0.5, 0.65, 0.8, 1.0]).alias("force"), F.coalesce(pairs.buckets(over, [0, 0.45, 0.55, 0.65, 1.0]), F.lit(-1)).alias("tempo"))
    return x.groupBy("force", "tempo").agg(F.count("*").alias("n"))


def g5_adjusted_reference(spark, base):
    """Rate of over25 in the cell of the home price, or of the venue where the cell holds fewer than 100 rows."""
    x = _outcomes(spark, base).where("gf is not null").withColumn("cell", pairs.buckets(1 / F.col("price"), [0, 0.2, 0.35, 0.5, 0.65, 0.8, 1.0])).where("cell is not null")
    # rates of a few cells and two venues, joined back instead of sorted windows
    hit = F.col("over25").cast("int")
    cells = x.groupBy("side", "cell").agg(F.avg(hit).alias("in_cell"), F.count("*").alias("n"))
    venues = x.groupBy("side").agg(F.avg(hit).alias("in_venue"))
    ref = F.when(F.col("n") >= 100, F.col("in_cell")).otherwise(F.col("in_venue"))
    return cells.join(venues, "side").select("side", F.col("cell").cast("long").alias("cell"), "n", r6(ref).alias("ref"))


def g13_metadata(spark, base):
    return now(spark, base).agg(F.count("*").alias("n"), F.count_distinct("league").alias("leagues"), F.min("season").alias("first"), F.max("season").alias("last"), F.count_if(F.col("fthg").isNull()).alias("unplayed"))


def g14_roster(spark, base):
    return long(spark, base).select("league", "team").distinct()


def s3_top_differences(spark, base):
    """The 20 conditions with the greatest difference: a report of fixed length."""
    x = x2_search(spark, base).withColumn("delta", r6(F.col("hits") / F.col("n") - F.col("ref") / F.col("n")))
    return x.orderBy(F.desc(F.abs("delta")), "combo").limit(20).select("combo", "n", "delta")


def x6_blocks(spark, base):
    return pairs.blocks(now(spark, base), "season", 3, "block").groupBy("season", "block").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (a17_dedupe, a8_surrogate_key, a10_price_coverage, b1_two_sided, b7_opponent_view, w1_streak_before, w2_rolling_prev, w3_lags, w9_rest_days, w11_venue_streak, w12_season_to_date, w16_offset_window, w17_season_end, w18_pair_last5, w19_same_host, w20_last_loser, w21_pair_cards, w4_streak_earlier, w8_halves, w14_home_last10, w22_range_history, w23_record_vs_top, w24_first_since, e1_standings, e1_standings_strict, e7_stakes, l_outcomes, g1_base_rates, g2_hypotheses, g4_fdr, f12_proportional, f13_shin, f15_source_fallback, f17_wilson, f20_flat_return, b13_cells, g5_adjusted_reference, g13_metadata, g14_roster, e10_rounds_since_safe, x2_search, x2_search_all, x5_search_canonical, x5_search_canonical_all, x6_blocks, s3_top_differences, s3_top_differences_all)}
ORACLE = form_sql.ORACLE
