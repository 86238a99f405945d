"""ANSI SQL for the queries of plans/form.py."""

from __future__ import annotations

M = """
WITH m AS (SELECT match_id, league, season, date, home, away, referee, CAST(fthg AS BIGINT) fthg, CAST(ftag AS BIGINT) ftag, CAST(hthg AS BIGINT) hthg, CAST(htag AS BIGINT) htag,
    CAST(hy AS BIGINT) hy, CAST(ay AS BIGINT) ay, CAST(hr AS BIGINT) hr, CAST(ar AS BIGINT) ar, psh, psd, psa, psch, pscd, psca, p_o25, p_u25, pc_o25, pc_u25
  FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY recorded_at DESC, fthg DESC NULLS LAST, ftag DESC NULLS LAST) AS rn FROM matches) WHERE rn = 1)"""
LG = M + """,
lg0 AS (
  SELECT match_id, league, season, date, referee, psch, pscd, psca, 'home' AS side, home AS team, away AS opp, fthg AS gf, ftag AS ga, hthg AS ht_gf, htag AS ht_ga,
    coalesce(hy,0)+coalesce(hr,0) AS cards, coalesce(ay,0)+coalesce(ar,0) AS cards_opp, psh AS price FROM m
  UNION ALL SELECT match_id, league, season, date, referee, psch, pscd, psca, 'away', away, home, ftag, fthg, htag, hthg,
    coalesce(ay,0)+coalesce(ar,0), coalesce(hy,0)+coalesce(hr,0), psa FROM m),
lg AS (SELECT *, gf IS NOT NULL AND ga IS NOT NULL AS p, count(gf + ga) OVER (PARTITION BY team ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS nth, coalesce(gf > ga, false) AS win, coalesce(gf < ga, false) AS loss, coalesce(gf = ga, false) AS draw, gf - ga AS margin, gf + ga AS total FROM lg0)"""


def _nth(part: str) -> str:
    """The place among matches that were played."""
    return f"count(CASE WHEN p THEN 1 END) OVER (PARTITION BY {part} ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1"


def _streak(flag: str, name: str, src: str = "lg", part: str = "team") -> str:
    return f"""(SELECT match_id, side, i - 1 - coalesce(max(CASE WHEN p AND NOT f THEN i END) OVER (PARTITION BY {part} ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {name}
  FROM (SELECT *, {flag} AS f, {_nth(part)} AS i FROM {src}))"""


def _roll(x: str, fn: str, w: int, off: int = 0, part: str = "team", least: int | None = None, at: str = "nth") -> str:
    o = f"OVER (PARTITION BY {part} ORDER BY {at} RANGE BETWEEN {w + off} PRECEDING AND {1 + off} PRECEDING)"
    return f"CASE WHEN count(CASE WHEN p THEN {x} END) {o} >= {least or w} THEN {fn}(CASE WHEN p THEN {x} END) {o} END"


def _before(x: str, k: int, part: str = "team", at: str = "nth") -> str:
    return f"max(CASE WHEN p THEN {x} END) OVER (PARTITION BY {part} ORDER BY {at} RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"


def _grid(strict: bool) -> str:
    frame = "ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING" if strict else "ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    s = lambda c: f"CAST(coalesce(sum({c}) OVER (PARTITION BY league, season, team {frame}), 0) AS BIGINT) AS {c}"
    return M + f""",
t AS (SELECT DISTINCT league, season, home AS team FROM m UNION SELECT DISTINCT league, season, away FROM m),
g0 AS (SELECT m.league, m.season, match_id, date, team, CASE WHEN team = home THEN fthg - ftag WHEN team = away THEN ftag - fthg END AS mar, CASE WHEN team = home THEN fthg WHEN team = away THEN ftag END AS own
  FROM m JOIN t ON m.league = t.league AND m.season = t.season),
g1 AS (SELECT league, season, match_id, date, team, CASE WHEN mar > 0 THEN 3 WHEN mar = 0 THEN 1 ELSE 0 END AS pts, coalesce(mar, 0) AS gd, CASE WHEN mar IS NOT NULL THEN own ELSE 0 END AS gf, CASE WHEN mar IS NOT NULL THEN 1 ELSE 0 END AS played FROM g0),
g2 AS (SELECT league, season, match_id, team, {s('pts')}, {s('gd')}, {s('gf')}, {s('played')} FROM g1),
g AS (SELECT *, row_number() OVER (PARTITION BY league, season, match_id ORDER BY pts DESC, gd DESC, gf DESC, team) AS rank, count(*) OVER (PARTITION BY league, season, match_id) AS n_teams FROM g2)"""


OUT = {
    "win_own": "gf > ga", "win_other": "ga > gf", "not_lost": "gf >= ga", "not_won": "ga >= gf", "over25": "total >= 3", "under25": "total <= 2", "over35": "total >= 4", "under15": "total <= 1",
    "both_score": "gf > 0 AND ga > 0", "half_over05": "ht_gf + ht_ga >= 1", "half_over15": "ht_gf + ht_ga >= 2", "half_none": "ht_gf + ht_ga = 0", "half_own": "ht_gf > ht_ga", "half_other": "ht_ga > ht_gf",
    "second_own": "gf - ht_gf > ga - ht_ga", "second_other": "ga - ht_ga > gf - ht_gf", "cards_over45": "cards + cards_opp >= 5", "own_over15": "gf >= 2", "other_over15": "ga >= 2",
    "own_under15": "gf <= 1", "other_under15": "ga <= 1", "clean_own": "ga = 0", "clean_other": "gf = 0",
}
OC = LG + ",\noc AS (SELECT *, " + ", ".join(f"CASE WHEN p THEN {v} END AS {k}" for k, v in OUT.items()) + " FROM lg)"
COND = OC + f""",
c1 AS (SELECT oc.*, a.winless, b.won, {_roll('gf', 'sum', 5)} AS gf5, {_roll('ga', 'sum', 5)} AS ga5 FROM oc JOIN {_streak('NOT win', 'winless')} a USING (match_id, side) JOIN {_streak('win', 'won')} b USING (match_id, side)),
c2 AS (SELECT *, winless >= 3 AS long_winless, won >= 2 AS winning, coalesce(gf5 >= 8, false) AS scoring, coalesce(ga5 >= 8, false) AS leaking, side = 'home' AS at_home, league = 'CUP' AS cup_tie FROM c1),
c AS (SELECT x.*, y.long_winless AS o_long_winless, y.winning AS o_winning, y.scoring AS o_scoring, y.leaking AS o_leaking FROM c2 x JOIN c2 y ON x.match_id = y.match_id AND x.side <> y.side)"""
_H = [
    ("H1", "long_winless", ["win_other", "not_won"]), ("H2", "winning AND o_long_winless", ["win_own", "own_over15"]), ("H3", "leaking AND o_leaking", ["over25", "both_score"]),
    ("H4", "scoring AND at_home", ["win_own"]), ("H5", "cup_tie AND (winning OR scoring)", ["over25"]),
]
HYP = COND + ",\nh AS (" + " UNION ALL ".join(f"SELECT '{i}' AS id, '{o}' AS outcome, season, CAST({o} AS INT) AS hit, r AS ref FROM (SELECT *, avg(CAST({o} AS INT)) OVER (PARTITION BY league, season, side) AS r FROM c) WHERE {o} IS NOT NULL AND ({w})" for i, w, os in _H for o in os) + """),
hs AS (SELECT id, outcome, season, count(*) AS n, sum(hit) AS hits, sum(ref) AS ref, sum(ref * (1 - ref)) AS v FROM h GROUP BY ALL),
hr AS (SELECT id, outcome, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits, round(sum(ref), 6) AS ref, round(sum(v), 6) AS var,
  count(*) FILTER (n >= 10) AS seasons, count(*) FILTER (n >= 10 AND hits - ref > 0) AS seasons_up FROM hs GROUP BY id, outcome)"""
_COLS = {"own:LONG_WINLESS": "long_winless", "own:WINNING": "winning", "own:SCORING": "scoring", "own:LEAKING": "leaking"}
_OTH = {"other:adv_LONG_WINLESS": "o_long_winless", "other:adv_WINNING": "o_winning", "other:adv_SCORING": "o_scoring", "other:adv_LEAKING": "o_leaking"}
_MAT = {"match:AT_HOME": "at_home", "match:CUP_TIE": "cup_tie"}
_one = [*_COLS.items(), *_OTH.items(), *_MAT.items()]
_two = [(f"{a}&{b}", f"{p} AND {q}") for a, p in _COLS.items() for b, q in [*_OTH.items(), *_MAT.items(), *[(k, v) for k, v in _COLS.items() if k > a]]] + [(f"{a}&{b}", f"{p} AND {q}") for a, p in _OTH.items() for b, q in _MAT.items()]
_three = [(f"{a}&{b}&{d}", f"{p} AND {q} AND {r}", f"{p} AND {q}") for a, p in _COLS.items() for b, q in _OTH.items() for d, r in _MAT.items()]
_search = lambda once: COND + """,
sb AS (SELECT season, least((row_number() OVER (ORDER BY season) - 1) // greatest(1, count(*) OVER () // 3), 2) AS block FROM (SELECT DISTINCT season FROM m)),
cr AS (SELECT c.*, sb.block, avg(CAST(over25 AS INT)) OVER (PARTITION BY league, c.season, side) AS r FROM c JOIN sb ON c.season = sb.season WHERE over25 IS NOT NULL),
k AS (""" + " UNION ALL ".join([f"SELECT '{k}' AS combo, block, CAST(over25 AS INT) AS hit, r FROM cr WHERE {w}" for k, w in [*((k, w + " AND at_home" if once and k.startswith("match:") else w) for k, w in _one), *_two]] + [f"SELECT '{k}', block, CAST(over25 AS INT), r FROM cr WHERE {w} AND (SELECT count(*) FROM cr WHERE {p}) >= 30" for k, w, p in _three]) + """),
kb AS (SELECT combo, block, count(*) AS n, sum(hit) AS hits, sum(r) AS ref FROM k GROUP BY combo, block),
kt AS (SELECT combo, sum(n) AS n, sum(hits) AS hits, sum(ref) AS ref FROM kb GROUP BY combo),
kr AS (SELECT kt.combo, CAST(kt.n AS BIGINT) AS n, CAST(kt.hits AS BIGINT) AS hits, round(kt.ref, 6) AS ref,
  (SELECT count(*) FROM kb WHERE kb.combo = kt.combo AND kb.n >= 50 AND sign(round(kb.hits - kb.ref, 9)) = sign(round(kt.hits - kt.ref, 9)) AND sign(round(kt.hits - kt.ref, 9)) <> 0) AS agree FROM kt WHERE kt.n >= 30)"""  # noqa: E731
SEARCH = _search(False)
_name = lambda k: k.split(":")[1].removeprefix("adv_")
_canon = [k for k, *_ in [*_one, *_two, *_three] if not k.startswith("other:") and ("other:" not in k or _name(k.split("&")[0]) <= _name(k.split("&")[1]))]
_MEET = M + f""", q AS (SELECT *, least(home, away) AS pa, greatest(home, away) AS pb, fthg IS NOT NULL AND ftag IS NOT NULL AS p, coalesce(hy,0)+coalesce(ay,0)+coalesce(hr,0)+coalesce(ar,0) AS k FROM m),
q2 AS (SELECT *, {_nth("pa, pb")} AS nth, {_nth("home, away")} AS nth_host FROM q)"""
_SUM = lambda cond, w, part, at: f"CAST(coalesce(sum(CASE WHEN p AND {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY {part} ORDER BY {at} RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
_BUCKET = lambda x: f"CASE WHEN {x} >= 0 AND {x} <= 0.2 THEN 0 WHEN {x} > 0.2 AND {x} <= 0.35 THEN 1 WHEN {x} > 0.35 AND {x} <= 0.5 THEN 2 WHEN {x} > 0.5 AND {x} <= 0.65 THEN 3 WHEN {x} > 0.65 AND {x} <= 0.8 THEN 4 WHEN {x} > 0.8 AND {x} <= 1 THEN 5 END"
_PF = "(1/psch)/(1/psch+1/pscd+1/psca)"
_OK = "psch > 1 AND pscd > 1 AND psca > 1"
_WIL = lambda h, n: (f"(({h}/{n} + 1.96*1.96/(2*{n})) - 1.96*sqrt({h}/{n}*(1-{h}/{n})/{n} + 1.96*1.96/(4*{n}*{n}))) / (1 + 1.96*1.96/{n})", f"(({h}/{n} + 1.96*1.96/(2*{n})) + 1.96*sqrt({h}/{n}*(1-{h}/{n})/{n} + 1.96*1.96/(4*{n}*{n}))) / (1 + 1.96*1.96/{n})")

ORACLE = {
    "a17_dedupe": "SELECT event_id, count(*) AS n FROM (SELECT DISTINCT snapshot_ts, event_id, bookmaker, market, outcome, point FROM odds_archive) GROUP BY event_id",
    "a8_surrogate_key": M + " SELECT match_id, league || '_' || season || '_' || CAST(row_number() OVER (PARTITION BY league, season ORDER BY date, home, away, match_id) - 1 AS VARCHAR) AS new_id FROM m",
    "a10_price_coverage": M + " SELECT league, round(avg(CASE WHEN psch IS NOT NULL THEN 1 ELSE 0 END), 6) AS share FROM m GROUP BY league",
    "b1_two_sided": LG + " SELECT match_id, side, team, opp, gf, ga, win, draw, loss, margin, total, cards FROM lg",
    "b7_opponent_view": LG + f", s AS {_streak('win', 'run')} SELECT x.match_id, x.side, x.run, y.run AS adv_run FROM s x JOIN s y ON x.match_id = y.match_id AND x.side <> y.side",
    "w1_streak_before": LG + f" SELECT match_id, side, won, winless, drawn, goalless FROM {_streak('win', 'won')} JOIN {_streak('NOT win', 'winless')} USING (match_id, side) JOIN {_streak('draw', 'drawn')} USING (match_id, side) JOIN {_streak('coalesce(gf = 0, false)', 'goalless')} USING (match_id, side)",
    "w2_rolling_prev": LG + f" SELECT match_id, side, round({_roll('gf', 'avg', 5)}, 6) AS gf_l5, round({_roll('ga', 'avg', 5)}, 6) AS ga_l5, round({_roll('cards', 'avg', 5)}, 6) AS cards_l5, round({_roll('gf', 'stddev_samp', 4)}, 6) AS gf_std_l4, {_roll('gf', 'max', 5)} AS gf_max_l5, CAST({_roll('CAST(win AS INT)', 'sum', 3)} AS BIGINT) AS won_l3, CAST({_roll('CAST(coalesce(total >= 4, false) AS INT)', 'sum', 4)} AS BIGINT) AS over35_l4, CAST({_roll('CAST(coalesce(ht_gf + ht_ga >= 2, false) AS INT)', 'sum', 4)} AS BIGINT) AS half_l4 FROM lg",
    "w3_lags": LG + f" SELECT match_id, side, {_before('margin', 1)} AS margin_m1, {_before('margin', 2)} AS margin_m2, {_before('margin', 3)} AS margin_m3, {_before('price', 1)} AS price_m1 FROM lg",
    "w9_rest_days": LG + f" SELECT match_id, side, date_diff('day', {_before('date', 1)}, date) AS rest FROM lg",
    "w11_venue_streak": LG + f" SELECT match_id, side, run FROM {_streak('win', 'run', part='team, side')}",
    "w12_season_to_date": LG + f", s AS (SELECT *, {_nth('team, side, season')} AS i FROM lg) SELECT match_id, side, round(avg(CASE WHEN p THEN CAST(win AS INT) END) OVER w, 6) AS won_mean, count(CASE WHEN p THEN 1 END) OVER w AS won_n FROM s WINDOW w AS (PARTITION BY team, side, season ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "w16_offset_window": LG + f" SELECT match_id, side, round({_roll('gf', 'avg', 5, 5)}, 6) AS gf_l6_10 FROM lg",
    "w17_season_end": LG + """, l AS (SELECT team, season, avg(CAST(win AS INT)) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY date DESC, match_id DESC) AS n FROM lg WHERE p) WHERE n <= 8 GROUP BY team, season HAVING count(*) = 8),
s AS (SELECT season, row_number() OVER (ORDER BY season) AS i FROM (SELECT DISTINCT season FROM lg)), t AS (SELECT DISTINCT team, season FROM lg)
SELECT t.team, t.season, round(max(l0.rate), 6) AS rate, count(*) FILTER (p.rate >= 0.65) AS strong FROM t JOIN s ON t.season = s.season LEFT JOIN l l0 ON l0.team = t.team AND l0.season = t.season
LEFT JOIN (SELECT l.*, s.i FROM l JOIN s ON l.season = s.season) p ON p.team = t.team AND p.i BETWEEN s.i - 3 AND s.i - 1 GROUP BY t.team, t.season""",
    "w18_pair_last5": _MEET + f" SELECT match_id, {_SUM('true', 5, 'pa, pb', 'nth')} AS n, {_SUM('fthg > 0 AND ftag > 0', 5, 'pa, pb', 'nth')} AS both, {_SUM('fthg + ftag <= 2', 5, 'pa, pb', 'nth')} AS under FROM q2",
    "w19_same_host": _MEET + f" SELECT match_id, {_SUM('true', 3, 'home, away', 'nth_host')} AS n3, {_SUM('fthg > ftag', 3, 'home, away', 'nth_host')} AS host_won, {_SUM('ftag > fthg', 5, 'home, away', 'nth_host')} AS guest_won FROM q2",
    "w20_last_loser": _MEET + f" SELECT match_id, {_before('(CASE WHEN fthg - ftag >= 2 THEN away WHEN ftag - fthg >= 2 THEN home END)', 1, 'pa, pb')} AS loser FROM q2",
    "w21_pair_cards": _MEET + f" SELECT match_id, round({_roll('k', 'avg', 5, part='pa, pb', least=3)}, 6) AS cards_mean FROM q2",
    "w4_streak_earlier": LG + f", s AS (SELECT lg.*, winless FROM lg JOIN {_streak('NOT win', 'winless')} USING (match_id, side)) SELECT match_id, side, {_before('winless', 3)} AS winless_m3 FROM s",
    "w8_halves": LG + " SELECT match_id, side, " + ", ".join(f"{'round(' if fn == 'avg' else 'CAST('}{_roll(x, fn, w)}{', 6)' if fn == 'avg' else ' AS BIGINT)'} AS {k}" for k, x, fn, w in [
        ("ga2_l5", "CAST(ga >= 2 AS INT)", "sum", 5), ("ht_ga_l5", "ht_ga", "sum", 5), ("ht_for", "CAST(coalesce(ht_gf > 0, false) AS INT)", "sum", 4), ("ht_gf_l4", "ht_gf", "avg", 4), ("ht_against", "CAST(coalesce(ht_ga > 0, false) AS INT)", "sum", 4), ("ht_ga_l4", "ht_ga", "avg", 4),
        ("late_for", "CAST(coalesce(gf > ht_gf, false) AS INT)", "sum", 4), ("late_diff", "(gf - ht_gf - ga + ht_ga)", "avg", 4), ("h15_l4", "CAST(coalesce(ht_gf + ht_ga >= 2, false) AS INT)", "sum", 4), ("h0_l4", "CAST(coalesce(ht_gf + ht_ga = 0, false) AS INT)", "sum", 4), ("o35_l4", "CAST(total >= 4 AS INT)", "sum", 4), ("u15_l4", "CAST(total <= 1 AS INT)", "sum", 4)]) + " FROM lg",
    "w14_home_last10": LG + f", s AS (SELECT *, {_nth('team, side')} AS i FROM lg) SELECT match_id, ga_l10, clean_l10 FROM (SELECT match_id, side, round({_roll('ga', 'avg', 10, part='team, side', at='i')}, 6) AS ga_l10, CAST({_roll('CAST(ga = 0 AS INT)', 'sum', 10, part='team, side', at='i')} AS BIGINT) AS clean_l10 FROM s) WHERE side = 'home'",
    "w22_range_history": M + " SELECT match_id, round(avg(k) OVER w, 6) AS cards_mean, count(k) OVER w AS cards_n FROM (SELECT *, CASE WHEN fthg IS NOT NULL THEN coalesce(hy,0)+coalesce(ay,0)+coalesce(hr,0)+coalesce(ar,0) END AS k FROM m WHERE referee IS NOT NULL) WINDOW w AS (PARTITION BY referee ORDER BY date RANGE BETWEEN INTERVAL 730 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)",
    "w23_record_vs_top": _grid(True) + LG.replace(M, "") + """, o AS (SELECT lg.*, rank <= n_teams // 2 AS top, rank > n_teams - greatest(1, n_teams // 3) AS low FROM lg JOIN g ON g.match_id = lg.match_id AND g.team = lg.opp)
SELECT match_id, side, """ + ", ".join(f"CAST(coalesce(sum(CASE WHEN p AND {c} THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS {k}" for k, c in (("top_taken", "top AND (win OR draw)"), ("top_n", "top"), ("low_won", "low AND win"), ("low_n", "low"))) + " FROM o WINDOW w AS (PARTITION BY team, season ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "w24_first_since": LG + f" SELECT match_id, side, i - coalesce(min(CASE WHEN p AND margin <= -3 THEN i END) OVER (PARTITION BY team, season ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN p AND margin <= -3 THEN i END) AS since FROM (SELECT *, {_nth('team, season')} AS i FROM lg)",
    "e1_standings": _grid(False) + " SELECT match_id, team, pts, gd, gf, played, rank FROM g JOIN m USING (match_id) WHERE team IN (home, away)",
    "e1_standings_strict": _grid(True) + " SELECT match_id, team, pts, gd, gf, played, rank FROM g JOIN m USING (match_id) WHERE team IN (home, away)",
    "e7_stakes": _grid(True) + """, z AS (SELECT g.*, releg_spots, promo_spots, europe_spots, 2 * (n_teams - 1) - played AS left_rounds, pts + 3 * (2 * (n_teams - 1) - played) AS most FROM g LEFT JOIN leagues l ON g.league = l.league),
y AS (SELECT a.match_id, a.team, a.rank, a.left_rounds, a.n_teams, a.releg_spots, a.promo_spots, max(b.pts) FILTER (b.rank = a.promo_spots) AS pts_promo, max(b.pts) FILTER (b.rank = a.europe_spots) AS pts_europe, count(*) FILTER (b.pts > a.most) AS out_of_reach, count(*) FILTER (b.most < a.pts) AS beaten, max(b.pts) FILTER (b.rank = 1) AS pts_first,
  max(b.pts) FILTER (b.rank = a.n_teams - a.releg_spots) AS pts_last_safe, max(b.pts) FILTER (b.rank = a.n_teams - a.releg_spots + 1) AS pts_first_down FROM z a JOIN z b ON a.match_id = b.match_id GROUP BY a.match_id, a.team, a.rank, a.left_rounds, a.n_teams, a.releg_spots, a.promo_spots)
SELECT match_id, team, left_rounds, out_of_reach, beaten, pts_first, pts_last_safe, pts_first_down, pts_promo, pts_europe, out_of_reach >= n_teams - releg_spots AS surely_down, beaten >= releg_spots AS surely_safe, out_of_reach >= 1 AS title_gone,
  promo_spots > 0 AND beaten >= n_teams - promo_spots AS surely_up, promo_spots > 0 AND out_of_reach >= promo_spots AS up_gone, rank <= n_teams // 2 AS top_half, rank > n_teams - greatest(1, n_teams // 3) AS bottom_third FROM y JOIN m USING (match_id) WHERE team IN (home, away)""",
    "e10_rounds_since_safe": _grid(True) + LG.replace(M, "") + """, z AS (SELECT g.*, releg_spots, pts + 3 * (2 * (n_teams - 1) - played) AS most FROM g LEFT JOIN leagues l ON g.league = l.league),
y AS (SELECT a.match_id, a.team, count(*) FILTER (b.most < a.pts) >= a.releg_spots AS safe FROM z a JOIN z b ON a.match_id = b.match_id GROUP BY a.match_id, a.team, a.releg_spots),
x AS (SELECT lg.*, safe, row_number() OVER (PARTITION BY league, season, lg.team ORDER BY date, lg.match_id) AS i FROM lg JOIN y ON lg.match_id = y.match_id AND lg.team = y.team)
SELECT match_id, side, i - min(CASE WHEN safe THEN i END) OVER (PARTITION BY league, season, team ORDER BY date, match_id) AS since FROM x""",
    "l_outcomes": OC + " SELECT match_id, side, " + ", ".join(OUT) + " FROM oc",
    "g1_base_rates": OC + " " + " UNION ALL ".join(f"SELECT '{o}' AS outcome, league, season, side, round(avg(CAST({o} AS INT)), 6) AS base FROM oc GROUP BY league, season, side" for o in OUT),
    "g2_hypotheses": HYP + " SELECT * FROM hr",
    # the two-sided normal p-value by the series of the error function, which converges for all z of use; 0 beyond 6
    "g4_fdr": HYP + f""", z AS (SELECT id, outcome, n, hits, CASE WHEN var > 0 THEN (hits - ref) / sqrt(var) ELSE 0.0 END AS z FROM hr),
pv AS (SELECT *, CASE WHEN abs(z) > 6 THEN 0.0 WHEN z = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 150), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(abs(z) / sqrt(2)) - lgamma(k + 1)) / (2 * k + 1))) END AS p FROM z),
rk AS (SELECT *, count(*) OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM pv), cut AS (SELECT max(p) FILTER (p <= 0.1 * r / m) AS c FROM rk)
SELECT id, outcome, n, round(z, 6) AS z, round(p, 6) AS p, round(greatest(0.0, {_WIL('hits', 'n')[0]}), 6) AS low, round(least(1.0, {_WIL('hits', 'n')[1]}), 6) AS high, coalesce(p <= c, false) AS fdr FROM pv, cut""",
    # a hundred steps of the fixed point for the insiders' share
    "f13_shin": M + f""", q AS (SELECT match_id, 1/psch AS a, 1/pscd AS b, 1/psca AS c, 1/psch + 1/pscd + 1/psca AS s FROM m WHERE {_OK}),
f AS (SELECT *, list_reduce(list_transform(range(0, 101), lambda i: 0.0::DOUBLE), lambda z, i: least(0.99, greatest(0.0, sqrt(z*z + 4*(1-z)*a*a/s) + sqrt(z*z + 4*(1-z)*b*b/s) + sqrt(z*z + 4*(1-z)*c*c/s) - 2))) AS z FROM q WHERE s > 1),
g AS (SELECT match_id, (sqrt(z*z + 4*(1-z)*a*a/s) - z) / (2*(1-z)) AS a, (sqrt(z*z + 4*(1-z)*b*b/s) - z) / (2*(1-z)) AS b, (sqrt(z*z + 4*(1-z)*c*c/s) - z) / (2*(1-z)) AS c FROM f UNION ALL SELECT match_id, a, b, c FROM q WHERE s <= 1)
SELECT m.match_id, round(a / (a+b+c), 9) AS home_p, round(b / (a+b+c), 9) AS draw_p, round(c / (a+b+c), 9) AS away_p FROM m LEFT JOIN g ON m.match_id = g.match_id""",
    "x2_search": SEARCH + " SELECT combo, n, hits, ref, agree FROM kr",
    "x5_search_canonical": _search(True) + " SELECT combo, n, hits, ref, agree FROM kr WHERE combo IN (" + ", ".join(f"'{k}'" for k in _canon) + ")",
    "s3_top_differences": SEARCH + " SELECT combo, n, round(hits / n - ref / n, 6) AS delta FROM kr ORDER BY abs(round(hits / n - ref / n, 6)) DESC, combo LIMIT 20",
    "f12_proportional": M + f" SELECT match_id, round(CASE WHEN {_OK} THEN {_PF} END, 6) AS home_p, round(CASE WHEN {_OK} THEN (1/pscd)/(1/psch+1/pscd+1/psca) END, 6) AS draw_p, round(CASE WHEN {_OK} THEN (1/psca)/(1/psch+1/pscd+1/psca) END, 6) AS away_p FROM m",
    "f15_source_fallback": M + f", s AS (SELECT *, coalesce({_OK}, false) AS c1, coalesce(psh > 1 AND psd > 1 AND psa > 1, false) AS c2 FROM m) SELECT match_id, CASE WHEN c1 THEN psch WHEN c2 THEN psh END AS a, CASE WHEN c1 THEN pscd WHEN c2 THEN psd END AS b, CASE WHEN c1 THEN psca WHEN c2 THEN psa END AS c, CASE WHEN c1 THEN true WHEN c2 THEN false END AS closing FROM s",
    "f17_wilson": LG + f", a AS (SELECT league, side, count(*) AS n, CAST(sum(CAST(win AS INT)) AS BIGINT) AS hits FROM lg WHERE p GROUP BY league, side) SELECT league, side, n, hits, round(greatest(0.0, {_WIL('hits', 'n')[0]}), 6) AS low, round(least(1.0, {_WIL('hits', 'n')[1]}), 6) AS high FROM a",
    "f20_flat_return": LG + ", a AS (SELECT league, side, CASE WHEN win THEN price - 1 ELSE -1 END AS gain FROM lg WHERE price IS NOT NULL AND gf IS NOT NULL), b AS (SELECT league, side, count(*) AS n, avg(gain) AS m, coalesce(stddev_samp(gain), 0) AS sd FROM a GROUP BY league, side) SELECT league, side, n, round(m, 6) AS mean, round(m - 1.96 * sd / sqrt(n), 6) AS low, round(m + 1.96 * sd / sqrt(n), 6) AS high FROM b",
    "b13_cells": M + f", a AS (SELECT CASE WHEN {_OK} THEN {_PF} END AS p, CASE WHEN pc_o25 > 1 AND pc_u25 > 1 THEN (1/pc_o25)/(1/pc_o25+1/pc_u25) END AS o FROM m), b AS (SELECT {_BUCKET('p')} AS force, coalesce(CASE WHEN o >= 0 AND o <= 0.45 THEN 0 WHEN o > 0.45 AND o <= 0.55 THEN 1 WHEN o > 0.55 AND o <= 0.65 THEN 2 WHEN o > 0.65 AND o <= 1 THEN 3 END, -1) AS tempo FROM a) SELECT force, tempo, count(*) AS n FROM b GROUP BY force, tempo",
    "g5_adjusted_reference": OC + f", a AS (SELECT side, {_BUCKET('(1/price)')} AS cell, CAST(over25 AS INT) AS h FROM oc WHERE gf IS NOT NULL), b AS (SELECT * FROM a WHERE cell IS NOT NULL), v AS (SELECT side, avg(h) AS iv FROM b GROUP BY side) SELECT b.side, CAST(cell AS BIGINT) AS cell, count(*) AS n, round(CASE WHEN count(*) >= 100 THEN avg(h) ELSE max(iv) END, 6) AS ref FROM b JOIN v ON b.side = v.side GROUP BY b.side, cell",
    "g13_metadata": M + " SELECT count(*) AS n, count(DISTINCT league) AS leagues, min(season) AS first, max(season) AS last, count(*) FILTER (fthg IS NULL) AS unplayed FROM m",
    "g14_roster": LG + " SELECT DISTINCT league, team FROM lg",
    "x6_blocks": M + ", sb AS (SELECT season, least((row_number() OVER (ORDER BY season) - 1) // greatest(1, count(*) OVER () // 3), 2) AS block FROM (SELECT DISTINCT season FROM m)) SELECT m.season, block, count(*) AS n FROM m JOIN sb ON m.season = sb.season GROUP BY m.season, block",
}
