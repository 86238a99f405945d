"""Queries over quotes, signals and landed feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import fair
from tidemark.operators import fuzzy, instants, quotes
from tidemark.plans import core_sql
from tidemark.plans.form import now, r6
from tidemark.session import table
from tidemark.sources import feeds
from tidemark.streaming import streams

PRICE_KEYS = ["event_id", "market", "bookmaker", "description"]


def _moments(spark, base, o):
    """o with `moment`, the instant of snapshot_ts in microseconds; null where the text fixes none. Each distinct text is parsed once."""
    leagues = table(spark, base, "leagues").select("sport_key", "tz").dropDuplicates(["sport_key"])
    zones = instants.known_zones(leagues, "tz")
    t = o.select("sport_key", F.col("snapshot_ts").alias("_raw")).where("_raw is not null").distinct().join(leagues, "sport_key", "left")
    t = instants.normalise(t, "_raw", "tz", instants.zone_intervals(spark, zones)).select(F.col("sport_key").alias("_key"), "_raw", F.col("utc_us").alias("moment"))
    return o.join(t, F.col("sport_key").eqNullSafe(F.col("_key")) & (F.col("snapshot_ts") == F.col("_raw")), "left").drop("_key", "_raw")


def _latest(spark, base):
    o = _moments(spark, base, table(spark, base, "odds_archive").where("price is not null"))
    # texts without an instant come before all others, in their own order
    at = F.struct("moment", F.when(F.col("moment").isNull(), F.col("snapshot_ts")).alias("text"))
    return quotes.latest(o, PRICE_KEYS, (F.col("phase") == "CLOSE").cast("int"), at, ["outcome", "point", "price"])


def c12_latest_snapshot(spark, base):
    """Per event, market, bookmaker and description the prices of the closing, else the last snapshot."""
    return _latest(spark, base)


def c13_nearest_line(spark, base):
    """The card line nearest to 4.5 with its prices and the fair probability of over."""
    x = _latest(spark, base).where("market = 'alternate_totals_cards'")
    y = quotes.nearest_level(x, ["event_id", "bookmaker"], "point", 4.5, "outcome", "price", ["Over", "Under"])
    return y.select("event_id", "bookmaker", "level", "over", "under", r6(fair.proportional([F.col("over"), F.col("under")])[0]).alias("fair_over"))


def _roster(spark, base):
    """(league, club); the cup's roster is all clubs."""
    c = table(spark, base, "clubs").select("league", "club")
    return c.unionByName(c.select(F.lit("CUP").alias("league"), "club")).distinct()


def c10_fuzzy_names(spark, base):
    """The feed's names linked to the clubs of the league by shared words."""
    leagues = table(spark, base, "leagues").select("sport_key", "league")
    n = table(spark, base, "api_events").join(leagues, "sport_key").select("league", F.explode(F.array("home_team", "away_team")).alias("name"))
    return fuzzy.link(n, _roster(spark, base), "league", "name", "club").select("league", "name", "club", r6(F.col("score")).alias("score"))


def c9_composite_key(spark, base):
    """Events whose league and plain names both occur among the clubs, and those that do not, by league."""
    leagues = table(spark, base, "leagues").select("sport_key", "league")
    plain = lambda c: F.lower(F.btrim(c))
    e = table(spark, base, "api_events").select("event_id", "sport_key", plain(F.col("home_team")).alias("h"), plain(F.col("away_team")).alias("a")).distinct().join(leagues, "sport_key")
    c = _roster(spark, base).select("league", plain(F.col("club")).alias("k")).distinct()
    x = e.join(c.select("league", F.col("k").alias("h"), F.lit(1).alias("hh")), ["league", "h"], "left").join(c.select("league", F.col("k").alias("a"), F.lit(1).alias("aa")), ["league", "a"], "left")
    both = F.col("hh").isNotNull() & F.col("aa").isNotNull()
    return x.groupBy("league").agg(F.count_if(both).alias("matched"), F.count_if(~both).alias("unmatched"))


def c11_settlement(spark, base):
    """Signals with the first match of the same league and clubs at most a day away."""
    j = table(spark, base, "journal").select("event_id", "candidat", "team_fd", "league", "home_fd", "away_fd", "commence").distinct()
    return quotes.settle(j, now(spark, base), [("league", "league"), ("home_fd", "home"), ("away_fd", "away")], F.unix_date(F.to_date("commence")), F.unix_date("date"), 1, ["event_id", "candidat", "team_fd"], "match_id")


def c14_anti_join(spark, base):
    """Signals that a run would add to those already settled."""
    j = table(spark, base, "journal").select("event_id", "candidat", "team_fd", "regle")
    return quotes.append_new(j.where("regle"), j, ["event_id", "candidat", "team_fd"]).select("event_id", "candidat", "team_fd")


def g9_event_table(spark, base):
    """Per event what its first snapshot says; texts without an instant come after all others, in their own order."""
    unread = F.col("moment").isNull()
    first = F.min(F.struct(unread.alias("unread"), "moment", F.when(unread, F.col("snapshot_ts")).alias("text"), "sport_key", "commence_time", "home", "away")).alias("f")
    o = table(spark, base, "odds_archive").select("snapshot_ts", "event_id", "sport_key", "commence_time", "home", "away").distinct()
    return _moments(spark, base, o).groupBy("event_id").agg(first).select("event_id", "f.sport_key", "f.commence_time", "f.home", "f.away")


def _journal(spark, base):
    return table(spark, base, "journal").dropDuplicates(["event_id", "candidat", "team_fd"])


def g10_scorecard(spark, base):
    done = F.col("regle") & F.col("issue").isNotNull()
    hit = F.when(done, F.col("issue").cast("int"))
    fairp = F.when(done, F.col("juste_pinnacle"))
    g = _journal(spark, base).groupBy("candidat").agg(F.count_if(done).alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("hits"), F.avg(fairp).alias("f"), (F.sum(F.when(done, F.round(F.col("gain_pin") * 100).cast("long"))) / (100 * F.count(F.when(done, F.col("gain_pin"))))).alias("roi"))  # cents: exact whatever the order
    return g.select("candidat", "n", "hits", r6(F.col("f")).alias("fair"), r6(F.col("hits") / F.nullif(F.col("n"), F.lit(0)) - F.col("f")).alias("edge"), r6(F.col("roi")).alias("roi"))


def g11_coverage(spark, base):
    o = table(spark, base, "odds_archive").select("market", "bookmaker", "event_id").distinct()
    return o.groupBy("market", "bookmaker").agg(F.count("*").alias("events"))


def g12_figures(spark, base):
    return _journal(spark, base).agg(F.count("*").alias("signals"), F.count_if("regle").alias("settled"), F.count_distinct("event_id").alias("events"), r6(F.avg("gain_fr")).alias("mean_gain"))


def f23_snapshot_decision(spark, base):
    """Which snapshot a signal's age calls for: closing up to 2.5 hours before, the day before from 16 to 36."""
    h = (F.unix_micros("commence") - F.unix_micros(F.to_timestamp("emis_ts"))) / 3.6e9
    phase = F.when((h >= 0) & (h <= 2.5), "CLOSE").when((h >= 16) & (h <= 36), "J1").otherwise("none")
    return _journal(spark, base).groupBy(phase.alias("decision")).agg(F.count("*").alias("n"))


def f24_budget(spark, base):
    """Snapshots a monthly budget admits, in order: a running cost instead of a loop."""
    s = table(spark, base, "odds_archive").select("event_id", "snapshot_ts").distinct().groupBy("event_id").agg(F.count("*").alias("shots"))
    # the cost before an event is summed per first two characters of the id, then over these 256 groups
    s = s.withColumn("g", F.substring("event_id", 1, 2))
    within = F.sum("shots").over(Window.partitionBy("g").orderBy("event_id"))
    groups = s.groupBy("g").agg(F.sum("shots").alias("t"))
    before = groups.select("g", F.coalesce(F.sum("t").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return s.withColumn("w", within).join(before, "g").select("event_id", ((F.col("w") + F.col("b")) * 16).alias("cost"), ((F.col("w") + F.col("b")) * 16 <= 15000).alias("admitted"))


def f26_gains(spark, base):
    won = F.col("issue")
    gain = lambda p: F.when(won, p - 1).when(~won, F.lit(-1.0))
    return _journal(spark, base).select("event_id", "candidat", "team_fd", r6(gain(F.col("prix_pinnacle"))).alias("pin"), r6(gain(F.greatest("prix_winamax", "prix_unibet"))).alias("fr"))


def s4_upcoming(spark, base):
    """The next 12 open signals: a report of fixed length."""
    return _journal(spark, base).where("not regle").orderBy("commence", "event_id", "candidat", "team_fd").limit(12).select("event_id", "candidat", "team_fd", "league")


def f2_season_of(spark, base):
    return now(spark, base).select("match_id", feeds.season_of(F.col("date")).alias("label"))


def j_stream_dedupe(spark, base):
    """Distinct snapshot keys, found by a stream over the landed file."""
    key = ["snapshot_ts", "event_id", "bookmaker", "market", "outcome", "point"]
    return streams.drain(streams.deduped(streams.landed(spark, f"{base}/odds_archive.parquet").select(*key), key), "dedupe")


def j_stream_dedupe_within(spark, base):
    """Each event once, however often it is sent within a day: the stream keeps a day of keys."""
    x = streams.landed(spark, f"{base}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return streams.drain(streams.deduped(x, ["event_id"], "ts", "1 day"), "dedupe_within")


def j_stream_windows(spark, base):
    """Events per hour and type: the windows that the stream closed, and from the landed rows those still open at its end."""
    path = f"{base}/events.parquet"
    typed = lambda x: x.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value"))
    w = streams.drain(streams.tumbling(typed(streams.landed(spark, path)), "ts", "0 seconds", "1 hour", ["event_type"], "value"), "windows")
    w = w.unionByName(streams.still_open(typed(spark.read.parquet(path)), w, "ts", "1 hour", ["event_type"], "value"))
    return w.select("start", "event_type", "n", r6(F.col("total")).alias("total"))


QUERIES = {f.__name__: f for f in (c9_composite_key, c10_fuzzy_names, c11_settlement, c12_latest_snapshot, c13_nearest_line, c14_anti_join, g9_event_table, g10_scorecard, g11_coverage, g12_figures, f2_season_of, f23_snapshot_decision, f24_budget, f26_gains, s4_upcoming, j_stream_dedupe, j_stream_dedupe_within, j_stream_windows)}

_J = "WITH j AS (SELECT DISTINCT * FROM journal)"
# instants of the archive's time texts, by the SQL that p6_found is checked against
_AT = f"moments AS (SELECT DISTINCT rec AS event_id, raw AS snapshot_ts, utc_ms FROM ({core_sql.P6}) WHERE field = 'snapshot_ts' AND utc_ms IS NOT NULL)"
_L = f"""WITH {_AT}, o AS (SELECT a.*, utc_ms, CASE WHEN phase = 'CLOSE' THEN 1 ELSE 0 END AS pr FROM odds_archive a LEFT JOIN moments USING (event_id, snapshot_ts) WHERE price IS NOT NULL),
b AS (SELECT *, rank() OVER (PARTITION BY event_id, market, bookmaker, description ORDER BY pr DESC, utc_ms DESC NULLS LAST, CASE WHEN utc_ms IS NULL THEN snapshot_ts END DESC NULLS LAST) AS r FROM o),
l AS (SELECT DISTINCT event_id, market, bookmaker, description, outcome, point, price FROM b WHERE r = 1)"""
_CLUBS = "(SELECT league, club FROM clubs UNION SELECT 'CUP', club FROM clubs)"
_STOP = ", ".join(f"'{w}'" for w in fuzzy.STOP_WORDS)
_TOK = lambda c: f"list_filter(string_split(trim(regexp_replace(regexp_replace(translate(lower({c}), '{fuzzy._FROM}', '{fuzzy._TO}'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))"
_M = "m AS (SELECT DISTINCT match_id, league, date, home, away FROM matches)"
ORACLE = {
    "c9_composite_key": """WITH e AS (SELECT DISTINCT event_id, league, lower(trim(home_team)) h, lower(trim(away_team)) a FROM api_events JOIN leagues USING (sport_key)), c AS (SELECT DISTINCT league, lower(trim(club)) k FROM """ + _CLUBS + """)
SELECT e.league, count(*) FILTER (c1.k IS NOT NULL AND c2.k IS NOT NULL) AS matched, count(*) FILTER (c1.k IS NULL OR c2.k IS NULL) AS unmatched FROM e LEFT JOIN c c1 ON c1.league = e.league AND c1.k = e.h LEFT JOIN c c2 ON c2.league = e.league AND c2.k = e.a GROUP BY e.league""",
    "c10_fuzzy_names": f"""WITH n AS (SELECT DISTINCT league, u.name FROM api_events JOIN leagues USING (sport_key), (SELECT unnest([home_team, away_team]) AS name) u WHERE u.name IS NOT NULL),
a AS (SELECT *, {_TOK('name')} AS ta FROM n), r AS (SELECT DISTINCT league, club, {_TOK('club')} AS tb FROM {_CLUBS}),
p AS (SELECT a.league, a.name, r.club, CASE WHEN array_to_string(ta, ' ') = array_to_string(tb, ' ') THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_filter(ta, lambda t: len(list_filter(tb, lambda f: t = f OR (length(t) >= 3 AND starts_with(f, t)) OR (length(f) >= 3 AND starts_with(t, f)))) > 0)) / (len(ta) + len(tb)) END AS s FROM a JOIN r USING (league)),
q AS (SELECT *, row_number() OVER (PARTITION BY league, name ORDER BY s DESC, club) AS k FROM p WHERE s >= 0.5)
SELECT a.league, a.name, q.club, round(q.s, 6) AS score FROM a LEFT JOIN q ON a.league = q.league AND a.name = q.name AND q.k = 1""",
    "c11_settlement": f"WITH j AS (SELECT DISTINCT event_id, candidat, team_fd, league, home_fd, away_fd, CAST(commence AS DATE) AS d FROM journal), {_M} SELECT event_id, candidat, team_fd, min(match_id) AS match_id FROM j JOIN m ON j.league = m.league AND home_fd = home AND away_fd = away AND abs(date_diff('day', d, date)) <= 1 GROUP BY event_id, candidat, team_fd",
    "c12_latest_snapshot": _L + " SELECT * FROM l",
    "c13_nearest_line": _L + """, p AS (SELECT event_id, bookmaker, point, max(price) FILTER (lower(outcome) LIKE 'over%') AS o, max(price) FILTER (lower(outcome) LIKE 'under%') AS u FROM l WHERE market = 'alternate_totals_cards' AND point IS NOT NULL GROUP BY event_id, bookmaker, point),
q AS (SELECT *, row_number() OVER (PARTITION BY event_id, bookmaker ORDER BY abs(point - 4.5), point) AS k FROM p)
SELECT event_id, bookmaker, point AS level, o AS over, u AS under, round(CASE WHEN o > 1 AND u > 1 THEN (1/o)/(1/o+1/u) END, 6) AS fair_over FROM q WHERE k = 1""",
    "c14_anti_join": "SELECT DISTINCT event_id, candidat, team_fd FROM journal j WHERE NOT EXISTS (SELECT 1 FROM journal k WHERE k.regle AND k.event_id = j.event_id AND k.candidat = j.candidat AND k.team_fd = j.team_fd)",
    "g9_event_table": f"WITH {_AT} SELECT event_id, sport_key, commence_time, home, away FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY utc_ms IS NULL, utc_ms, CASE WHEN utc_ms IS NULL THEN snapshot_ts END, sport_key, commence_time, home, away) AS k FROM odds_archive LEFT JOIN moments USING (event_id, snapshot_ts)) WHERE k = 1",
    "g10_scorecard": _J + ", d AS (SELECT *, regle AND issue IS NOT NULL AS ok FROM j), g AS (SELECT candidat, count(*) FILTER (ok) AS n, CAST(coalesce(sum(CAST(issue AS INT)) FILTER (ok), 0) AS BIGINT) AS hits, avg(juste_pinnacle) FILTER (ok) AS f, sum(CAST(round(gain_pin * 100) AS BIGINT)) FILTER (ok) / (100 * count(gain_pin) FILTER (ok)) AS roi FROM d GROUP BY candidat) SELECT candidat, n, hits, round(f, 6) AS fair, round(hits / nullif(n, 0) - f, 6) AS edge, round(roi, 6) AS roi FROM g",
    "g11_coverage": "SELECT market, bookmaker, count(DISTINCT event_id) AS events FROM odds_archive GROUP BY market, bookmaker",
    "g12_figures": _J + " SELECT count(*) AS signals, count(*) FILTER (regle) AS settled, count(DISTINCT event_id) AS events, round(avg(gain_fr), 6) AS mean_gain FROM j",
    "f2_season_of": "WITH m AS (SELECT DISTINCT match_id, date FROM matches), y AS (SELECT match_id, year(date) - CASE WHEN month(date) >= 7 THEN 0 ELSE 1 END AS y FROM m) SELECT match_id, CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS label FROM y",
    "f23_snapshot_decision": _J + ", h AS (SELECT (epoch_us(commence) - epoch_us(CAST(emis_ts AS TIMESTAMPTZ))) / 3.6e9 AS h FROM j) SELECT CASE WHEN h >= 0 AND h <= 2.5 THEN 'CLOSE' WHEN h >= 16 AND h <= 36 THEN 'J1' ELSE 'none' END AS decision, count(*) AS n FROM h GROUP BY 1",
    "f24_budget": "WITH s AS (SELECT event_id, count(DISTINCT snapshot_ts) AS shots FROM odds_archive GROUP BY event_id) SELECT event_id, CAST(16 * sum(shots) OVER (ORDER BY event_id) AS BIGINT) AS cost, 16 * sum(shots) OVER (ORDER BY event_id) <= 15000 AS admitted FROM s",
    "f26_gains": _J + " SELECT event_id, candidat, team_fd, round(CASE WHEN issue THEN prix_pinnacle - 1 WHEN NOT issue THEN -1 END, 6) AS pin, round(CASE WHEN issue THEN greatest(prix_winamax, prix_unibet) - 1 WHEN NOT issue THEN -1 END, 6) AS fr FROM j",
    "s4_upcoming": _J + " SELECT event_id, candidat, team_fd, league FROM j WHERE NOT regle ORDER BY commence, event_id, candidat, team_fd LIMIT 12",
    "j_stream_dedupe_within": "SELECT DISTINCT event_id, ts, user_id, event_type FROM events",
    "j_stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "j_stream_dedupe": "SELECT DISTINCT snapshot_ts, event_id, bookmaker, market, outcome, point FROM odds_archive",
}
