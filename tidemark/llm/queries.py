"""Queries of the training-data text and matching operators, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import entities, leakage, names, nearest, packing, truncation
from tidemark.operators import instants
from tidemark.session import cut_lineage, table

CUP = "CUP"
LESS_LOSS, TOKENS_ONLY = packing.Limits(loss=1536), packing.Limits(segments=2048, loss=2048)


def roster(spark: SparkSession, base: str) -> DataFrame:
    """(league, club, club_id); the cup's roster is all clubs."""
    c = table(spark, base, "clubs").select("league", "club", "club_id").where("club is not null")
    return c.unionByName(c.select(F.lit(CUP).alias("league"), "club", "club_id")).distinct()


def _leagues(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "leagues").select("sport_key", "league", "tz").dropDuplicates(["sport_key"])


def p4_links(spark: SparkSession, base: str) -> DataFrame:
    """Every distinct written name of odds_archive and matches with the club meant, -1 where none is."""
    o = table(spark, base, "odds_archive").select("sport_key", "home", "away").distinct()
    o = o.join(_leagues(spark, base), "sport_key").select("league", F.explode(F.array("home", "away")).alias("written"))
    m = table(spark, base, "matches").select("league", F.explode(F.array("home", "away")).alias("written"))
    return names.link(o.unionByName(m), roster(spark, base))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """The names that are not on their league's roster character for character, with the club meant or -1."""
    on_roster = roster(spark, base).select("league", F.col("club").alias("written"))
    return p4_links(spark, base).select("league", "written", "club_id").join(on_roster, ["league", "written"], "left_anti")


def p4_unmatched(spark: SparkSession, base: str) -> DataFrame:
    """Names by which no club of the roster is meant, counted by league."""
    return p4_links(spark, base).where("club_id = -1").groupBy("league").agg(F.count("*").alias("n"))


def fixtures_linked(spark: SparkSession, base: str) -> DataFrame:
    """Each event of the bookmaker feed with its match and the confidence, or with none."""
    leagues = _leagues(spark, base)
    zones = instants.zone_intervals(spark, [r[0] for r in leagues.select("tz").where("tz is not null").distinct().collect()])
    local_day = lambda us, tz: F.unix_date(F.to_date(F.from_utc_timestamp(F.timestamp_micros(us), F.coalesce(tz, F.lit("UTC")))))
    e = table(spark, base, "api_events").groupBy("event_id").agg(F.max(F.struct("fetched_at", "sport_key", "commence_time", "home_team", "away_team")).alias("x"))
    e = e.select("event_id", "x.*").join(leagues, "sport_key", "left")
    m = table(spark, base, "matches").groupBy("match_id").agg(F.min(F.struct("league", "date", "home", "away")).alias("x"), F.max("date_str").alias("date_str"))
    m = m.select("match_id", "x.*", "date_str").join(leagues.select("league", "tz").dropDuplicates(["league"]), "league", "left")
    # both listings go through one plan: the driver plans, compiles and broadcasts once what they have in common
    listed = e.select(F.lit(False).alias("is_match"), F.col("event_id").alias("id"), "league", F.col("home_team").alias("home"), F.col("away_team").alias("away"), F.col("commence_time").alias("at"), "tz", F.lit(None).cast("int").alias("day"))
    listed = listed.unionByName(m.select(F.lit(True).alias("is_match"), F.col("match_id").alias("id"), "league", "home", "away", F.col("date_str").alias("at"), "tz", F.unix_date("date").alias("day")))
    # used for two columns: computed once; taken before the times are read, which names do without
    ids = cut_lineage(names.link(listed.select("league", F.explode(F.array("home", "away")).alias("written")), roster(spark, base)).where("club_id >= 0").select("league", "written", "club_id"))
    both = listed
    for side in ("home", "away"):
        both = both.join(ids.select("league", F.col("written").alias(side), F.col("club_id").alias(f"{side}_id")), ["league", side], "left")
    # after the joins: the planner would copy the reading of texts into each side of the union
    both = instants.normalise(both, "at", "tz", zones)
    both = cut_lineage(both.select("is_match", "id", "league", "home_id", "away_id", "utc_us", F.when(F.col("is_match"), F.col("day")).otherwise(local_day(F.col("utc_us"), F.col("tz"))).alias("day")))

    def named(rows: DataFrame, key: str, c: str) -> DataFrame:
        return rows.select(F.col("id").alias(key), F.col("league").alias(f"{c}_league"), F.col("home_id").alias(f"{c}_home"), F.col("away_id").alias(f"{c}_away"), F.col("utc_us").alias(f"{c}_us"), F.col("day").alias(f"{c}_day"))

    e, m = named(both.where("not is_match"), "event_id", "e"), named(both.where("is_match"), "match_id", "m")
    return entities.cascade(e, m, "event_id", "match_id", entities.fixture_rules(), computed=True)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """The pairs in which the event is that very fixture."""
    return fixtures_linked(spark, base).where("match_id is not null").select("event_id", "match_id")


def p1_linked(spark: SparkSession, base: str) -> DataFrame:
    """Every event with its match, the rule that found it and the confidence, or with none."""
    return fixtures_linked(spark, base)


def _signals(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "journal").select("event_id", "candidat", "team_fd", "home_fd", "commence").dropDuplicates(["event_id", "candidat", "team_fd"])


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Each journal key with the match of the same home club nearest to its kick-off, at most 36 hours away."""
    m = table(spark, base, "matches").select("match_id", F.col("home").alias("m_home"), F.timestamp_micros(F.unix_micros(F.col("date").cast("timestamp")) + F.lit(12 * 3_600_000_000)).alias("m_noon"))
    x = nearest.nearest(_signals(spark, base), m, "home_fd", "commence", "m_home", "m_noon", "match_id", 36 * 3600)
    return x.select("event_id", "candidat", "team_fd", "match_id")


def p5_open(spark: SparkSession, base: str) -> DataFrame:
    """Signals that stay open, by candidate."""
    done = p5_found(spark, base).select("event_id", "candidat", "team_fd")
    return _signals(spark, base).join(done, ["event_id", "candidat", "team_fd"], "left_anti").groupBy("candidat").agg(F.count("*").alias("n_open"))


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    # the first line of an item is its instruction
    items = table(spark, base, "bench_items").select("item_id", F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.col("text")).alias("passage"))
    return leakage.find(table(spark, base, "documents"), "doc_id", "text", items, "item_id", "passage")


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """The documents that hold passages of test items, and which."""
    return _leaks(spark, base)


def p8_items(spark: SparkSession, base: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return _leaks(spark, base).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p7_packed(spark: SparkSession, base: str) -> DataFrame:
    """The texts, or the pieces of those beyond a container, with the container each is placed in; all three limits bind."""
    return packing.packed(table(spark, base, "documents"), "doc_id", "text")


def p7_packed_loss(spark: SparkSession, base: str) -> DataFrame:
    """The same with fewer loss-bearing tokens to a container, so that this limit binds in most."""
    return packing.packed(table(spark, base, "documents"), "doc_id", "text", LESS_LOSS)


def p7_packed_tokens(spark: SparkSession, base: str) -> DataFrame:
    """The same by tokens alone: what the other limits cost is the difference."""
    return packing.packed(table(spark, base, "documents"), "doc_id", "text", TOKENS_ONLY)


def _fill(packed: DataFrame, limits: packing.Limits) -> DataFrame:
    c = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("n_loss").alias("loss"))
    shared = F.col("segments") > 1  # a text of more loss than the limit stands alone, but for texts without loss
    return c.agg(
        F.count("*").alias("containers"), F.ceil(F.sum("tokens") / limits.tokens).alias("fewest"), (1 - F.sum("tokens") / (F.count("*") * limits.tokens)).alias("unused"),
        F.max("tokens").alias("most_tokens"), F.max("segments").alias("most_segments"), F.max(F.when(shared, F.col("loss"))).alias("most_loss"),
        F.count_if(F.col("tokens") == limits.tokens).alias("at_tokens"), F.count_if(F.col("segments") == limits.segments).alias("at_segments"), F.count_if(F.col("loss") >= limits.loss).alias("at_loss"),
    )


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    """Containers used, the fewest possible by tokens alone, the share of space left unused, and how many containers reach each limit."""
    return _fill(p7_packed(spark, base), packing.Limits())


def p7_fill_loss(spark: SparkSession, base: str) -> DataFrame:
    """The same of p7_packed_loss."""
    return _fill(p7_packed_loss(spark, base), LESS_LOSS)


def p7_fill_tokens(spark: SparkSession, base: str) -> DataFrame:
    """The same of p7_packed_tokens."""
    return _fill(p7_packed_tokens(spark, base), TOKENS_ONLY)


def _ends(spark: SparkSession, base: str) -> DataFrame:
    return truncation.ends(table(spark, base, "documents").select("doc_id", "source", "text"), "text", "source")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """The documents that stop before they are finished."""
    return _ends(spark, base).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, base: str) -> DataFrame:
    """How often each source cuts."""
    return _ends(spark, base).groupBy("source").agg(F.count("*").alias("n"), F.count_if("cut").alias("n_cut"), (F.count_if("cut") / F.count("cut")).alias("share"))


def p9_stages(spark: SparkSession, base: str) -> DataFrame:
    """What found the cut texts: the length histograms, or the ends of texts away from any spike."""
    return _ends(spark, base).where("cut").groupBy("source", "stage", "evidence").agg(F.count("*").alias("n"))


def p9_limits(spark: SparkSession, base: str) -> DataFrame:
    """Lengths at which a source's texts pile up."""
    return truncation.limits(table(spark, base, "documents"), "text", "source")


QUERIES = {f.__name__: f for f in (p1_found, p1_linked, p4_found, p4_links, p4_unmatched, p5_found, p5_open, p7_packed, p7_packed_loss, p7_packed_tokens, p7_fill, p7_fill_loss, p7_fill_tokens, p8_found, p8_items, p9_found, p9_rates, p9_stages, p9_limits)}
_P5 = """
WITH s AS (SELECT DISTINCT event_id, candidat, team_fd, home_fd, commence FROM journal),
m AS (SELECT DISTINCT match_id, home, CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR AS noon FROM matches),
r AS (
  SELECT s.event_id, s.candidat, s.team_fd, m.match_id,
         row_number() OVER (PARTITION BY s.event_id, s.candidat, s.team_fd
                            ORDER BY abs(epoch_us(s.commence) - epoch_us(m.noon)), m.match_id) AS n
  FROM s JOIN m ON s.home_fd = m.home AND abs(epoch_us(s.commence) - epoch_us(m.noon)) <= 129600000000),
found AS (SELECT event_id, candidat, team_fd, match_id FROM r WHERE n = 1)
"""
_BODY = r"regexp_replace(text, '[ ]?(?:(?:\[ ?(?:\.\.\.|…) ?\]|\( ?(?:\.\.\.|…) ?\)|\.\.\.|…)[ ]?\[?\+ ?\d+ (?:chars|characters|caractères|caracteres)\]?|(?:\[ ?(?:\.\.\.|…) ?\]|\( ?(?:\.\.\.|…) ?\)|\.\.\.|…)|\[?\+ ?\d+ (?:chars|characters|caractères|caracteres)\]?)$', '')"
_P9 = f"""
WITH d AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT source, 'chars' AS unit, length({_BODY}) AS length FROM d UNION ALL SELECT source, 'bytes', octet_length(encode({_BODY})) FROM d),
h AS (SELECT source, unit, length, count(*) AS n FROM l GROUP BY ALL),
u AS (SELECT a.source, a.unit, a.length, a.n, greatest(coalesce(sum(b.n) FILTER (b.length < a.length), 0) / 20.0::DOUBLE, coalesce(sum(b.n) FILTER (b.length > a.length), 0) / 20.0::DOUBLE) AS usual
  FROM h a LEFT JOIN h b ON a.source IS NOT DISTINCT FROM b.source AND a.unit = b.unit AND abs(a.length - b.length) BETWEEN 1 AND 20 GROUP BY ALL)
SELECT source, unit, CAST(length AS INT) AS length, n, usual FROM u WHERE n >= 5 AND n >= 5 * (usual + 0.2) AND n >= usual + 5 * sqrt(usual)"""
ORACLE: dict[str, str] = {
    "p9_limits": _P9,
    "p5_found": _P5 + "SELECT * FROM found",
    "p5_open": _P5 + """SELECT s.candidat, count(*) AS n_open FROM s LEFT JOIN found f
  ON s.event_id = f.event_id AND s.candidat = f.candidat AND s.team_fd = f.team_fd
WHERE f.event_id IS NULL GROUP BY s.candidat""",
}
