"""Queries of the core problems: rows that fail to parse, attributes as known at event time, mixed time texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dyadic, instants, lines
from tidemark.plans import core_sql
from tidemark.session import table


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Every line after a file's header that is not a valid row by itself."""
    return lines.parse(table(spark, base, "raw_lines")).where(~F.col("valid")).select("source_file", "line_no")


def p2_reasons(spark: SparkSession, base: str) -> DataFrame:
    """Rejected lines by file, reason and first broken field."""
    bad = lines.parse(table(spark, base, "raw_lines")).where(~F.col("valid"))
    return bad.groupBy("source_file", "reason", F.coalesce("broken_field", F.lit("")).alias("broken_field")).agg(F.count("*").alias("n"))


def p2_valid(spark: SparkSession, base: str) -> DataFrame:
    """The valid rows with typed columns."""
    good = lines.parse(table(spark, base, "raw_lines")).where("valid")
    return good.select("source_file", "line_no", F.col("Date").alias("match_date"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"), F.col("FTHG").alias("fthg"), F.col("FTAG").alias("ftag"))


def time_texts(spark: SparkSession, base: str) -> DataFrame:
    """(field, rec, raw, tz), each distinct text once: one wide read per table, de-duplicated before anything is parsed."""
    leagues = table(spark, base, "leagues")
    by_league = leagues.select("league", "tz").dropDuplicates(["league"])
    by_key = leagues.select("sport_key", "tz").dropDuplicates(["sport_key"])
    m = table(spark, base, "matches").select(F.lit("date_str").alias("field"), F.col("match_id").alias("rec"), F.col("date_str").alias("raw"), "league").where("raw is not null").distinct()
    a = table(spark, base, "api_events").select(F.lit("commence_time").alias("field"), F.col("event_id").alias("rec"), F.col("commence_time").alias("raw"), "sport_key")
    o = table(spark, base, "odds_archive").select(
        F.col("event_id").alias("rec"), "sport_key",
        F.inline(F.array(F.struct(F.lit("commence_time").alias("field"), F.col("commence_time").alias("raw")), F.struct(F.lit("snapshot_ts").alias("field"), F.col("snapshot_ts").alias("raw")))),
    )
    e = a.unionByName(o).where("raw is not null").distinct()
    # leagues: one row per competition, a few dozen
    return m.join(by_league, "league", "left").drop("league").unionByName(e.join(by_key, "sport_key", "left").drop("sport_key"))


def _instants(spark: SparkSession, base: str) -> DataFrame:
    zones = instants.known_zones(table(spark, base, "leagues"), "tz")
    return instants.normalise(time_texts(spark, base), "raw", "tz", instants.zone_intervals(spark, zones))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Each distinct time text with its UTC instant in milliseconds."""
    x = _instants(spark, base).where(F.col("utc_us").isNotNull())
    return x.select("field", "rec", "raw", F.floor(F.col("utc_us") / 1000).cast("long").alias("utc_ms")).distinct()


def p6_status(spark: SparkSession, base: str) -> DataFrame:
    """How the instants were determined, by field."""
    return _instants(spark, base).groupBy("field", "time_status").agg(F.count("*").alias("n"))


def result_versions(matches: DataFrame) -> DataFrame:
    """Results as they became known: (club, d, match_id, known, until, fthg, ftag), for each club that played.

    known: the first day at whose start the row was recorded and the match day was over. Of the rows of a match that became
    known on the same day the last recorded counts (ties: the greater goals). Rows without a date, id, both goals or
    a time of record are no results.
    """
    m = matches.where("match_id is not null and date is not null and recorded_at is not null and fthg is not null and ftag is not null")
    d = F.unix_date("date")
    known = F.greatest(d, F.unix_date(F.col("recorded_at").cast("date"))) + 1
    v = m.select("match_id", d.alias("d"), "home", "away", known.alias("known"), F.struct("recorded_at", F.col("fthg").cast("long").alias("fthg"), F.col("ftag").cast("long").alias("ftag")).alias("g"))
    v = v.groupBy("match_id", "d", "home", "away", "known").agg(F.max("g").alias("g"))
    v = v.select("match_id", "d", "known", "g.fthg", "g.ftag", F.explode(F.array_distinct(F.array("home", "away"))).alias("club")).where("club is not null")
    return dyadic.validity(v, "club", ["d", "match_id", "known"], "known", F.floor(F.col("d") / 128).cast("int"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """For both sides of every match the club's last result as it was known when the match day began."""
    m = table(spark, base, "matches").select("match_id", "date", "home", "away", "fthg", "ftag", "recorded_at")
    sides = F.array(F.struct(F.lit("home").alias("side"), F.col("home").alias("club")), F.struct(F.lit("away").alias("side"), F.col("away").alias("club")))
    e = m.select("match_id", F.unix_date("date").alias("day"), "home", "away").distinct().select("match_id", "day", F.inline(sides))
    v = result_versions(m).select("club", "known", "until", F.col("match_id").alias("prior_id"), F.col("fthg").alias("prior_fthg"), F.col("ftag").alias("prior_ftag"))
    return dyadic.as_known(e, v, "club", "day", ["match_id", "side"], "known", "until", ["prior_id", "prior_fthg", "prior_ftag"])


QUERIES = {f.__name__: f for f in (p2_found, p2_reasons, p2_valid, p3_found, p6_found, p6_status)}

ORACLE = core_sql.ORACLE
