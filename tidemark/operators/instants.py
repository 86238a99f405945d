"""Time texts of many forms, precisions and zones to one UTC instant.

A text is read into wall-clock parts and, where it states one, an offset. Wall times without an offset are
joined as-of to the intervals during which each zone kept one offset, laid out on the local clock: two intervals
hold an hour that occurs twice, none holds an hour that was skipped, one gives the offset directly.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone abbreviations in hours from UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "mez": 1, "mesz": 2, "eet": 2, "eest": 3, "msk": 3, "trt": 3,
    "jst": 9, "kst": 9, "hkt": 8, "sgt": 8, "awst": 8, "acst": 9.5, "acdt": 10.5, "aest": 10, "aedt": 11, "nzst": 12, "nzdt": 13,
    "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "akst": -9, "akdt": -8, "hst": -10, "brt": -3, "art": -3, "clt": -4, "clst": -3,
    "sast": 2, "pkt": 5, "ict": 7, "wib": 7,
}
# Month names without accents, in English, French, Spanish, German, Italian, Portuguese; the first three or four letters also occur alone.
MONTHS = (
    ("january", "janvier", "enero", "januar", "gennaio", "janeiro", "jan", "janv", "ene", "gen"),
    ("february", "fevrier", "febrero", "februar", "febbraio", "fevereiro", "feb", "fevr", "fev"),
    ("march", "mars", "marzo", "marz", "marco", "mar", "maerz"),
    ("april", "avril", "abril", "aprile", "apr", "avr", "abr"),
    ("may", "mai", "mayo", "maggio", "maio", "mag"),
    ("june", "juin", "junio", "juni", "giugno", "junho", "jun", "giu"),
    ("july", "juillet", "julio", "juli", "luglio", "julho", "jul", "juil", "lug"),
    ("august", "aout", "agosto", "aug", "ago"),
    ("september", "septembre", "septiembre", "settembre", "setembro", "sep", "sept", "set"),
    ("october", "octobre", "octubre", "oktober", "ottobre", "outubro", "oct", "okt", "ott", "out"),
    ("november", "novembre", "noviembre", "novembro", "nov"),
    ("december", "decembre", "diciembre", "dezember", "dicembre", "dezembro", "dec", "dez", "dic"),
)

_ZONE = r"(z|(?:utc|gmt)?[+-]\d{1,2}:?(?:\d{2})?|[a-z]{2,5})?"
_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)? ?(am|pm|a\.m\.|p\.m\.)?"
# Each form captures the same eleven groups' worth of parts; ORDER says which group is which.
FORMS = {
    "epoch": (r"^(-?\d{9,17})(?:\.(\d{1,9}))?$", {}),
    "ymd": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:t| )+{_CLOCK} ?{_ZONE}(?: ?\[.*\])?)?$", {"y": 1, "m": 2, "d": 3, "h": 4}),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?(x)? ?{_ZONE}$", {"y": 1, "m": 2, "d": 3, "h": 4}),
    "dmy": (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})(?:(?:t|,? )+{_CLOCK} ?{_ZONE})?$", {"d": 1, "m": 2, "y": 3, "h": 4}),
    "d_name_y": (rf"^(?:[a-z]+\.?,? )?(\d{{1,2}})(?:er|st|nd|rd|th)?\.?[ -](?:de |of )?([a-z]+)\.?[ -](?:de |del )?(\d{{4}})(?:,? (?:a |at |a las )?{_CLOCK} ?{_ZONE})?$", {"d": 1, "name": 2, "y": 3, "h": 4}),
    "name_d_y": (rf"^(?:[a-z]+\.?,? )?([a-z]+)\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? (?:at )?{_CLOCK} ?{_ZONE})?$", {"name": 1, "d": 2, "y": 3, "h": 4}),
}


def _parts(text: Column) -> dict[str, Column]:
    t = F.translate(F.lower(text), "àâäáéèêëíîïóôöúùûüçñ", "aaaaeeeeiiiooouuuucn")
    t = F.btrim(F.regexp_replace(t, r"[\s  ]+", " "))
    form = None
    for name, (p, _) in FORMS.items():
        c = t.rlike(p)
        form = F.when(c, F.lit(name)) if form is None else form.when(c, F.lit(name))
    return {"t": t, "form": form}


def read(df: DataFrame, text: str) -> DataFrame:
    """Adds `_form`, `_us` (epoch: UTC, else wall clock, in microseconds), `_offset` (seconds) and `_day_only`."""
    p = _parts(F.col(f"`{text}`"))
    x = df.withColumn("_t", p["t"]).withColumn("_form", p["form"])
    form = F.col("_form")
    months = F.create_map(*[F.lit(v) for i, names in enumerate(MONTHS) for n in names for v in (n, i + 1)])
    zones = F.create_map(*[F.lit(v) for k, h in ABBREVIATIONS.items() for v in (k, int(h * 3600))])

    def pick(part: str, shift: int = 0) -> Column:
        out = F.lit(None).cast("string")
        for name, (pattern, at) in FORMS.items():
            if part in at:
                out = F.when(form == name, F.regexp_extract("_t", pattern, at[part] + shift)).otherwise(out)
        return F.when(out != "", out)

    year, num = pick("y"), lambda c: c.try_cast("int")
    y = F.when(F.length(year) == 2, F.when(num(year) < 70, num(year) + 2000).otherwise(num(year) + 1900)).otherwise(num(year))
    m = F.coalesce(num(pick("m")), F.try_element_at(months, pick("name")))
    hour, noon = num(pick("h")), pick("h", 4)
    h = F.when(noon.startswith("p"), hour % 12 + 12).when(noon.startswith("a"), hour % 12).otherwise(hour)
    x = x.select("*", y.alias("_y"), m.alias("_m"), num(pick("d")).alias("_d"), h.alias("_h"), num(pick("h", 1)).alias("_mi"), F.coalesce(num(pick("h", 2)), F.lit(0)).alias("_s"), pick("h", 3).alias("_f"), pick("h", 5).alias("_z"))
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", "_y", "_m", "_d"), "yyyy-MM-dd")
    day = F.when(F.col("_y").isNotNull() & F.col("_m").isNotNull() & F.col("_d").isNotNull(), day)
    clock_ok = (F.col("_h") < 24) & (F.col("_mi") < 60) & (F.col("_s") < 61)
    wall = F.unix_date(day) * F.lit(86_400_000_000) + (F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_s")).cast("long") * 1_000_000 + F.coalesce(F.rpad("_f", 6, "0").cast("long"), F.lit(0))
    number, frac = F.regexp_extract("_t", FORMS["epoch"][0], 1), F.regexp_extract("_t", FORMS["epoch"][0], 2)
    digits = F.length(F.replace(number, F.lit("-"), F.lit("")))
    unit = F.when(digits <= 11, 1_000_000).when(digits <= 14, 1000).otherwise(1).cast("long")
    small = F.when(frac == "", 0).otherwise(F.rpad(frac, 9, "0").try_cast("long") * unit / F.lit(1e9)).cast("long")
    epoch = F.when(form == "epoch", number.try_cast("long") * unit + small)
    signed = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"
    sign = F.when(F.regexp_extract("_z", signed, 1) == "-", -1).when(F.regexp_extract("_z", signed, 1) == "+", 1)
    offset = F.coalesce(sign * (F.regexp_extract("_z", signed, 2).try_cast("int") * 3600 + F.coalesce(F.regexp_extract("_z", signed, 3).try_cast("int"), F.lit(0)) * 60), F.try_element_at(zones, F.col("_z")))
    x = x.select(
        "*",
        F.coalesce(epoch, F.when(clock_ok, wall)).alias("_us"),
        F.when(form == "epoch", 0).otherwise(offset).alias("_offset"),
        (day.isNotNull() & F.col("_h").isNull()).alias("_day_only"),
        (F.col("_z").isNotNull() & offset.isNull()).alias("_unknown_zone"),
    )
    return x.drop("_t", "_y", "_m", "_d", "_h", "_mi", "_s", "_f", "_z")


def known_zones(df: DataFrame, tz: str) -> list[str]:
    """The zone names of df that the IANA list holds: filtered before they are fetched, so 599 at the most."""
    return [r[0] for r in df.select(tz).where(F.col(tz).isin(*sorted(available_timezones()))).distinct().collect()]


def zone_intervals(spark: SparkSession, zones: list[str], first_year: int = 1970, last_year: int = 2100) -> DataFrame:
    """(tz, year, spans): for each local year the intervals of one offset, as local microseconds [since, until).

    At most one row per zone and year: 599 zones in the IANA list times the years, under 12 MB with the defaults.
    Unknown zone names are left out. Wall times of other years are resolved by normalise() from the zone's rules.
    """
    known, rows, us = available_timezones(), [], lambda t: int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
    for tz in sorted({z for z in zones if z in known}):
        zone, at, end = ZoneInfo(tz), datetime(first_year - 1, 12, 1, tzinfo=timezone.utc), datetime(last_year + 1, 2, 1, tzinfo=timezone.utc)
        off = lambda t, zone=zone: t.astimezone(zone).utcoffset()
        spans, since = [], at
        while at < end:
            nxt = at + timedelta(days=7)
            if off(nxt) != off(at):
                lo, hi = at, nxt
                while hi - lo > timedelta(seconds=1):
                    mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                    lo, hi = (mid, hi) if off(mid) == off(at) else (lo, mid)
                spans.append((since, hi, off(at)))
                since = hi
            at = nxt
        spans.append((since, end, off(since)))
        local = [(us(a) + o // timedelta(microseconds=1), us(b) + o // timedelta(microseconds=1), int(o.total_seconds())) for a, b, o in spans]
        for year in range(first_year, last_year + 1):
            lo, hi = us(datetime(year, 1, 1, tzinfo=timezone.utc)) - 86_400_000_000, us(datetime(year + 1, 1, 1, tzinfo=timezone.utc)) + 86_400_000_000
            rows.append((tz, year, [s for s in local if s[0] < hi and s[1] > lo]))
    return spark.createDataFrame(rows, "_tz string, _year int, spans array<struct<since:bigint,until:bigint,offset:int>>")


def normalise(df: DataFrame, text: str, tz: str, zones: DataFrame) -> DataFrame:
    """Adds `utc_us` and `time_status` to each row; df's columns stay (those two names are replaced).

    time_status: `instant` (the text fixes it), `direct`, `ambiguous` (first pass taken), `nonexistent` (the offset before
    the gap taken), `no_zone` (wall time, zone null or unknown), `unknown_zone` (an abbreviation not listed),
    `day_only`, `unreadable`; utc_us is null for the last four. A null or empty text is `unreadable`.
    zones: zone_intervals(), broadcast under the bound given there. Wall times of years that it does not cover are few; they are
    resolved one by one by the zone's rules, with the same outcomes.
    """
    x = read(df.drop("utc_us", "time_status"), text)
    year, (first, last) = F.year(F.timestamp_micros("_us")), zones.agg(F.min("_year"), F.max("_year")).first()
    needs = F.col("_offset").isNull() & F.col("_us").isNotNull() & ~F.col("_unknown_zone")
    covered = F.least(F.greatest(year, F.lit(first)), F.lit(last))
    x = x.withColumn("_y", F.when(needs, covered)).withColumn("_zone", F.when(needs, F.col(f"`{tz}`"))).withColumn("_beyond", needs & (covered != year))
    x = x.join(F.broadcast(zones), (F.col("_zone") == F.col("_tz")) & (F.col("_y") == F.col("_year")), "left")
    hit = F.filter("spans", lambda s: (s["since"] <= F.col("_us")) & (F.col("_us") < s["until"]))
    before = F.filter("spans", lambda s: s["until"] <= F.col("_us"))
    # by rule: the offset of the first pass, or the one before a gap; the offset some hours on may give a second pass
    micros = lambda t: F.unix_micros(t)
    at = F.timestamp_micros("_us")
    offset_at = lambda us: (micros(F.from_utc_timestamp(F.timestamp_micros(us), F.col("_tz"))) - us) / 1_000_000
    one = ((F.col("_us") - micros(F.to_utc_timestamp(at, F.col("_tz")))) / 1_000_000).cast("int")
    early = F.col("_us") - one.cast("long") * 1_000_000
    two = offset_at(early + 3 * 3_600_000_000).cast("int")
    span = lambda o: F.struct(F.lit(None).cast("long").alias("since"), F.lit(None).cast("long").alias("until"), o.alias("offset"))
    holds = lambda o: offset_at(F.col("_us") - o.cast("long") * 1_000_000).cast("int") == o
    by_rule = F.filter(F.array_distinct(F.array(one, two)), holds)
    beyond = F.col("_beyond") & F.col("_tz").isNotNull()
    x = x.withColumn("_hit", F.when(beyond, F.transform(by_rule, span)).otherwise(hit))
    wall_offset = F.when(F.size("_hit") > 0, F.array_max(F.transform("_hit", lambda s: s["offset"]))).otherwise(F.when(beyond, one).otherwise(F.try_element_at(before, F.lit(-1))["offset"]))
    offset = F.coalesce("_offset", F.when(F.col("_hit").isNotNull(), wall_offset))
    status = (
        F.when(F.col("_day_only"), "day_only")
        .when(F.col("_us").isNull(), "unreadable")
        .when(F.col("_unknown_zone"), "unknown_zone")
        .when(F.col("_offset").isNotNull(), "instant")
        .when(F.col("_hit").isNull(), "no_zone")
        .when(F.size("_hit") == 0, "nonexistent")
        .when(F.size("_hit") == 1, "direct")
        .otherwise("ambiguous")
    )
    x = x.withColumn("time_status", status).withColumn("utc_us", F.when(F.col("time_status").isin("instant", "direct", "ambiguous", "nonexistent"), F.col("_us") - offset.cast("long") * 1_000_000))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("utc_us", "time_status")]
    return x.select(*keep, "utc_us", "time_status")
