"""Rows that fail to parse: typed valid rows and, for every other line, the first broken field.

For each header one anchored pattern for the whole row is generated. Lines it does not match go through
the patterns of ever longer field prefixes; the longest that matches names the first broken field.
All of it is SQL text functions on columns, so the patterns travel with the rows and nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, is_small

# Days that exist, as d/m/yy, d/m/yyyy or yyyy-mm-dd. In two digits 00 is 2000, a leap year, so every fourth is one.
_LEAP4 = r"(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
_LEAP2 = r"(?:[02468][048]|[13579][26])"
_DMY = (
    r"(?:(?:0?[1-9]|1\d|2[0-8])/(?:0?[1-9]|1[0-2])/(?:\d{4}|\d\d)"
    r"|(?:29|30)/(?:0?[13-9]|1[0-2])/(?:\d{4}|\d\d)"
    r"|31/(?:0?[13578]|1[02])/(?:\d{4}|\d\d)"
    rf"|29/0?2/(?:{_LEAP4}|{_LEAP2}))"
)
_YMD = (
    r"(?:\d{4}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])"
    r"|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
    rf"|{_LEAP4}-02-29)"
)
DAY = rf"(?:{_DMY}|{_YMD})"
COUNT = r"(?:0*(?:\d|[12]\d|30)(?:\.0*)?)"
BLANK = r"[ \t ]*"


@dataclass(frozen=True)
class Field:
    """A checked column: its name in the header, the kind of value and the reason reported when it is broken."""

    name: str
    kind: str  # day | count | name

    @property
    def reason(self) -> str:
        return {"day": "not_an_existing_day", "count": "not_a_whole_number_0_to_30", "name": "no_letter"}[self.kind]


FIXTURE_FIELDS = (Field("Date", "day"), Field("HomeTeam", "name"), Field("AwayTeam", "name"), Field("FTHG", "count"), Field("FTAG", "count"))


def _free(sep: Column) -> Column:
    """Any RFC 4180 field: quoted with doubled quotes, or bare without quote and separator. Possessive: no backtracking."""
    return F.concat(F.lit(r'(?:[ \t ]*+"(?:[^"]|"")*+"[ \t ]*+|[^"\r\n'), sep, F.lit("]*+)"))


def _value(inner: str, sep: Column) -> Column:
    return F.lit(rf'(?:{BLANK}"{BLANK}{inner}{BLANK}"{BLANK}|{BLANK}{inner}{BLANK})')


def _letter(sep: Column) -> Column:
    """A field with a letter in it."""
    return F.concat(
        F.lit(r'(?:[ \t ]*+"(?:[^"\p{L}]|"")*+\p{L}(?:[^"]|"")*+"[ \t ]*+|[^"\r\n\p{L}'), sep,
        F.lit(r']*+\p{L}[^"\r\n'), sep, F.lit("]*+)"),
    )


def _patterns(header: Column, sep: Column, fields: tuple[Field, ...]) -> Column:
    """Per header field its pattern, in order."""

    def one(name: Column) -> Column:
        n, out = F.lower(name), None
        for f in fields:
            p = {"day": lambda: _value(DAY, sep), "count": lambda: _value(COUNT, sep), "name": lambda: _letter(sep)}[f.kind]()
            out = F.when(n == f.name.lower(), p) if out is None else out.when(n == f.name.lower(), p)
        return out.otherwise(_free(sep)) if out is not None else _free(sep)

    return F.transform(header, one)


def headers(lines: DataFrame, file: str = "source_file", line_no: str = "line_no", text: str = "raw_line") -> DataFrame:
    """(_file, _h): line 1 of each file without byte order mark; repeated header lines give one row."""
    h = lines.where(F.col(line_no) == 1).groupBy(F.col(file).alias("_file")).agg(F.min(text).alias("_h"))
    return h.withColumn("_h", F.regexp_replace(F.coalesce("_h", F.lit("")), "^\ufeff|[\r\n]+$", ""))


def schemas(heads: DataFrame, fields: tuple[Field, ...] = FIXTURE_FIELDS) -> DataFrame:
    """(_schema, names, sep, usable, whole, prefixes) for each distinct header text."""
    h = heads.select("_h").distinct()
    count = lambda s: F.length("_h") - F.length(F.replace("_h", F.lit(s), F.lit("")))
    seps = [",", ";", "\t", "|"]
    best = F.greatest(*[F.struct(count(s).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(seps)])
    h = h.withColumn("sep", best["s"])
    esc = F.concat(F.lit("\\"), F.col("sep"))
    h = h.withColumn("names", F.transform(F.split("_h", F.concat(F.lit(r"\Q"), "sep", F.lit(r"\E"))), lambda x: F.btrim(F.btrim(x), F.lit('"'))))
    h = h.withColumn("_p", _patterns(F.col("names"), esc, fields))
    need = F.array(*[F.lit(f.name.lower()) for f in fields])
    lower = F.transform("names", F.lower)
    h = h.withColumn("usable", F.forall(need, lambda n: F.size(F.filter(lower, lambda x: x == n)) == 1))
    # the row pattern, and the ever longer prefixes; each prefix must end at a separator or at the end of the line
    glue = lambda part: F.aggregate(F.slice(part, 2, F.size(part)), part[0], lambda acc, x: F.concat(acc, esc, x))
    prefix = lambda k: F.concat(F.lit("^"), glue(F.slice("_p", 1, k)), F.lit("(?:"), esc, F.lit(r"|\r?$)"))
    return h.select(
        F.col("_h").alias("_schema"), "names", "sep", "usable",
        F.concat(F.lit("^"), glue(F.col("_p")), F.lit(r"\r?$")).alias("whole"),
        F.transform(F.sequence(F.lit(1), F.size("_p")), prefix).alias("prefixes"),
    )


def parse(lines: DataFrame, fields: tuple[Field, ...] = FIXTURE_FIELDS, file: str = "source_file", line_no: str = "line_no", text: str = "raw_line", salts: int = 32) -> DataFrame:
    """Every line after its file's header with `valid`, `reason`, `broken_field`, `field_no` and the typed values.

    Null text, an empty line and a repeated header are lines that fail. A file whose first line is missing or
    lacks (or repeats) a checked column makes all its lines fail with reason `unusable_header`. Very long lines
    are matched whole; possessive patterns keep that linear. Repeated rows are each reported. Columns that the
    input has besides the three are kept; those with the names of the results are replaced.

    A file may hold a large part of all lines: lines are salted, and the one header row per file is repeated for each salt.
    The patterns are built once per distinct header; they are broadcast if their bytes are within is_small(), else joined by salt too.
    """
    names = ["valid", "reason", "broken_field", "field_no", *[f.name for f in fields]]
    keep = [F.col(f"`{c}`") for c in lines.columns if c.lower() not in {n.lower() for n in names}]
    heads = headers(lines, file, line_no, text)
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    body = lines.where(F.coalesce(F.col(line_no) > 1, F.lit(True))).select(*keep, F.pmod(F.hash(line_no, text), F.lit(salts)).alias("_s"), F.col(file).alias("_f"))
    salted = heads.withColumn("_salt", every)
    x = body.join(salted, (body["_f"].eqNullSafe(salted["_file"])) & (body["_s"] == salted["_salt"]), "left").drop("_salt")
    known = cut_lineage(schemas(heads, fields))
    if is_small(known):
        x = x.join(F.broadcast(known), F.col("_h") == F.col("_schema"), "left")
    else:
        known = known.withColumn("_salt", every)
        x = x.join(known, (F.col("_h") == F.col("_schema")) & (F.col("_s") == F.col("_salt")), "left")
    # regexp_extract keeps the compiled pattern while it stays the same, rlike on a column compiles per row
    ok = F.coalesce(F.col("usable"), F.lit(False)) & F.col(text).isNotNull()
    x = x.withColumn("valid", F.when(ok, F.length(F.regexp_replace(text, F.col("whole"), "")) == 0).otherwise(False) & (F.length(F.coalesce(F.col(text), F.lit(""))) > 0))
    good = F.when(~F.col("valid") & ok, F.size(F.filter("prefixes", lambda p: F.rlike(F.col(text), p))))
    x = x.withColumn("_good", good).withColumn("_n", F.size("names"))
    x = x.withColumn("field_no", F.when(F.col("_good").isNotNull(), F.least(F.col("_good") + 1, F.col("_n") + 1)))
    x = x.withColumn("broken_field", F.when(F.col("field_no") <= F.col("_n"), F.try_element_at("names", F.col("field_no"))))
    # what is wrong at the first broken field: is it absent, is it quoted wrongly, or is it a value of the wrong kind?
    esc = F.concat(F.lit("\\"), F.col("sep"))
    any_field = _free(esc)
    before = F.concat(F.lit("^(?:"), any_field, esc, F.lit("){"), (F.col("field_no") - 1).cast("string"), F.lit("}"))
    there = F.rlike(F.col(text), before)
    whole_field = F.rlike(F.col(text), F.concat(before, any_field, F.lit("(?:"), esc, F.lit(r"|\r?$)")))
    kind = None
    for f in fields:
        c = F.lower("broken_field") == f.name.lower()
        kind = F.when(c, F.lit(f.reason)) if kind is None else kind.when(c, F.lit(f.reason))
    reason = (
        F.when(F.col("valid"), None)
        .when(F.col(text).isNull() | (F.btrim(text) == ""), "empty_line")
        .when(~F.coalesce(F.col("usable"), F.lit(False)), "unusable_header")
        .when(F.col("field_no") > F.col("_n"), "too_many_fields")
        .when(~there, "too_few_fields")
        .when(~whole_field, "broken_quoting")
        .otherwise(kind if kind is not None else F.lit("broken_field"))
    )
    x = x.withColumn("reason", reason)
    out = []
    for f in fields:
        at = F.array_position(F.transform("names", F.lower), f.name.lower()).cast("int")
        skip = F.concat(F.lit("^(?:"), any_field, esc, F.lit("){"), (at - 1).cast("string"), F.lit("}("), any_field, F.lit(")"))
        raw = F.btrim(F.call_function("regexp_extract", F.col(text), skip, F.lit(1)), F.lit(" \t\u00a0"))
        raw = F.when(raw.startswith('"'), F.btrim(F.replace(F.substring(raw, 2, F.length(raw) - 2), F.lit('""'), F.lit('"')), F.lit(" \t\u00a0"))).otherwise(raw)
        out.append(F.when(F.col("valid"), _typed(raw, f.kind)).alias(f.name))
    return x.select(*[F.col(f"`{c}`") for c in lines.columns if c.lower() not in {n.lower() for n in names}], "valid", "reason", "broken_field", "field_no", *out)


def _typed(raw: Column, kind: str) -> Column:
    if kind == "count":
        return F.regexp_extract(raw, r"^(\d+)", 1).try_cast("int")
    if kind == "day":
        part = lambda i: F.try_element_at(F.split(raw, "/"), F.lit(i)).try_cast("int")
        year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
        return F.when(raw.contains("-"), F.try_to_date(raw, "yyyy-MM-dd")).otherwise(F.try_make_timestamp(year, part(2), part(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    return raw
