"""ANSI SQL for the queries of plans/core_problems.py."""

from __future__ import annotations


def _fields(sep: str) -> str:
    """The fields of an RFC 4180 line, or null where the quoting is broken."""
    field = rf'(?:[ \t\x{{00a0}}]*"(?:[^"]|"")*"[ \t\x{{00a0}}]*|[^"{sep}]*)'
    return f"CASE WHEN regexp_full_match(raw_line, '{field}(?:{sep}{field})*') THEN regexp_extract_all('{sep}' || raw_line, '{sep}({field})', 1) END"


_P2 = f"""
WITH h AS (
  SELECT source_file, raw_line AS hl, CASE WHEN length(hl) - length(replace(hl, ',', '')) >= length(hl) - length(replace(hl, ';', '')) THEN ',' ELSE ';' END AS sep,
         list_transform(string_split(hl, sep), lambda x: lower(trim(trim(x), '"'))) AS names
  FROM raw_lines WHERE line_no = 1),
l AS (
  SELECT r.source_file, r.line_no, r.raw_line, names, CASE WHEN sep = ',' THEN {_fields(',')} ELSE {_fields(';')} END AS raw
  FROM raw_lines r JOIN h ON r.source_file = h.source_file WHERE r.line_no > 1),
f AS (
  SELECT *, list_transform(raw, lambda x: CASE WHEN trim(x) LIKE '"%' THEN trim(replace(substr(trim(x), 2, length(trim(x)) - 2), '""', '"')) ELSE trim(x) END) AS v FROM l),
g AS (
  SELECT source_file, line_no, len(v) AS n, len(names) AS want, v[list_position(names, 'date')] AS d, v[list_position(names, 'hometeam')] AS home, v[list_position(names, 'awayteam')] AS away,
         v[list_position(names, 'fthg')] AS hg, v[list_position(names, 'ftag')] AS ag FROM f),
t AS (
  SELECT *, CASE WHEN regexp_full_match(d, '\\d{{4}}-\\d\\d-\\d\\d') THEN try_strptime(d, '%Y-%m-%d') WHEN regexp_full_match(d, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime(d, '%d/%m/%Y')
           WHEN regexp_full_match(d, '\\d{{1,2}}/\\d{{1,2}}/\\d\\d') THEN try_strptime(d, '%d/%m/%y') END AS day,
         CASE WHEN regexp_full_match(hg, '\\d+(\\.0*)?') THEN TRY_CAST(regexp_extract(hg, '^\\d+') AS INT) END AS h, CASE WHEN regexp_full_match(ag, '\\d+(\\.0*)?') THEN TRY_CAST(regexp_extract(ag, '^\\d+') AS INT) END AS a FROM g),
c AS (SELECT *, coalesce(n = want AND day IS NOT NULL AND h BETWEEN 0 AND 30 AND a BETWEEN 0 AND 30 AND regexp_matches(home, '\\p{{L}}') AND regexp_matches(away, '\\p{{L}}'), false) AS ok FROM t)
"""

_MONTHS = {"janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
           "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
_ZONES = {"z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "jst": 540, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "pst": -480, "pdt": -420}
P6 = f"""
WITH x AS (
  SELECT DISTINCT 'date_str' AS field, match_id AS rec, date_str AS raw, tz FROM matches m LEFT JOIN leagues l ON m.league = l.league
  UNION SELECT DISTINCT 'commence_time', event_id, commence_time, tz FROM api_events a LEFT JOIN leagues l ON a.sport_key = l.sport_key
  UNION SELECT DISTINCT 'commence_time', event_id, commence_time, tz FROM odds_archive a LEFT JOIN leagues l ON a.sport_key = l.sport_key
  UNION SELECT DISTINCT 'snapshot_ts', event_id, snapshot_ts, tz FROM odds_archive a LEFT JOIN leagues l ON a.sport_key = l.sport_key),
p AS (
  SELECT *, CASE
    WHEN regexp_full_match(raw, '\\d{{4}}-\\d\\d-\\d\\d[T ].*') THEN regexp_extract(raw, '^(\\d{{4}})-(\\d\\d)-(\\d\\d)[T ](\\d\\d):(\\d\\d):?(\\d\\d)?\\.?(\\d+)? ?(.*)$', ['y','m','d','h','i','s','f','z'])
    WHEN regexp_full_match(raw, '\\d{{8}}T\\d{{6}}Z') THEN regexp_extract(raw, '^(\\d{{4}})(\\d\\d)(\\d\\d)T(\\d\\d)(\\d\\d)(\\d\\d)(x)?(Z)$', ['y','m','d','h','i','s','f','z'])
    WHEN regexp_full_match(raw, '\\d\\d[/.]\\d\\d[/.]\\d+ .*') THEN regexp_extract(raw, '^(\\d\\d)[/.](\\d\\d)[/.](\\d+) (\\d\\d):(\\d\\d):?(\\d\\d)?(x)?(.*)$', ['d','m','y','h','i','s','f','z'])
    WHEN regexp_full_match(raw, '\\w+, \\d\\d \\w+ .*') THEN regexp_extract(raw, '^\\w+, (\\d\\d) (\\w+) (\\d{{4}}) (\\d\\d):(\\d\\d):(\\d\\d)(x)? (GMT)$', ['d','m','y','h','i','s','f','z'])
    WHEN regexp_full_match(raw, '\\d+ \\D+ \\d{{4}} .*') THEN regexp_extract(raw, '^(\\d+) (\\D+) (\\d{{4}}) (\\d+)h(\\d\\d)(x)?(x)?(x)?$', ['d','m','y','h','i','s','f','z'])
    WHEN regexp_full_match(raw, '[A-Z][a-z]+ \\d+, .*') THEN regexp_extract(raw, '^(\\w+) (\\d+), (\\d{{4}}) (\\d+):(\\d\\d)(x)?(x)? ([AP]M)$', ['m','d','y','h','i','s','f','z']) END AS q FROM x WHERE raw IS NOT NULL),
r AS (
  SELECT *, MAP {_MONTHS} AS months, MAP {_ZONES} AS zones, TRY_CAST(q.y AS INT) + CASE WHEN length(q.y) = 2 THEN 2000 ELSE 0 END AS yy, coalesce(TRY_CAST(q.m AS INT), months[lower(q.m)]) AS mm,
    TRY_CAST(q.h AS INT) % (CASE WHEN q.z IN ('AM', 'PM') THEN 12 ELSE 24 END) + CASE WHEN q.z = 'PM' THEN 12 ELSE 0 END AS hh, CASE WHEN q.z IN ('AM', 'PM', '') THEN NULL ELSE lower(q.z) END AS zz FROM p),
s AS (
  SELECT *, CASE WHEN q IS NOT NULL THEN make_timestamp(yy, mm, TRY_CAST(q.d AS INT), hh, TRY_CAST(q.i AS INT), coalesce(TRY_CAST(q.s AS INT), 0) + coalesce(TRY_CAST('0.' || q.f AS DOUBLE), 0)) END AS wall,
    CASE WHEN zz IS NULL THEN NULL WHEN regexp_matches(zz, '^[+-]') THEN (CASE WHEN zz LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(zz, 2, 2) AS INT) * 60 + CAST(right(zz, 2) AS INT)) ELSE zones[zz] END AS off FROM r)"""
P6, _P6_PARTS = P6 + f"""
SELECT field, rec, raw, CAST(CASE WHEN regexp_full_match(raw, '\\d{{10}}') THEN CAST(raw AS BIGINT) * 1000 WHEN regexp_full_match(raw, '\\d{{13}}') THEN CAST(raw AS BIGINT)
    WHEN regexp_full_match(raw, '\\d{{10}}\\.\\d{{3}}') THEN CAST(CAST(raw AS DECIMAL(18, 3)) * 1000 AS BIGINT)
    WHEN off IS NOT NULL THEN epoch_us(wall) // 1000 - off * 60000 -- an hour that occurs twice: its first pass
    ELSE epoch_us(CASE WHEN timezone(tz, timezone(tz, wall) - INTERVAL 1 HOUR) = wall THEN timezone(tz, wall) - INTERVAL 1 HOUR ELSE timezone(tz, wall) END) // 1000 END AS BIGINT) AS utc_ms
FROM s WHERE NOT regexp_full_match(raw, '\\d{{4}}-\\d\\d-\\d\\d|\\d\\d/\\d\\d/\\d+')""", P6

_P3 = """
WITH v AS (
  SELECT DISTINCT match_id, date, home, away, CAST(fthg AS BIGINT) AS f, CAST(ftag AS BIGINT) AS a, recorded_at
  FROM matches WHERE fthg IS NOT NULL AND ftag IS NOT NULL),
w AS (
  SELECT match_id, date, home AS club, f, a, recorded_at FROM v
  UNION SELECT match_id, date, away, f, a, recorded_at FROM v),
e AS (
  SELECT DISTINCT match_id, date, 'home' AS side, home AS club FROM matches
  UNION SELECT DISTINCT match_id, date, 'away', away FROM matches),
r AS (
  SELECT e.match_id, e.side, w.match_id AS prior_id, w.f AS prior_fthg, w.a AS prior_ftag,
         row_number() OVER (PARTITION BY e.match_id, e.side
                            ORDER BY w.date DESC, w.match_id DESC, w.recorded_at DESC, w.f DESC, w.a DESC) AS n
  FROM e JOIN w ON e.club = w.club AND w.date < e.date AND epoch_us(w.recorded_at) < epoch_us(CAST(e.date AS TIMESTAMP)))
SELECT match_id, side, prior_id, prior_fthg, prior_ftag FROM r WHERE n = 1"""

_P6_STATUS = _P6_PARTS + """, w AS (SELECT *, timezone(tz, wall) AS u FROM s WHERE raw IS NOT NULL)
SELECT field, CASE WHEN regexp_full_match(raw, '\\d{4}-\\d\\d-\\d\\d|\\d\\d/\\d\\d/\\d+') THEN 'day_only' WHEN q IS NULL OR off IS NOT NULL THEN 'instant' WHEN timezone(tz, u) <> wall THEN 'nonexistent'
    WHEN timezone(tz, u - INTERVAL 1 HOUR) = wall OR timezone(tz, u + INTERVAL 1 HOUR) = wall THEN 'ambiguous' ELSE 'direct' END AS time_status, count(*) AS n
FROM w GROUP BY ALL"""
ORACLE = {
    "p6_status": _P6_STATUS,
    "p2_found": _P2 + "SELECT source_file, line_no FROM c WHERE NOT ok",
    "p2_valid": _P2 + "SELECT source_file, line_no, CAST(day AS DATE) AS match_date, home, away, h AS fthg, a AS ftag FROM c WHERE ok",
    "p3_found": _P3,
    "p6_found": P6,
}
