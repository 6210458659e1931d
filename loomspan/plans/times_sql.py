"""SQL of problems 5 and 7: times in any spelling as UTC, then gaps and periods."""

from loomspan.functions.timestamps import MONTHS, ZONE_OFFSETS

_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
#: Pattern of each way to write a date, with the places of year, month and day; the last group is what follows.
_DATES = {
    "iso": (r"(?i)^(\d{4})-(\d{2})-(\d{2})(|[t ].*)$", "ymd"),
    "slashed": (r"(?i)^(\d{4})/(\d{2})/(\d{2})(|[t ].*)$", "ymd"),
    "compact": (r"(?i)^(\d{4})(\d{2})(\d{2})(|t?\d{6}.*)$", "ymd"),
    "day_first": (rf"(?i)^(?:[a-z]{{3,9}},? )?(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH}\.?,?[ -](\d{{4}})(|,? .*)$", "dmy"),
    "month_first": (rf"(?i)^(?:[a-z]{{3,9}},? )?{_MONTH}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(|,? .*)$", "mdy"),
    "dots": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(|,? .*)$", "dmy"),
    "slashes": (r"^(\d{1,2})/(\d{1,2})/(\d{4})(|,? .*)$", "dmy"),
}
_CLOCK = r"(?i)^(?:t|,? ?)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([ap])\.?m\b\.?)?(?: ?(z|[a-z]{2,5}|[+-]\d{2}(?::?\d{2})?)(?:\[[a-z_/+-]+\])?| ?\[?([a-z]+(?:/[a-z_+-]+)+|utc)\]?)?$"


def _part(place: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN regexp_extract(v, '{p}', {order.index(place) + 1})" for k, (p, order) in _DATES.items())
    return f"CASE kind {arms} END"


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{k}'" for k, (p, _) in _DATES.items()) + " END"
_REST = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(v, '{p}', 4)" for k, (p, _) in _DATES.items()) + " END"
_NAMED = f"CAST((instr('{MONTHS}', lower(left(mon, 3))) + 2) / 3 AS INTEGER)"
_OFFSETS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in ZONE_OFFSETS.items()) + "}"

#: Over `raw` (value, home_zone, date_order, end_of_day and further columns): `timed`, the same with utc, null if unreadable.
TIMED = f"""
a AS (SELECT *, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS v FROM raw),
b AS (SELECT *, {_KIND} AS kind FROM a),
c AS (SELECT *, {_part("y")} AS y, {_part("m")} AS mon, {_part("d")} AS d,
  CASE WHEN kind = 'compact' THEN regexp_replace({_REST}, '^[Tt]?(\\d\\d)(\\d\\d)(\\d\\d)', ' \\1:\\2:\\3') ELSE {_REST} END AS rest FROM b),
e AS (SELECT *, kind = 'slashes' AND upper(trim(coalesce(date_order, ''))) = 'MDY' AS turned,
  CASE WHEN rest <> '' AND regexp_matches(rest, '{_CLOCK}') THEN regexp_extract(rest, '{_CLOCK}', ['h', 'mi', 's', 'half', 'zone', 'place']) END AS k FROM c),
f AS (SELECT *, printf('%04d-%02d-%02d', CAST(y AS INTEGER),
    CASE WHEN turned THEN CAST(d AS INTEGER) WHEN regexp_matches(mon, '^\\d+$') THEN CAST(mon AS INTEGER) ELSE {_NAMED} END,
    CASE WHEN turned THEN CAST(mon AS INTEGER) ELSE CAST(d AS INTEGER) END) AS day,
  CASE WHEN k.half = '' THEN CAST(k.h AS INTEGER) WHEN CAST(k.h AS INTEGER) BETWEEN 1 AND 12 THEN CAST(k.h AS INTEGER) % 12 + CASE WHEN lower(k.half) = 'p' THEN 12 ELSE 0 END END AS hour,
  CASE WHEN k.place <> '' THEN k.place ELSE k.zone END AS z FROM e),
g AS (SELECT *, CASE WHEN k IS NOT NULL THEN try_strptime(printf('%s %02d:%02d:%02d', day, hour, CAST(k.mi AS INTEGER), CASE WHEN k.s = '' THEN 0 ELSE CAST(k.s AS INTEGER) END), '%Y-%m-%d %H:%M:%S') END AS clock,
  CASE WHEN z = '' THEN coalesce(nullif(trim(home_zone), ''), 'UTC') WHEN contains(z, '/') THEN z END AS place FROM f),
h AS (SELECT *, CASE WHEN place IS NOT NULL THEN timezone('UTC', timezone(place, clock)) END AS at_place FROM g),
timed AS (SELECT * EXCLUDE (v, kind, y, mon, d, rest, turned, k, day, hour, z, clock, place, at_place),
  CASE WHEN regexp_matches(v, '^[+-]?\\d{{9,14}}(\\.\\d+)?$') THEN make_timestamp(1000000 * CAST(CASE WHEN abs(CAST(split_part(v, '.', 1) AS BIGINT)) >= 100000000000 THEN floor(CAST(split_part(v, '.', 1) AS BIGINT) / 1000) ELSE CAST(split_part(v, '.', 1) AS BIGINT) END AS BIGINT))
    WHEN rest = '' THEN try_strptime(day, '%Y-%m-%d') + to_seconds(CASE WHEN end_of_day THEN 86399 ELSE 0 END)
    WHEN place IS NOT NULL THEN CASE WHEN timezone(place, timezone('UTC', at_place - INTERVAL 1 HOUR)) = clock THEN at_place - INTERVAL 1 HOUR ELSE at_place END
    WHEN regexp_matches(z, '^[+-]') THEN clock - to_minutes((CASE WHEN left(z, 1) = '-' THEN -1 ELSE 1 END) * (CAST(z[2:3] AS INTEGER) * 60 + coalesce(TRY_CAST(right(replace(z, ':', ''), 2) AS INTEGER) * CAST(length(z) > 3 AS INTEGER), 0)))
    ELSE clock - to_minutes({_OFFSETS}[upper(z)]) END AS utc FROM h)
"""

_HOMES = "SELECT trim({0}) AS home_key, min(home_zone) AS home_zone, min(date_order) AS date_order FROM {1} GROUP BY 1"

P7_FOUND_SQL = f"""
WITH homes AS ({_HOMES.format("adapter_name", "adapters")}), desks AS ({_HOMES.format("agent", "agents")}),
raw AS (
  SELECT 'triples' AS record_table, id AS record_id, 'valid_from' AS field_name, valid_from AS value, home_zone, date_order, false AS end_of_day FROM triples LEFT JOIN homes ON trim(adapter_name) = home_key
  UNION SELECT 'triples', id, 'valid_to', valid_to, home_zone, date_order, true FROM triples LEFT JOIN homes ON trim(adapter_name) = home_key
  UNION SELECT 'diary_entries', id, 'filed_at', filed_at, home_zone, date_order, false FROM diary_entries LEFT JOIN desks ON trim(agent) = home_key
), {TIMED}
SELECT DISTINCT record_table, record_id, field_name, strftime(utc, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM timed WHERE utc IS NOT NULL
"""

_PERIODS = f"""
WITH homes AS ({_HOMES.format("adapter_name", "adapters")}),
facts AS (SELECT DISTINCT id, translate(lower(regexp_replace(subject, '^\\s+|\\s+$', '', 'g')), ' ''’', '_') AS subject, predicate, valid_from, valid_to, home_zone, date_order FROM triples LEFT JOIN homes ON trim(adapter_name) = home_key),
raw AS (SELECT id, subject, predicate, valid_from, valid_to, valid_from AS value, home_zone, date_order, false AS end_of_day FROM facts WHERE subject <> ''
  UNION ALL SELECT id, subject, predicate, valid_from, valid_to, valid_to, home_zone, date_order, true FROM facts WHERE subject <> ''),
{TIMED},
spans AS (SELECT subject, predicate, max(utc) FILTER (NOT end_of_day) AS s,
    CASE WHEN regexp_matches(coalesce(valid_to, ''), '^\\s*$') THEN TIMESTAMP '9999-12-31 23:59:59' ELSE max(utc) FILTER (end_of_day) END AS e
  FROM timed GROUP BY id, subject, predicate, valid_from, valid_to),
whole AS (SELECT subject, predicate, date_trunc('second', s) AS s, date_trunc('second', e) AS e FROM spans WHERE date_trunc('second', e) > date_trunc('second', s)),
along AS (SELECT *, max(e) OVER (PARTITION BY subject, predicate ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM whole)
"""
_TEXT = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"

P5_FOUND_SQL = _PERIODS + f"SELECT subject, predicate, {_TEXT.format('before')} AS gap_from, {_TEXT.format('s')} AS gap_to FROM along WHERE s > before + INTERVAL 1 SECOND"
P5_PERIODS_SQL = (
    _PERIODS
    + f""", numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + INTERVAL 1 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY subject, predicate ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM along)
SELECT subject, predicate, {_TEXT.format('min(s)')} AS period_from, CASE WHEN max(e) < TIMESTAMP '9999-12-31 23:59:59' THEN {_TEXT.format('max(e)')} END AS period_to FROM numbered GROUP BY subject, predicate, n"""
)
