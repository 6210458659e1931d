"""Every valid reading of a time spelling, as an array of UTC instants.

Everything here is Catalyst expressions over TIMESTAMP_NTZ, so that neither
the session's time zone nor Python plays a part.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by their first three letters.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Zone abbreviations and their usual offsets in minutes.
ZONE_OFFSETS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}

# Other offsets in minutes that some abbreviations also stand for.
OTHER_OFFSETS = {"BST": [360], "CST": [480, -300], "EST": [600], "IST": [120, 60], "MST": [390], "PST": [480]}
#: Own cost of a reading that a stated rule speaks against. A stretch of n values has n + 1 borders of at most
#: two units each (`operators.chain`), so no path gains by such a reading where another is there.
AGAINST = 5.0

_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_ZONE = r"(?: ?(z|[a-z]{2,5}|[+-]\d{2}(?::?\d{2})?)(?:\[[a-z_/+-]+\])?| ?\[?([a-z]+(?:/[a-z_+-]+)+|utc)\]?)?"
#: Pattern and the places of year, month, day, hour, minute, second, am/pm, zone in it.
_SPELLINGS = {
    "iso": (rf"(?i)^(\d{{4}})([-/])(\d{{2}})\2(\d{{2}})(?:[t ]{_CLOCK}{_ZONE})?$", "$1|$3|$4|$5|$6|$7||$8$9"),
    "compact": (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})(?:t?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,]\d+)?{_ZONE})?$", "$1|$2|$3|$4|$5|$6||$7$8"),
    "day_month_name": (rf"(?i)^(?:[a-z]{{3,9}},? )?(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH},?[ -](\d{{4}})(?:,? {_CLOCK}(?: ?([ap])\.?m\b\.?)?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8$9"),
    "month_name_day": (rf"(?i)^(?:[a-z]{{3,9}},? )?{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? {_CLOCK}(?: ?([ap])\.?m\b\.?)?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8$9"),
    "dots": (rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_CLOCK}(?: ?([ap])\.?m\b\.?)?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8$9"),
}
_SLASHES = rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_CLOCK}(?: ?([ap])\.?m\b\.?)?{_ZONE})?$"
_SLASH_ORDERS = {"DMY": "$3|$2|$1|$4|$5|$6|$7|$8$9", "MDY": "$3|$1|$2|$4|$5|$6|$7|$8$9"}
_EPOCH = r"^[+-]?\d{9,14}(?:\.\d+)?$"
_START = "timestamp_ntz'1970-01-01 00:00:00'"


def squeezed(value: Column) -> Column:
    """Without white space at the ends, runs of it inside as one space."""
    return F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), r"^ | $", "")


def known_zones() -> list[str]:
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z)


def _is_known(zone: Column) -> Column:
    # one literal, split once by constant folding
    return F.array_contains(F.split(F.lit(" ".join(known_zones())), " "), zone)


def _offsets(table: dict[str, int | list[int]], zone: Column) -> Column:
    """Offsets in minutes of an abbreviation, the most usual first; null for others."""
    text = ";".join(f"{k}={','.join(map(str, v if isinstance(v, list) else [v]))}" for k, v in table.items())
    return F.split(F.str_to_map(F.lit(text), F.lit(";"), F.lit("="))[F.upper(zone)], ",").cast("array<int>")


def _clock(parts: Column, order: Column, end_of_day: Column | bool) -> Column:
    """struct<spelling, prior, day, clock, zone> of nine text parts: a date alone has a day, any other a local clock."""
    number = lambda i: parts[i].try_cast("int")
    name = F.lower(F.substring(parts[1], 1, 3))
    month = F.when(parts[1].rlike(r"^\d+$"), number(1)).otherwise(((F.instr(F.lit(MONTHS), name) + 2) / 3).cast("int"))
    half = F.lower(parts[6])
    hour = F.when(half == "", number(3)).when(number(3).between(1, 12), number(3) % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.when(parts[5] == "", F.lit(0)).otherwise(number(5))
    day = F.timestamp_add("SECOND", F.when(F.lit(end_of_day) if isinstance(end_of_day, bool) else end_of_day, 86_399).otherwise(0), F.try_make_timestamp_ntz(number(0), month, number(2), F.lit(0), F.lit(0), F.lit(0)))
    clock = F.when(second < 60, F.try_make_timestamp_ntz(number(0), month, number(2), hour, number(4), second))
    dated = parts[3] == ""
    contrary = order.isin(*_SLASH_ORDERS) & parts[8].isin(*_SLASH_ORDERS) & (parts[8] != order)
    return F.struct(
        parts[8].alias("spelling"), F.when(contrary, AGAINST).otherwise(0.0).alias("prior"), F.when(dated, day).alias("day"), F.when(~dated, clock).alias("clock"), parts[7].alias("zone")
    )


def _instants(c: Column, home: Column) -> Column:
    """array<struct<spelling, utc, prior>>: the usual instant first, then the others that the zone leaves open.

    A local time that occurs twice has two instants; an abbreviation has those
    of its other offsets. One that a clock change skips is moved forward.
    """
    zone = c["zone"]
    local = (zone == "") | zone.contains("/")
    place = F.when(zone == "", F.when(_is_known(home), home).otherwise("UTC")).when(_is_known(zone), zone)
    one = lambda utc, more: F.struct(c["spelling"].alias("spelling"), utc.alias("utc"), (c["prior"] + more).alias("prior"))
    none = F.array().cast("array<struct<spelling:string,utc:timestamp_ntz,prior:double>>")
    # by the zone's rules: the first instant, and the same clock an hour later
    first = F.array(F.convert_timezone(place, F.lit("UTC"), c["clock"]))
    again = lambda u: F.convert_timezone(F.lit("UTC"), place, F.timestamp_add("HOUR", F.lit(1), u)) == c["clock"]
    by_place = F.flatten(F.transform(first, lambda u: F.when(again(u), F.array(one(u, 0.0), one(F.timestamp_add("HOUR", F.lit(1), u), AGAINST))).otherwise(F.array(one(u, 0.0)))))
    digits = F.regexp_replace(F.substring(zone, 2, 9), ":", "")
    numeric = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))) * F.when(zone.startswith("-"), -1).otherwise(1)
    less = lambda minutes: F.timestamp_add("MINUTE", -minutes, c["clock"])
    by_name = F.concat(F.array(one(less(_offsets(ZONE_OFFSETS, zone)[0]), 0.0)), F.coalesce(F.transform(_offsets(OTHER_OFFSETS, zone), lambda m: one(less(m), AGAINST)), none))
    return F.when(c["day"].isNotNull(), F.array(one(c["day"], 0.0))).when(c["clock"].isNull(), none).when(local, by_place).when(zone.rlike(r"^[+-]"), F.array(one(less(numeric), 0.0))).otherwise(by_name)


def readings(value: Column, home_zone: Column, date_order: Column, end_of_day: Column | bool = False) -> Column:
    """array<struct<spelling, utc, prior>> of every valid reading of a time spelling.

    Null, blank, impossible and vague values and those less exact than a day
    have an empty array. What a value leaves open is read in every way: three
    numbers parted by slashes, the year last, in both orders; a local time that
    occurs twice as both instants; an abbreviation of several zones by each;
    a plain number as seconds, as milliseconds and, with eight digits, as a
    date. A reading that a rule speaks against (a declared `date_order`, the
    first of two instants, an abbreviation's usual offset, the size of a
    number) has a prior of AGAINST, others of 0. A date alone is a UTC day's
    first second, or its last with `end_of_day`.
    """
    order = F.upper(F.trim(date_order))
    return F.transform(F.array(squeezed(value)), lambda v: _readings(v, home_zone, order, end_of_day))[0]


def _readings(v: Column, home_zone: Column, order: Column, end_of_day: Column | bool) -> Column:
    # a value fits one pattern at most; each way to read it is a text of nine parts
    texts = F.array().cast("array<string>")
    for spelling, (pattern, to) in reversed(list(_SPELLINGS.items())):
        texts = F.when(v.rlike(pattern), F.array(F.regexp_replace(v, pattern, f"{to}|{spelling}"))).otherwise(texts)
    slash = [F.regexp_replace(v, _SLASHES, f"{to}|{o}") for o, to in _SLASH_ORDERS.items()]
    texts = F.when(v.rlike(_SLASHES), F.when(order == "MDY", F.array(*slash[::-1])).otherwise(F.array(*slash))).otherwise(texts)
    clocks = F.transform(F.transform(texts, lambda t: F.split(t, r"\|")), lambda p: _clock(p, order, end_of_day))
    read = F.flatten(F.transform(clocks, lambda c: _instants(c, F.trim(home_zone))))
    whole = F.regexp_extract(v, r"^([+-]?\d+)", 1).try_cast("bigint")
    large = F.abs(whole) >= 100_000_000_000
    second = lambda s: F.when(s.between(-62_135_596_800, 253_402_300_799), F.timestamp_add("SECOND", s, F.expr(_START)))
    number = lambda utc, usual: F.struct(F.lit("epoch").alias("spelling"), utc.alias("utc"), F.when(usual, 0.0).otherwise(AGAINST).alias("prior"))
    by_second, by_milli = second(whole), second(F.floor(whole / 1000).cast("bigint"))
    epoch = F.when(large, F.array(number(by_milli, large), number(by_second, ~large))).otherwise(F.array(number(by_second, ~large), number(by_milli, large)))
    eight = F.concat(read, F.array(number(by_second, F.lit(False))))
    return F.filter(F.when(v.rlike(_EPOCH), epoch).when(v.rlike(r"^\d{8}$"), eight).otherwise(read), lambda c: c["utc"].isNotNull())


def utc_text(utc: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of a TIMESTAMP_NTZ in UTC."""
    return F.concat(F.translate(F.substring(utc.cast("string"), 1, 19), " ", "T"), F.lit("Z"))


def utc_seconds(utc: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr(_START), utc)
