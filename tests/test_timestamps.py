"""Problem 7: readings, and the Viterbi chain over ranges."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomspan.functions.timestamps import readings, utc_text
from loomspan.operators import chain
from loomspan.operators.timestamps import p7_found

CASES = [
    ("2021-11-07T01:30:00", "America/New_York", "MDY", "2021-11-07T05:30:00Z"),  # twice: the first
    ("2021-03-14 02:30:00", "America/New_York", "MDY", "2021-03-14T07:30:00Z"),  # skipped: an hour on
    ("05/12/2018 02:21:15 AM", "America/Los_Angeles", "MDY", "2018-05-12T09:21:15Z"),
    ("05/12/2018", None, "DMY", "2018-12-05T00:00:00Z"),
    ("25.06.2020 03:38:13", "Europe/Berlin", "DMY", "2020-06-25T01:38:13Z"),
    (" 2020-10-19t12:39:43z\n", "Asia/Tokyo", "DMY", "2020-10-19T12:39:43Z"),
    ("2021-05-31T23:20:28,149+10:00", None, None, "2021-05-31T13:20:28Z"),
    ("2020-11-14T02:31:10+00", None, None, "2020-11-14T02:31:10Z"),
    ("Sat, 11 Sep 2021 21:46:57 +0200", None, None, "2021-09-11T19:46:57Z"),
    ("Sun, 01 Nov 2020 00:00:00 GMT", None, None, "2020-11-01T00:00:00Z"),
    ("2018-12-04 21:05:31 EST", None, None, "2018-12-05T02:05:31Z"),
    ("2018-05-11T06:22:00 Australia/Sydney", None, None, "2018-05-10T20:22:00Z"),
    ("2019-01-15T19:30:00[Asia/Kolkata]", None, None, "2019-01-15T14:00:00Z"),
    ("August 14, 2021 9:31:17 AM", "UTC", None, "2021-08-14T09:31:17Z"),
    ("8 April 2018", "Asia/Tokyo", None, "2018-04-08T00:00:00Z"),
    ("1572768392", None, None, "2019-11-03T08:06:32Z"),
    ("1577517720328", None, None, "2019-12-28T07:22:00Z"),
    ("20210521", "Asia/Tokyo", None, "2021-05-21T00:00:00Z"),
    ("20200428T000000Z", None, None, "2020-04-28T00:00:00Z"),
    ("2019-07-30T18:56:57.551682573Z", None, None, "2019-07-30T18:56:57Z"),
    ("2021-11-30 02:49", "No/Such_Zone", None, "2021-11-30T02:49:00Z"),
]
NONE = ["", "  ", None, "soon", "2024", "2024-03", "2023-Q3", "25:61", "2025-02-30", "0000-00-00", "31/31/2020", "2020-01-01T25:00:00Z", "2020-01-01T10:00:61Z", "last spring", "x" * 20_000]


def test_spellings(spark):
    df = spark.createDataFrame(CASES, "v string, zone string, o string, expected string")
    got = df.select("v", "expected", utc_text(readings(F.col("v"), F.col("zone"), F.col("o"))[0]["utc"]).alias("utc")).collect()
    assert [(r.v, r.utc) for r in got] == [(r.v, r.expected) for r in got]


def test_unreadable(spark):
    df = spark.createDataFrame([(v,) for v in NONE], "v string")
    assert df.filter(F.size(readings(F.col("v"), F.lit(None), F.lit(None))) > 0).collect() == []


def test_end_of_day_and_both_orders(spark):
    df = spark.createDataFrame([("03/04/2020",)], "v string")
    r = df.select(readings(F.col("v"), F.lit(None), F.lit(None), True).alias("r")).first().r
    assert [(x.spelling, str(x.utc)) for x in r] == [("DMY", "2020-04-03 23:59:59"), ("MDY", "2020-03-04 23:59:59")]


@pytest.mark.parametrize("zone", ["Europe/London", "Australia/Sydney", "America/New_York"])
def test_zones_against_zoneinfo(spark, zone):
    rng = random.Random(3)
    start = datetime(2018, 1, 1)
    local = [start + timedelta(seconds=rng.randrange(6 * 365 * 86400)) for _ in range(400)]
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M:%S"),) for t in local], "v string")
    got = [r.u for r in df.select(utc_text(readings(F.col("v"), F.lit(zone), F.lit(None))[0]["utc"]).alias("u")).collect()]
    expected = []
    for t in local:
        u = t.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(UTC)
        expected.append(u.strftime("%Y-%m-%dT%H:%M:%SZ"))
    assert got == expected


def brute(rows):
    """Least cost over all paths, from the same costs."""
    best = None
    states = chain.states(rows)

    def go(i, last, cost, path):
        nonlocal best
        if i == len(rows):
            best = min(best, (cost, path)) if best else (cost, path)
            return
        for s, at in rows[i]:
            order = s if s in chain.SLASH_ORDERS else (last[2] if last else "")
            b = (s, at, order)
            go(i + 1, b, cost + (chain.step(last, b) if last else 0), [*path, (s, at)])

    assert states
    go(0, None, 0.0, [])
    return best


def test_chain_over_ranges(spark):
    rng = random.Random(8)
    day = 86_400 * 1_000_000
    data, expected = [], {}
    for source, size in (("a", 11), ("b", 9), ("c", 1)):
        rows = []
        for _ in range(size):
            if rng.random() < 0.6:
                d, m = rng.randint(1, 12), rng.randint(1, 12)
                rows.append([("DMY", m * 30 * day + d * day), ("MDY", d * 30 * day + m * day)])
            else:
                rows.append([("iso", rng.randint(30, 390) * day)])
        expected[source] = brute(rows)[0]
        data += [(f"{source}{i:02d}", source, f"{i:03d}", [(s, datetime(1970, 1, 1) + timedelta(microseconds=at)) for s, at in row]) for i, row in enumerate(rows)]
    df = spark.createDataFrame(data, "row_key string, source string, at string, readings array<struct<spelling:string,utc:timestamp_ntz>>")
    got = {r.row_key: r for r in chain.resolve(df).collect()}
    assert len(got) == len(data)
    for source in "abc":
        last, cost = None, 0.0
        for k, _, _, _ in (x for x in data if x[1] == source):
            s, at = got[k].spelling, int((got[k].utc - datetime(1970, 1, 1)).total_seconds() * 1e6)
            b = (s, at, s if s in chain.SLASH_ORDERS else (last[2] if last else ""))
            cost += chain.step(last, b) if last else 0
            last = b
        assert cost == expected[source], source


def test_query(spark, sf):
    df = p7_found(spark, sf)
    assert df.columns == ["record_table", "record_id", "field_name", "utc"]
    assert df.count() == df.distinct().count() > 300
    assert df.filter(~F.col("utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).count() == 0


def utc_of(spark, rows):
    """{record_id: utc} of (record_id, value, source, at, home_zone, date_order)."""
    from loomspan.operators.timestamps import normalise

    df = spark.createDataFrame(rows, "record_id string, value string, source string, at string, home_zone string, date_order string")
    out = normalise(df.withColumn("end_of_day", F.lit(False)), len(rows))
    return {r.record_id: r.u for r in out.select("record_id", utc_text(F.col("utc")).alias("u")).collect()}


def test_the_chain_decides_what_no_rule_does(spark):
    around = [("a", "2021-02-01", "s", "1", None, None), ("c", "2021-03-20", "s", "3", None, None)]
    # by the order of the records 03/02 is the second of March, against the first reading's third of February
    assert utc_of(spark, [("a", "2021-02-20", "s", "1", None, None), ("b", "03/02/2021", "s", "2", None, None), around[1]])["b"] == "2021-03-02T00:00:00Z"
    assert utc_of(spark, [around[0], ("b", "03/02/2021", "s", "2", None, None), ("c", "2021-02-20", "s", "3", None, None)])["b"] == "2021-02-03T00:00:00Z"
    # a later date that is month first in any case carries its order back to those that leave it open
    rows = [("x", "05/06/2020", "s", "1", None, None), ("y", "07/08/2020", "s", "2", None, None), ("z", "12/25/2020", "s", "3", None, None)]
    assert utc_of(spark, rows) == {"x": "2020-05-06T00:00:00Z", "y": "2020-07-08T00:00:00Z", "z": "2020-12-25T00:00:00Z"}


def test_rules_outweigh_the_chain(spark):
    rows = [("a", "2021-02-20", "s", "1", None, "DMY"), ("b", "03/02/2021", "s", "2", None, "DMY"), ("c", "2021-03-20", "s", "3", None, "DMY")]
    assert utc_of(spark, rows)["b"] == "2021-02-03T00:00:00Z"
    # a month of 25 is impossible where the day comes first
    assert utc_of(spark, [("a", "12/25/2020", "s", "1", None, "DMY")]) == {}


def test_all_readings(spark):
    def all_of(value, zone=None, order=None):
        df = spark.createDataFrame([(value, zone, order)], "v string, zone string, o string")
        return [(str(r.utc), r.prior) for r in df.select(readings(F.col("v"), F.col("zone"), F.col("o")).alias("r")).first().r]

    assert all_of("2021-11-07T01:30:00", "America/New_York") == [("2021-11-07 05:30:00", 0.0), ("2021-11-07 06:30:00", 5.0)]
    assert all_of("2020-01-02 10:00:00 IST") == [("2020-01-02 04:30:00", 0.0), ("2020-01-02 08:00:00", 5.0), ("2020-01-02 09:00:00", 5.0)]
    assert all_of("1572768392") == [("2019-11-03 08:06:32", 0.0), ("1970-01-19 04:52:48", 5.0)]
    assert all_of("02/03/2020", None, "MDY") == [("2020-02-03 00:00:00", 0.0), ("2020-03-02 00:00:00", 5.0)]


def test_a_hot_source_over_many_ranges(spark):
    rng = random.Random(2)
    rows, at = [], datetime(2015, 1, 1)
    for i in range(3000):
        at += timedelta(days=rng.random())
        spelled = at.strftime("%m/%d/%Y") if rng.random() < 0.7 else at.strftime("%Y-%m-%d")
        rows.append((f"{i:05d}", spelled, "hot", f"{i:05d}", None, None))
    got = utc_of(spark, rows)
    # month first throughout: one order without a step back
    assert all(got[r[0]] == (datetime.strptime(r[1], "%m/%d/%Y") if "/" in r[1] else datetime.strptime(r[1], "%Y-%m-%d")).strftime("%Y-%m-%dT00:00:00Z") for r in rows)
