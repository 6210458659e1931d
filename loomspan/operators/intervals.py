"""Problem 5: merged periods and gaps of intervals per entity, from run-compressed bitmaps.

Time is counted in whole seconds and cut into shards of 2**20 s. A bitmap holds
the set seconds of one key and one shard, run-compressed: pairs (first, length
less one) of 32-bit numbers in order. An interval sets bits in the bitmaps of
its first and its last shard; the shards that it covers between them are bits
of one more bitmap a key, whose unit is the shard. Bitmaps are made a batch at
a time before the shuffle, united for each key and shard, and read in order of
time: set runs are periods, clear runs between them gaps.

Whatever share of all intervals one key has, a bitmap has at most 2**19 runs,
and a key's bitmaps are read as a stream of which only the period at its end
is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.timestamps import utc_text
from loomspan.operators.timestamps import normalise, triple_values
from loomspan.tables import load

SHARD = 1 << 20
#: End of an interval without end, the last second of the year 9999.
FOREVER = 253_402_300_799
#: The shard of the first second of the year 1, from which whole shards are counted.
LEAST = -62_135_596_800 // SHARD


def entity_key(name: Column) -> Column:
    """Entity id of a name: trimmed, lower case, spaces as _, apostrophes dropped."""
    trimmed = F.regexp_replace(name, r"^\s+|\s+$", "")
    return F.translate(F.lower(trimmed), " '’", "_")


#: The shard that stands for a key's bitmap of whole shards.
WHOLE = -(1 << 40)


def united(group: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (group, s, e) of the union of the runs of each group; runs that touch are one. All ends are inclusive."""
    if not len(s):
        return group, s, e
    order = np.lexsort((s, group))
    group, s, e = group[order], s[order], e[order]
    # groups are set apart, so that one running maximum serves all
    low = int(s.min())
    apart = int(e.max()) - low + 3
    base = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) * apart - low
    a, b = s + base, np.maximum.accumulate(e + base)
    new = np.concatenate([[True], a[1:] > b[:-1] + 1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(s)]]) - 1
    return group[first], s[first], b[last] - base[first]


def packed(group: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A run-compressed bitmap of each group of united runs: the groups and the bitmaps' bytes."""
    if not len(group):
        return group, []
    pairs = np.column_stack([s, e - s]).astype("<u4")
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    raw = pairs.tobytes()
    ends = [*first[1:].tolist(), len(group)]
    return group[first], [raw[8 * i : 8 * j] for i, j in zip(first.tolist(), ends)]


def unpacked(bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the bitmap, s, e) of the set runs of bitmaps."""
    pairs = np.frombuffer(b"".join(bitmaps), "<u4").reshape(-1, 2).astype(np.int64)
    number = np.repeat(np.arange(len(bitmaps)), [len(b) // 8 for b in bitmaps])
    return number, pairs[:, 0], pairs[:, 0] + pairs[:, 1]


def _codes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """A number for each distinct key; nulls are keys of their own."""
    return pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()


def shard_bitmaps(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shard, bits): a bitmap for each key and shard of a batch of intervals.

    `intervals` has the keys and inclusive seconds s and e, s <= e. The shard
    WHOLE holds the shards that are wholly set.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            s, e = pdf["s"].to_numpy(np.int64), pdf["e"].to_numpy(np.int64)
            a, b = s // SHARD, e // SHARD
            one, row = a == b, np.arange(len(pdf))
            between = b > a + 1
            # whole first and last shards need no bit of the other bitmap: their runs touch
            number = np.concatenate([row, row[~one], row[between]])
            shard = np.concatenate([a, b[~one], np.full(between.sum(), WHOLE)])
            first = np.concatenate([s - a * SHARD, np.zeros((~one).sum(), np.int64), a[between] + 1 - LEAST])
            last = np.concatenate([np.where(one, e - a * SHARD, SHARD - 1), (e - b * SHARD)[~one], b[between] - 1 - LEAST])
            code = _codes(pdf, keys)[number]
            _, group = np.unique(np.column_stack([code, shard]), axis=0, return_inverse=True)
            group = group.ravel()
            some = np.zeros(group.max() + 1, np.int64)
            some[group] = np.arange(len(group))
            groups, bits = packed(*united(group, first, last))
            at = some[groups]
            yield pdf[keys].iloc[number[at]].assign(shard=shard[at], bits=bits)

    return intervals.select(*keys, "s", "e").mapInPandas(run, _schema(intervals, keys) + ", shard long, bits binary")


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def united_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shard, bits): one bitmap for each key and shard, and a row for each run of whole shards at its first shard.

    A run of whole shards is given as a bitmap of one run in the unit of
    shards, marked by `whole`.
    """
    placed = bitmaps.repartition(*keys, "shard").sortWithinPartitions(*keys, "shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the bitmap so far of the last key and shard
        for pdf in batches:
            if not len(pdf):
                continue
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            code = _codes(rows, [*keys, "shard"])
            some = np.zeros(code.max() + 1, np.int64)
            some[code] = np.arange(len(code))
            number, s, e = unpacked(rows["bits"].tolist())
            groups, bits = packed(*united(code[number], s, e))
            one = rows[[*keys, "shard"]].iloc[some[groups]].assign(bits=bits)
            held = one.iloc[-1:]
            yield done(one.iloc[:-1])
        if held is not None:
            yield done(held)

    def done(one: pd.DataFrame) -> pd.DataFrame:
        whole = (one["shard"] == WHOLE).to_numpy()
        parts = one[~whole].assign(whole=False)
        number, s, e = unpacked(one["bits"][whole].tolist())
        _, runs = packed(np.arange(len(s)), s, e)
        runs = one[keys][whole].iloc[number].assign(shard=s + LEAST, whole=True, bits=runs)
        return pd.concat([parts, runs], ignore_index=True)[[*keys, "shard", "whole", "bits"]]

    return placed.mapInPandas(run, _schema(bitmaps, keys) + ", shard long, whole boolean, bits binary")


def set_runs(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, period_from, period_to, gap_to) in seconds: the set runs of each key, and where the next begins.

    gap_to is null after a key's last run. Runs that touch are one. Null keys
    are keys of their own. No intervals, no rows.
    """
    one = united_bitmaps(shard_bitmaps(intervals, keys), keys)
    # a run of whole shards comes before the bits of the shard that it begins with
    placed = one.repartition(*keys).sortWithinPartitions(*keys, "shard", F.desc("whole"))
    columns = [*keys, "period_from", "period_to", "gap_to"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the last run so far, of the last key; it may grow with the next batch
        held: pd.DataFrame | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            shard, whole = pdf["shard"].to_numpy(np.int64), pdf["whole"].to_numpy(bool)
            number, s, e = unpacked(pdf["bits"].tolist())
            at = whole[number]
            s, e = np.where(at, (s + LEAST) * SHARD, s + shard[number] * SHARD), np.where(at, (e + LEAST + 1) * SHARD - 1, e + shard[number] * SHARD)
            rows = pdf[keys].iloc[number].assign(period_from=s, period_to=e)
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            code = _codes(rows, keys)
            group, s, e = united(code, rows["period_from"].to_numpy(np.int64), rows["period_to"].to_numpy(np.int64))
            some = np.zeros(code.max() + 1, np.int64)
            some[code] = np.arange(len(code))
            runs = rows[keys].iloc[some[group]].assign(period_from=s, period_to=e)
            same = np.concatenate([group[1:] == group[:-1], [False]])
            runs["gap_to"] = pd.array(np.concatenate([s[1:], [0]]), "Int64")
            runs.loc[~same, "gap_to"] = pd.NA
            held = runs.iloc[-1:][[*keys, "period_from", "period_to"]]
            yield runs.iloc[:-1][columns]
        if held is not None:
            yield held.assign(gap_to=pd.array([None], "Int64"))[columns]

    return placed.mapInPandas(run, _schema(one, keys) + ", period_from long, period_to long, gap_to long")


def gaps(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap_from, gap_to) in seconds: clear runs between the set runs of each key.

    gap_from is the last set second before the gap, gap_to the first after it.
    Intervals that touch (start at most one second after an end) leave no gap.
    """
    return set_runs(intervals, keys).filter("gap_to is not null").select(*keys, F.col("period_to").alias("gap_from"), "gap_to")


def periods(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, period_from, period_to) in seconds: the merged periods, which are the set runs."""
    return set_runs(intervals, keys).drop("gap_to")


def fact_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, s, e) of the facts that count.

    Not those with a blank subject, a start that is null, blank or unreadable,
    an unreadable end, or an end that isn't after the start. A null or blank
    end is FOREVER. A null predicate is a predicate of its own.
    """
    facts = load(spark, sf_dir, "triples").select("*", entity_key(F.col("subject")).alias("subject_key"), F.col("valid_from").alias("from_value"), F.col("valid_to").alias("to_value")).filter("subject_key <> ''")
    row = ["subject_key", "predicate", "from_value", "to_value"]
    rows = 2 * load(spark, sf_dir, "triples").count()  # from the files' footers
    timed = normalise(triple_values(spark, sf_dir, facts, tuple(row)), rows)
    # both times of a fact: they come from one row, which its id and both values tell apart
    at = lambda field: F.max(F.when(F.col("field_name") == field, F.col("utc")))
    seconds = lambda c: F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(c))
    facts = timed.groupBy("record_id", *row).agg(at("valid_from").alias("s"), at("valid_to").alias("e"))
    without_end = F.coalesce(F.col("to_value"), F.lit("")).rlike(r"^\s*$")
    e = F.when(without_end, F.lit(FOREVER)).otherwise(seconds("e"))
    return facts.select(F.col("subject_key").alias("subject"), "predicate", seconds("s").alias("s"), e.alias("e")).filter("e > s")


def _text(second: str) -> Column:
    return utc_text(F.timestamp_add("SECOND", F.col(second), F.expr("timestamp_ntz'1970-01-01 00:00:00'")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, gap_from, gap_to): gaps between the merged periods."""
    found = gaps(fact_intervals(spark, sf_dir), ["subject", "predicate"])
    return found.select("subject", "predicate", _text("gap_from").alias("gap_from"), _text("gap_to").alias("gap_to"))


def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, period_from, period_to): merged periods; period_to is null without end."""
    found = periods(fact_intervals(spark, sf_dir), ["subject", "predicate"])
    return found.select("subject", "predicate", _text("period_from").alias("period_from"), F.when(F.col("period_to") < FOREVER, _text("period_to")).alias("period_to"))
