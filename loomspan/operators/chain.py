"""Choice among readings by a Viterbi path over each source's record order.

A path's cost is the sum of its readings' own costs and of what each reading
costs after the one before it: a switch of the slash date order that was last
in force, and a step back in time. Between rows that have several readings the
others are fixed, so a stretch of them acts on a path only by its first and
last instant and its first and last date order; the path is searched over the
rows that leave a choice, each with the stretch before it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import checkpointed, partitions

#: Costs between neighbouring records of a source.
SWITCH = 1.0
BACKWARD = 1.0
SLASH_ORDERS = ("DMY", "MDY")
#: Rows of a source's order that one task holds, about.
ROWS = 200_000
#: Costs are counted in whole numbers, so that sums are exact; below the unit, earlier readings are preferred on ties.
UNIT = 1 << 40

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_SWITCH, _BACKWARD = int(SWITCH * UNIT), int(BACKWARD * UNIT)

#: (instant in us or None, date order in force, number of the reading)
State = tuple
#: (first and last instant, first and last date order, 0 where there is none)
Stretch = tuple[int, int, int, int]


def step(a: tuple[str, int, str], b: tuple[str, int, str]) -> float:
    """Cost of reading `b` straight after `a`; each is (spelling, us, order in force)."""
    switch = SWITCH if a[2] and b[0] in SLASH_ORDERS and a[2] != b[0] else 0.0
    return switch + (BACKWARD if b[1] < a[1] else 0.0)


def states(rows: list[list[tuple[str, int]]]) -> list[list[tuple[str, int, str]]]:
    """Readings with the slash order in force, which readings of other spellings pass on."""
    out: list[list[tuple[str, int, str]]] = []
    before = {""}
    for row in rows:
        own = [(spelling, at, o) for spelling, at in row for o in ([spelling] if spelling in SLASH_ORDERS else sorted(before))]
        before = {s[2] for s in own}
        out.append(own)
    return out


class Segment:
    """Neighbouring rows of one source: its rows with a choice, each with the stretch before it."""

    def __init__(self, us: np.ndarray, order: np.ndarray, choices: list[int], readings: list[list[tuple[int, int, int]]]):
        """us and order of every row's first reading; at the rows `choices` all readings (us, order, cost)."""
        self.readings = readings
        marked = np.flatnonzero(order)
        marked = marked[~np.isin(marked, choices)]
        begin = np.array([0, *[c + 1 for c in choices]], np.int64)
        end = np.array([*choices, len(us)], np.int64)
        a, b = np.searchsorted(marked, begin), np.searchsorted(marked, end)
        orders = order.tolist()
        self.stretches: list[Stretch | None] = [
            (int(us[i]), int(us[j - 1]), orders[marked[x]] if x < y else 0, orders[marked[y - 1]] if x < y else 0) if i < j else None
            for i, j, x, y in zip(begin.tolist(), end.tolist(), a.tolist(), b.tolist())
        ]
        self.first = [(int(us[0]), orders[0], 0)] if self.stretches[0] else readings[0]

    def forward(self, start: dict[State, int], only: int | None = None) -> tuple[dict[State, int], list[dict[State, State]]]:
        """Least cost of each state at the end, and the best predecessor of each state at each row with a choice.

        only: the reading that the first row has, where it is one with a choice.
        """
        back: list[dict[State, State]] = []
        last = start
        for k, stretch in enumerate(self.stretches):
            here: dict[State, tuple[int, State]] = {}
            for s, c in last.items():
                t = s
                if stretch:
                    if s[0] is not None and stretch[0] < s[0]:
                        c += _BACKWARD
                    if s[1] and stretch[2] and s[1] != stretch[2]:
                        c += _SWITCH
                    t = (stretch[1], stretch[3] or s[1], -1)
                if t not in here or (c, s) < here[t]:
                    here[t] = (c, s)
            if k == len(self.readings):
                back.append({t: s for t, (_, s) in here.items()})
                return {t: c for t, (c, _) in here.items()}, back
            after: dict[State, tuple[int, State]] = {}
            for i, (us, order, own) in enumerate(self.readings[k]):
                if k == 0 and only is not None and i != only:
                    continue
                for t, (c, s) in here.items():
                    c += own + i
                    if t[0] is not None and us < t[0]:
                        c += _BACKWARD
                    if t[1] and order and t[1] != order:
                        c += _SWITCH
                    n = (us, order or t[1], i)
                    if n not in after or (c, s) < after[n]:
                        after[n] = (c, s)
            back.append({n: s for n, (_, s) in after.items()})
            last = {n: c for n, (c, _) in after.items()}
        raise AssertionError

    def chosen(self, start: State | None, end: State | None) -> list[int]:
        """The reading of each row with a choice, on the best path between two states."""
        costs, back = self.forward({start or (None, 0, -1): 0})
        state = end if end in costs else min(costs, key=lambda s: (costs[s], s))
        out = []
        for link in reversed(back):
            state = link[state]
            out.append(state[2])
        return out[::-1][1:]

    def transfer(self) -> list[tuple[int, int, State, int]]:
        """(first row's reading, date order before it, state at the end, least cost)."""
        free = not self.stretches[0]
        return [(i, o, end, c) for i in range(len(self.first)) for o in (0, 1, 2) for end, c in self.forward({(None, o, -1): 0}, i if free else None)[0].items()]


def _sources(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole sources, and where each source begins; at most a range's rows are held."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        source = pdf["source"].to_numpy()
        cuts = np.flatnonzero(source[1:] != source[:-1]) + 1
        if held and held[0]["source"].iat[-1] != source[0]:
            cuts = np.concatenate([[0], cuts])
        if len(cuts):
            whole = pd.concat([*held, pdf.iloc[: cuts[-1]]], ignore_index=True)
            yield whole, _begins(whole)
            held = []
            pdf = pdf.iloc[cuts[-1] :]
        held.append(pdf)
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, _begins(whole)


def _begins(pdf: pd.DataFrame) -> np.ndarray:
    source = pdf["source"].to_numpy()
    return np.concatenate([[0], np.flatnonzero(source[1:] != source[:-1]) + 1]) if len(source) else np.zeros(0, np.int64)


def _segment(us: np.ndarray, order: np.ndarray, many: np.ndarray, choices: np.ndarray) -> Segment:
    readings = [[(int(r["us"]), int(r["order"]), int(r["prior"] * UNIT)) for r in row] for row in many[choices]]
    return Segment(us, order, choices.tolist(), readings)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    many = pdf["many"]
    return pdf["us"].to_numpy(np.int64), pdf["order"].to_numpy(np.int64), many.to_numpy(), many.notna().to_numpy()


def resolve(df: DataFrame, rows: int | None = None, readings: Column | None = None) -> DataFrame:
    """One reading of each row of (source, at, readings, further columns).

    Gives the further columns with `spelling`, `utc` and `prior` of the chosen
    reading. `readings` is an array<struct<spelling, utc[, prior]>>, the more
    usual first; prior is the reading's own cost, 0 where there is none. `at`,
    then the further columns, give a source's record order. rows: a bound on
    the rows of df, where it is known; more ranges are made, the more there are.
    readings: an expression over df, worked out once the rows lie in order,
    instead of a column.

    Rows lie in ranges of their order of about ROWS rows, so a source of any
    share of the rows is spread over many tasks. Each range gives its costs
    from every state before it to every state at its end; these summaries, two
    a range at most, are joined on the driver, and a second pass walks back
    inside each range. No readings mean no row. Null sources are one source, ''.
    """
    spark = df.sparkSession
    keys = [c for c in df.columns if c not in ("source", "at", "readings")]
    known = spark.sparkContext.defaultParallelism * ROWS if rows is None else rows
    n = max(partitions(spark), -(-known // ROWS))
    own = [] if readings is not None else ["readings"]
    placed = df.select(*keys, F.coalesce("source", F.lit("")).alias("source"), "at", *own)
    ordered = placed.repartitionByRange(n, "source", "at", *keys).sortWithinPartitions("source", "at", *keys)
    if readings is not None:
        ordered = ordered.withColumn("readings", readings)
    has_prior = any(f.name == "prior" for f in ordered.schema["readings"].dataType.elementType.fields)
    one = lambda r: F.struct(
        r["spelling"].alias("spelling"),
        F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), r["utc"]).alias("us"),
        (F.coalesce(F.array_position(F.array(*map(F.lit, SLASH_ORDERS)), r["spelling"]), F.lit(0))).cast("int").alias("order"),
        (r["prior"].cast("double") if has_prior else F.lit(0.0)).alias("prior"),
    )
    # through a generator, which keeps the readings from being worked out once a use
    read = ordered.select(*keys, "source", F.explode(F.array(F.transform("readings", one))).alias("readings"))
    first = F.col("readings")[0]
    ranged = checkpointed(
        read.filter(F.size("readings") > 0).select(*keys, "source", F.spark_partition_id().alias("pid"), first["spelling"].alias("spelling"), first["us"].alias("us"), first["order"].alias("order"), first["prior"].alias("prior"), F.when(F.size("readings") > 1, F.col("readings")).alias("many"))
    )

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # only the sources at a range's two ends can go on in another; the last one seen may be that at its end
        first = last = None
        for pdf, begins in _sources(batches):
            if not len(begins):
                continue
            if first is None:
                first = pdf.iloc[: begins[1]] if len(begins) > 1 else pdf
                last = pdf.iloc[begins[-1] :] if len(begins) > 1 else None
            else:
                last = pdf.iloc[begins[-1] :]
        kept = []
        for pdf in (first, last):
            if pdf is not None:
                us, order, many, open_ = _arrays(pdf)
                s = _segment(us, order, many, np.flatnonzero(open_))
                kept.append((int(pdf["pid"].iat[0]), pdf["source"].iat[0], pickle.dumps((s.first, s.transfer()))))
        yield pd.DataFrame(kept, columns=["pid", "source", "summary"])

    summaries = [(r.source, r.pid, *pickle.loads(bytes(r.summary))) for r in ranged.select("source", "pid", "us", "order", "many").mapInPandas(edges, "pid int, source string, summary binary").collect()]
    shared = spark.sparkContext.broadcast(_stitch(sorted(summaries, key=lambda r: r[:2])))  # two sources a range at most
    taken = ["spelling", "us", "prior"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, begins in _sources(batches):
            us, order, many, open_ = _arrays(pdf)
            at = np.flatnonzero(open_)
            out = pdf[[*keys, *taken]]
            if len(at):
                own: list = []
                ends = np.append(begins[1:], len(pdf))
                source_of = np.searchsorted(begins, at, "right") - 1
                for k in np.unique(source_of):
                    x, y = begins[k], ends[k]
                    choices = at[np.searchsorted(at, x) : np.searchsorted(at, y)]
                    ways = shared.value.get((int(pdf["pid"].iat[0]), pdf["source"].iat[x]), (None, None))
                    chosen = _segment(us[x:y], order[x:y], many[x:y], choices - x).chosen(*ways)
                    own += [r[i] for r, i in zip(many[choices], chosen)]
                values = {c: out[c].to_numpy(copy=True) for c in taken}
                for c in taken:
                    values[c][at] = [r[c] for r in own]
                out = out.assign(**values)
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", spelling string, us long, prior double"
    found = ranged.mapInPandas(walk, schema)
    return found.select(*keys, "spelling", F.timestamp_add("MICROSECOND", F.col("us"), F.expr(_EPOCH)).alias("utc"), "prior")


def _stitch(summaries: list[tuple[str, int, list, list]]) -> dict[tuple[int, str], tuple[State | None, State]]:
    """(state before a range, state at its end) for each (pid, source), from rows (source, pid, first readings, transfer)."""
    out: dict[tuple[int, str], tuple[State | None, State]] = {}
    at = 0
    while at < len(summaries):
        source = summaries[at][0]
        last: dict[State, int] = {(None, 0, -1): 0}
        links: list[tuple[int, dict[State, State]]] = []
        while at < len(summaries) and summaries[at][0] == source:
            _, pid, first, transfer = summaries[at]
            here: dict[State, tuple[int, State]] = {}
            for i, order, end, cost in transfer:
                for s, c in last.items():
                    if s[1] == order:
                        c += cost + (_BACKWARD if s[0] is not None and first[i][0] < s[0] else 0)
                        if end not in here or (c, s) < here[end]:
                            here[end] = (c, s)
            links.append((pid, {e: s for e, (_, s) in here.items()}))
            last = {e: c for e, (c, _) in here.items()}
            at += 1
        state = min(last, key=lambda s: (last[s], s))
        for pid, link in reversed(links):
            before = link[state]
            out[(pid, source)] = (before if before[0] is not None else None, state)
            state = before
    return out
