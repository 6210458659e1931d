"""Pairs of names a few edits apart, by walking two tries at once.

Sorted names are a trie: a node is a run of names with the same beginning. Two
nodes of equal depth are met only if the band of the edit distances of their
beginnings holds a value within the bound, so beginnings that all names share
cost one step, and what is walked grows with the pairs that are near. Names
are read in blocks; each pair of blocks is a task's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import checkpointed

#: Names of a block, and pairs of nodes walked at a time at most.
BLOCK = 4_096
WALKED = 1 << 20
MOST_TASKS = 100_000
#: Marks of an ended name on either side; no character has them.
ENDED = (0x110000, 0x110001)


class Names:
    """The nodes of one depth, of sorted names."""

    def __init__(self, names: list[str], ended: int):
        self.size = np.array([len(x) for x in names], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.append(np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(0))
        self.ended, self.depth = ended, 0
        self.begin = np.zeros(1, np.int64)  # first name of each node
        self._new = np.zeros(len(names), bool)  # whether a name begins a node
        self._new[0] = True

    def at(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """The character of each name at a depth from 1 on."""
        if depth < 1:
            return np.full(len(rows), self.ended, np.uint32)
        there = self.size[rows] >= depth
        return np.where(there, self.flat[np.where(there, self.first[rows] + depth - 1, -1)], np.uint32(self.ended))

    def down(self) -> tuple[np.ndarray, np.ndarray]:
        """Go one deeper; (first child, number of children) of each node there was."""
        self.depth += 1
        char = self.at(np.arange(len(self.size)), self.depth)
        self._new[1:] |= char[1:] != char[:-1]
        old, self.begin = self.begin, np.flatnonzero(self._new)
        child = np.searchsorted(self.begin, old)
        return child, np.diff(np.append(child, len(self.begin)))

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """(first name, number of names) of each node."""
        return self.begin, np.diff(np.append(self.begin, len(self.size)))


def _each(u: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place in u, x): all that u has, given as first and number."""
    n = of[1][u]
    place = np.repeat(np.arange(len(u)), n)
    return place, np.arange(len(place)) + np.repeat(of[0][u] - (np.cumsum(n) - n), n)


def _crossed(u: np.ndarray, v: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in u and v, x, y): all pairs of what u has on the left, v on the right."""
    place, x = _each(u, left)
    again, y = _each(v[place], right)
    return place[again], x[again], y


def _matched(u: np.ndarray, v: np.ndarray, one: Names, two: Names, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in u and v, x, y): those pairs of children that have the same last character, or both end."""

    def key(parent: np.ndarray, names: Names, node: np.ndarray) -> np.ndarray:
        char = names.at(names.begin[node], names.depth).astype(np.int64)
        return (parent << 21) + np.where(char == names.ended, 0, char + 1)  # names that end come first

    keys = key(np.repeat(np.arange(len(right[0])), right[1]), two, np.arange(len(two.begin)))
    place, x = _each(u, left)
    wanted = key(v[place], one, x)
    y = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    same = keys[y] == wanted
    return place[same], x[same], y[same]


def near_pairs(a: list[str], b: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, edits): pairs at 1 to `most` edits of sorted names; both lists have one at least.

    band[most + d] is the distance of the first depth + min(d, 0) characters
    of a name of a and the first depth - max(d, 0) of one of b.
    """
    slices = max(1, WALKED // len(b))
    for low in range(0, len(a), slices):
        one, two = Names(a[low : low + slices], ENDED[0]), Names(b, ENDED[1])
        # lengths still to come differ by what the whole lengths do, at least
        least, greatest = one.size.min() - two.size.max(), one.size.max() - two.size.min()
        lack = np.array([max(least - d, d - greatest, 0) for d in range(-most, most + 1)]).clip(0, most + 1).astype(np.uint8)
        aside = np.arange(-most, most + 1) != 0
        u = v = np.zeros(1, np.int64)
        band = np.full((2 * most + 1, 1), most + 1, np.uint8)
        band[most] = 0
        while len(u):
            depth = one.depth
            # where only the middle of the band is within the bound, and has used it up, the next characters match
            tight = (band[most] == most) & (band + lack[:, None] > most)[aside].all(0)
            left, right, loose = one.down(), two.down(), ~tight
            parts = [(at[place], x, y) for at, (place, x, y) in ((np.flatnonzero(loose), _crossed(u[loose], v[loose], left, right)), (np.flatnonzero(tight), _matched(u[tight], v[tight], one, two, left, right)))]
            place, u, v = (np.concatenate(p) for p in zip(*parts))
            band = band[:, place]
            over = (one.at(one.begin, depth + 1) == ENDED[0])[u] & (two.at(two.begin, depth + 1) == ENDED[1])[v]
            if over.any():
                m, n = one.size[one.begin][u[over]], two.size[two.begin][v[over]]
                apart = np.abs(m - n)
                edits = np.where(apart <= most, band[np.clip(m - n, -most, most) + most, np.flatnonzero(over)], most + 1)
                met = (edits >= 1) & (edits <= most)
                place, x, y = _crossed(u[over][met], v[over][met], one.names(), two.names())
                if len(x):
                    yield x + low, y, edits[met][place].astype(np.int32)
                u, v, band = u[~over], v[~over], band[:, ~over]
            char_a = [one.at(one.begin, depth + 1 - d) for d in range(most + 1)]
            char_b = [two.at(two.begin, depth + 1 - d) for d in range(most + 1)]
            last_a, last_b = char_a[0][u], char_b[0][v]
            new = np.empty_like(band)
            for way in (1, -1):
                for d in range(most, 0, -1):
                    here = most + way * d
                    differ = last_a != char_b[d][v] if way == 1 else char_a[d][u] != last_b
                    cost = np.minimum(band[here] + differ, band[here - way] + np.uint8(1))
                    new[here] = cost if d == most else np.minimum(cost, new[here + way] + np.uint8(1))
            new[most] = np.minimum(band[most] + (last_a != last_b), np.minimum(new[most - 1], new[most + 1]) + np.uint8(1))
            band = np.minimum(new, np.uint8(most + 1))
            near = (band + lack[:, None] <= most).any(0)
            u, v, band = u[near], v[near], band[:, near]


def blocks_of(names: DataFrame) -> DataFrame:
    """(names, lower): blocks of at most BLOCK names each, in order of the lower-case ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while len(rest) >= BLOCK:
                yield packed(rest.slice(0, BLOCK))
                rest = rest.slice(BLOCK)
        if rest is not None and len(rest):
            yield packed(rest)

    def packed(t: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([t[c].to_pylist()], pa.list_(pa.string())) for c in ("name", "lower")})

    own = names.select("name", F.lower("name").alias("lower"))
    n = min(math.ceil(own.count() / BLOCK) or 1, math.isqrt(MOST_TASKS))
    return checkpointed(own.repartitionByRange(n, "lower").sortWithinPartitions("lower").mapInArrow(run, "name array<string>, lower array<string>"))


def near_names(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(name, other, distance): pairs of a name of `left` and one of `right` (name) at 1 to `most` edits, whatever the case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one, low, two, other = (batch.column(c)[k] for c in ("name_a", "lower_a", "name_b", "lower_b"))
                for x, y, edits in near_pairs(low.as_py(), other.as_py(), most):
                    for at in range(0, len(x), 1 << 16):
                        own = slice(at, at + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pc.take(one.values, x[own]), pc.take(two.values, y[own]), pa.array(edits[own])], ["name", "other", "distance"])

    # blocks are read from the checkpoint by each task that compares them
    one, two = (blocks_of(names).select(F.col("name").alias(f"name_{s}"), F.col("lower").alias(f"lower_{s}")) for names, s in ((left, "a"), (right, "b")))
    return one.crossJoin(two.hint("shuffle_replicate_nl")).mapInArrow(run, "name string, other string, distance int")
