"""Problem 5: gaps and periods against a plain sweep."""

import random

from loomspan.operators import intervals as iv


def plain(rows):
    by = {}
    for k, p, s, e in rows:
        by.setdefault((k, p), []).append((s, e))
    gaps, periods = set(), set()
    for key, v in by.items():
        v.sort()
        start, end = v[0]
        for s, e in v[1:]:
            if s > end + 1:
                gaps.add((*key, end, s))
                periods.add((*key, start, end))
                start = s
            end = max(end, e)
        periods.add((*key, start, end))
    return gaps, periods


def check(spark, rows):
    df = spark.createDataFrame(rows, "subject string, predicate string, s long, e long")
    gaps, periods = plain(rows) if rows else (set(), set())
    assert {tuple(r) for r in iv.gaps(df, ["subject", "predicate"]).collect()} == gaps
    assert {tuple(r) for r in iv.periods(df, ["subject", "predicate"]).collect()} == periods


def test_random(spark):
    rng = random.Random(1)
    rows = []
    for k in range(30):
        for _ in range(rng.randint(1, 25)):
            s = rng.randrange(0, 40 * iv.SHARD)
            length = rng.choice([1, 5, 1000, iv.SHARD // 3, iv.SHARD, 5 * iv.SHARD])
            rows.append((f"s{k % 7}", None if k % 5 == 0 else f"p{k}", s, s + rng.randint(1, length)))
    rows += [("hot", "p", x * 10, x * 10 + 8) for x in range(3000)]  # touching by one second: one period
    rows += [("hot", "q", x * 10, x * 10 + 7) for x in range(3000)]
    rows += [("open", "p", 100, iv.FOREVER), ("open", "p", 50, 60)]
    check(spark, rows + rows[:40])


def test_edges(spark):
    check(spark, [])
    check(spark, [("a", "p", 1, 2)])
    check(spark, [("a", "p", 0, iv.SHARD - 1), ("a", "p", iv.SHARD, 2 * iv.SHARD - 1), ("a", "p", 2 * iv.SHARD + 1, 2 * iv.SHARD + 5)])
    # a run of whole shards hides the gaps inside one of them
    check(spark, [("a", "p", 10, 20), ("a", "p", 3 * iv.SHARD + 5, 3 * iv.SHARD + 9), ("a", "p", 3 * iv.SHARD + 50, 3 * iv.SHARD + 90), ("a", "p", iv.SHARD + 1, 6 * iv.SHARD)])


def test_query(spark, sf):
    rows = [tuple(r) for r in iv.fact_intervals(spark, sf).collect()]
    assert {tuple(r) for r in iv.gaps(iv.fact_intervals(spark, sf), ["subject", "predicate"]).collect()} == plain(rows)[0]
    found = iv.p5_found(spark, sf)
    assert found.columns == ["subject", "predicate", "gap_from", "gap_to"] and found.count() == found.distinct().count()


def test_hot_key_and_shard_over_many_batches(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40_000):
        s = rng.randrange(0, 3 * iv.SHARD) if i % 3 else rng.randrange(0, 4000) * 7
        rows.append(("hot" if i % 3 == 0 else f"k{i % 11}", "p", s, s + rng.choice([1, 3, 60, 2 * iv.SHARD if i % 500 == 0 else 5])))
    check(spark, rows)


def test_before_1970_and_far_ends(spark):
    year_1 = -62_135_596_800
    check(spark, [("a", "p", year_1, year_1 + 10), ("a", "p", -50, -1), ("a", "p", 0, 3), ("a", "p", -10 * iv.SHARD, -7 * iv.SHARD - 1), ("a", "p", 5 * iv.SHARD, iv.FOREVER), (None, None, 1, 2)])


def test_bitmaps_give_their_runs_back():
    import numpy as np

    group, s, e = iv.united(np.array([1, 0, 1, 1, 0]), np.array([5, 0, 1, 8, 4]), np.array([7, 2, 3, 9, 4]))
    assert list(zip(group.tolist(), s.tolist(), e.tolist())) == [(0, 0, 2), (0, 4, 4), (1, 1, 3), (1, 5, 9)]
    groups, bits = iv.packed(group, s, e)
    number, a, b = iv.unpacked(bits)
    assert groups.tolist() == [0, 1] and (groups[number] == group).all() and (a == s).all() and (b == e).all()
