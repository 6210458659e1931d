"""Near names: the walk of two tries against brute force; names that all begin alike don't all meet."""

import random
import threading

import pytest

from loomspan.operators import edits as E
from loomspan.operators import facts as K


def edit(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
@pytest.mark.parametrize("begin", ["", "Supplier#0", "ä𝛼"])
@pytest.mark.parametrize("walked", [300, 1 << 22])
def test_against_brute_force(monkeypatch, most, begin, walked):
    monkeypatch.setattr(E, "WALKED", walked)
    rng = random.Random(most)
    names = lambda n: sorted(begin + "".join(rng.choice("abc𝛼") for _ in range(rng.randint(1, 7))) for _ in range(n))
    a, b = names(90), names(120)  # some are there more than once
    got = sorted((x, y, d) for part in E.near_pairs(a, b, most) for x, y, d in zip(*(p.tolist() for p in part)))
    assert got == sorted((i, j, d) for i, x in enumerate(a) for j, y in enumerate(b) if 1 <= (d := edit(x, y)) <= most)


def test_blocks_leave_no_pair_out(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 20)
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abAB") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    df = spark.createDataFrame([(x,) for x in [*names, None, ""]], "name string")
    got = sorted(tuple(r) for r in K.similar_names(df, df, also_mentioned=True).collect())
    assert got == sorted((x, y, d) for x in names for y in names if 1 <= (d := edit(x.lower(), y.lower())) <= 2)


def test_names_that_begin_alike_do_not_all_meet(spark):
    names = spark.createDataFrame([(f"Supplier#{i:09d}",) for i in range(4_000)], "name string")
    sc = spark.sparkContext
    sc.setJobGroup("near", "names that begin alike", True)
    late = threading.Timer(60, sc.cancelJobGroup, ["near"])  # fails the query
    late.start()
    try:
        assert K.similar_names(names, names, also_mentioned=True).count() == 1_514_652  # as the SQL of similar_suppliers has it
    finally:
        late.cancel()
        sc._jsc.clearJobGroup()
