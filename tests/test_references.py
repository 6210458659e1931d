"""Problem 2 on hostile rows; its SQL is in test_oracles."""

from datetime import datetime

from loomspan.operators import references as rf


def T(y, m, d):
    return datetime(y, m, d)


REFS = "triple_id string, ref_field string, domain string, key string, extracted_at timestamp, month int"


def refs(spark, rows):
    return spark.createDataFrame([(t, f, d, k, at, at.year * 12 + at.month - 1 if at else rf.ALWAYS - 1) for t, f, d, k, at in rows], REFS)


def test_reasons(spark):
    r = refs(spark, [
        ("t1", "subject", "entities", "a", T(2024, 5, 2)), ("t1", "subject", "entities", "a", T(2024, 5, 2)), ("t2", "object", "entities", "a", T(2024, 5, 4)), ("t3", "subject", "entities", "gone", T(2024, 6, 1)),
        ("t4", "subject", "entities", "nowhere", T(2024, 6, 1)), ("t5", "source_drawer_id", "drawers", "d1", T(2020, 1, 1)), ("t6", "source_drawer_id", "drawers", "a", T(2020, 1, 1)), ("t7", "subject", "entities", "nowhere", None), ("t8", "subject", "entities", "a", None),
        *[(f"h{i}", "subject", "entities", "hot", T(2024, 1 + i % 12, 1)) for i in range(500)],
    ])
    there = spark.createDataFrame([("entities", "a", T(2024, 5, 3)), ("entities", "a", T(2024, 7, 3)), ("drawers", "d1", None), ("entities", "unused", T(2020, 1, 1))], "domain string, key string, created_at timestamp")
    gone = spark.createDataFrame([("entities", "gone"), ("drawers", "nowhere"), ("entities", "a")], "domain string, key string")
    got = {(x.triple_id, x.reason) for x in rf.orphans(r, there, gone).collect() if not x.triple_id.startswith("h")}
    assert got == {("t1", "late"), ("t3", "deleted"), ("t4", "missing"), ("t6", "missing"), ("t7", "missing")}
    assert rf.orphans(r, there, gone).filter("triple_id like 'h%'").count() == 500


def test_empty(spark):
    there = spark.createDataFrame([], "domain string, key string, created_at timestamp")
    gone = spark.createDataFrame([], "domain string, key string")
    assert rf.orphans(refs(spark, []), there, gone).collect() == []
    assert rf.orphans(refs(spark, [("t", "subject", "entities", "x", None)]), there, gone).count() == 1


def test_many_keys_cross_bitmaps(spark):
    n = 70_000
    rows = spark.range(n).selectExpr("concat('t', id) triple_id", "'subject' ref_field", "'entities' domain", "concat('k', id) key", "timestamp'2024-03-01' extracted_at", f"{2024 * 12 + 2} month")
    there = spark.range(n).filter("id % 7 <> 3").selectExpr("'entities' domain", "concat('k', id) key", "timestamp'2024-01-01' created_at")
    gone = spark.createDataFrame([], "domain string, key string")
    assert rf.orphans(rows, there, gone).count() == len([i for i in range(n) if i % 7 == 3])


def test_compressed_bitmaps():
    import numpy as np

    from loomspan.operators import references as r

    rng = np.random.default_rng(3)
    for n in (0, 1, 2047, 2048, 20_000):
        places = np.sort(rng.choice(r.BITS, n, replace=False))
        packed = r.packed(places)
        assert len(packed) == (2 * n if n < r.SPARSE else r.BITS // 8) and (np.flatnonzero(r.unpacked(packed)) == places).all()
