"""Every core query that has SQL agrees with DuckDB on the smallest tables; the others run."""

import pytest
from oracle import assert_same, connect

from loomspan.plans.registry import collect

QUERIES, ORACLES = collect()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, duck, sf, name):
    assert_same(spark, duck, QUERIES[name], ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.collect()) >= 0 and df.columns


def test_entry_point(spark, sf):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["triple_id", "ref_field", "reason"]
