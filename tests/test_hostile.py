"""Null rows, repeats and clashing columns change nothing; empty tables give empty results."""

import pytest
from hostile import copies, empties, result

from loomspan.plans.problems import QUERIES
from loomspan.plans.registry import collect


@pytest.fixture(scope="module")
def dirty(sf, tmp_path_factory):
    return copies(sf, tmp_path_factory.mktemp("dirty"))


@pytest.fixture(scope="module")
def empty(sf, tmp_path_factory):
    return empties(sf, tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_dirty(spark, sf, dirty, name):
    assert result(QUERIES[name], spark, dirty) == result(QUERIES[name], spark, sf)


#: Aggregates over everything have a row for an empty table.
ONE_ROW = {"source_stats", "fact_stats", "graph_stats", "decay_stats", "origin_density", "sweep_totals", "knn_recall"}


@pytest.mark.parametrize("name", sorted(collect()[0]))
def test_empty(spark, empty, name):
    assert len(collect()[0][name](spark, empty).collect()) == (1 if name in ONE_ROW else 0)


@pytest.mark.parametrize("name", sorted(set(collect()[0]) - set(QUERIES)))
def test_dirty_runs(spark, dirty, name):
    collect()[0][name](spark, dirty).collect()
