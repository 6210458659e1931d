"""Null rows, repeats and clashing columns change nothing; empty tables give empty results."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from hostile import copies, empties, result  # noqa: E402

from loomspan.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def dirty(sf, tmp_path_factory):
    return copies(sf, tmp_path_factory.mktemp("dirty"))


@pytest.fixture(scope="module")
def empty(sf, tmp_path_factory):
    return empties(sf, tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_dirty(spark, sf, dirty, name):
    assert result(QUERIES[name], spark, dirty) == result(QUERIES[name], spark, sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []
