"""Queries of the llm package: those with SQL agree with DuckDB, all run on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import assert_same, connect  # noqa: E402

from loomspan.llm.queries import ORACLES, QUERIES  # noqa: E402

COLUMNS = {
    "p1_found": ["id"], "p3_found": ["record_table", "record_id", "pii_type"], "p4_found": ["source_table", "conversation_id", "turn", "message_id"], "p6_found": ["id_a", "id_b"],
    "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, sf, name):
    assert_same(spark, connect(sf), QUERIES[name], ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
