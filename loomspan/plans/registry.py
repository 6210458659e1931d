"""All queries of the core library and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package with QUERIES and ORACLES.
MODULES = ["problems", "records", "text", "facts", "graph", "retrieval", "ingest"]


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        m = import_module(f"loomspan.plans.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
