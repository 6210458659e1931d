"""Comparison of a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"create view {p.stem} as from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def assert_same(spark, c, query, sql, sf):
    df = query(spark, sf)
    order = sorted(df.columns)
    r = c.sql(sql)
    assert sorted(r.columns) == order
    assert rows(df.columns, df.collect(), order) == rows(list(r.columns), r.fetchall(), order)
