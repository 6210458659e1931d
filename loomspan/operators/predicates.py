"""Predicate trees over record fields, compiled to Catalyst columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMPARISONS = ("$eq", "$ne", "$in", "$nin", "$contains", "$gt", "$gte", "$lt", "$lte")


class UnsupportedFilter(ValueError):
    """An operator that the filter language doesn't have."""


def where_column(where: dict | None) -> Column:
    """A boolean column of a where tree, of comparisons that reach the file scan.

    {} and None match all; {field: value} means equality; several fields in
    one dict must all match. A null field is unequal to every value, so $ne
    and $nin match it; other comparisons with it are null, which a filter
    takes as no match. Unknown operators raise.
    """
    if not where:
        return F.lit(True)
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise UnsupportedFilter(f"{key} needs a list of filters")
            inner = [where_column(v) for v in value]
            parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, inner))  # noqa: B023
        elif key.startswith("$"):
            raise UnsupportedFilter(f"unknown operator {key}")
        elif isinstance(value, dict):
            if not value:
                raise UnsupportedFilter(f"no operator for {key}")
            parts += [_comparison(F.col(f"`{key}`"), op, v) for op, v in value.items()]
        else:
            parts.append(_comparison(F.col(f"`{key}`"), "$eq", value))
    return reduce(lambda a, b: a & b, parts)


def _comparison(c: Column, op: str, v: object) -> Column:
    match op:
        case "$eq":
            return c == F.lit(v) if v is not None else c.isNull()
        case "$ne":
            return (c != F.lit(v)) | c.isNull() if v is not None else c.isNotNull()
        case "$in":
            return c.isin(list(v))
        case "$nin":
            return ~c.isin(list(v)) | c.isNull()
        case "$contains":
            return c.contains(v)
        case "$gt":
            return c > F.lit(v)
        case "$gte":
            return c >= F.lit(v)
        case "$lt":
            return c < F.lit(v)
        case "$lte":
            return c <= F.lit(v)
    raise UnsupportedFilter(f"unknown operator {op}")


def document_column(where_document: dict | None, text: str = "content") -> Column:
    """The text predicate: $contains and $not_contains, joined by $and and $or."""
    if not where_document:
        return F.lit(True)
    parts = []
    for op, v in where_document.items():
        if op == "$contains":
            parts.append(F.col(text).contains(v))
        elif op == "$not_contains":
            parts.append(~F.col(text).contains(v) | F.col(text).isNull())
        elif op in ("$and", "$or"):
            parts.append(reduce(lambda a, b: a & b if op == "$and" else a | b, [document_column(x, text) for x in v]))  # noqa: B023
        else:
            raise UnsupportedFilter(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts)


def scope(wing: str | None = None, room: str | None = None) -> dict:
    """The where tree of an optional wing and room; '' counts as absent."""
    own = [{k: v} for k, v in (("wing", wing), ("room", room)) if v]
    return {} if not own else own[0] if len(own) == 1 else {"$and": own}


def get(df: DataFrame, ids: list[str] | None = None, where: dict | None = None, where_document: dict | None = None, limit: int | None = None, offset: int = 0, include: list[str] | None = None, text: str = "content") -> DataFrame:
    """A filtered page in the order of ids; `include` names the columns besides id."""
    out = df.filter(where_column(where)).filter(document_column(where_document, text))
    if ids is not None:
        out = out.filter(F.col("id").isin(ids))
    if include is not None:
        out = out.select("id", *[c for c in include if c != "id"])
    if limit is not None or offset:
        # pages need a total order; rows of one id are told apart by their other columns
        out = out.orderBy("id", *[c for c in out.columns if c != "id"])
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit is not None else out
    return out


def page_with_total(df: DataFrame, where: dict | None, limit: int, offset: int) -> DataFrame:
    """A page in the order of ids, each row with the number of all matching rows."""
    kept = df.filter(where_column(where))
    total = kept.agg(F.count("*").alias("total"))  # one row
    page = kept.orderBy(*["id", *[c for c in df.columns if c != "id"]]).offset(offset).limit(limit)
    return page.join(F.broadcast(total))


def current(df: DataFrame, key: str = "id", version: str = "filed_at") -> DataFrame:
    """The last version of each record: upserts by key, the greatest version wins; ties by all columns."""
    order = [F.desc_nulls_last(version), *[F.desc_nulls_last(c) for c in df.columns if c not in (key, version)]]
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def is_registry_row() -> Column:
    """Sentinel rows that only mark a source as read."""
    return F.coalesce(F.col("room") == "_registry", F.lit(False)) | F.coalesce(F.col("id").startswith("_reg_"), F.lit(False))


def matches_extract_mode(mode: str, column: str = "extract_mode") -> Column:
    """A null mode counts as exchange."""
    return F.coalesce(column, F.lit("exchange")) == mode


def within(distance: str, most: float) -> Column:
    """Distances up to `most`; 0 switches the filter off."""
    return F.lit(True) if most <= 0 else F.col(distance) <= most
