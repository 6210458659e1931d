"""Copies of the smallest tables with null rows, repeated rows and columns whose names clash, and empty tables."""

import shutil
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

#: Names that operators use themselves.
CLASHES = ["key", "class", "cell", "size", "month", "code", "row_key", "source", "readings", "pid", "n", "kind", "label", "at", "s", "e", "shard", "turn", "role", "position", "ids", "edits", "core", "record_id", "domain", "core_", "content_hash"]


def copies(sf: str, folder: Path) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    for p in Path(sf).glob("*.parquet"):
        t = pq.read_table(p)
        if p.stem in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
            shutil.copy(p, folder / p.name)
            continue
        schema = pa.schema([f.with_nullable(True) for f in t.schema])
        nulls = pa.table({f.name: pa.nulls(3, f.type) for f in schema}, schema=schema)
        t = pa.concat_tables([t.cast(schema), nulls] + ([t.slice(0, 5).cast(schema)] if p.stem not in ("documents",) else []))
        for c in CLASHES:
            if c not in t.column_names:
                t = t.append_column(c, pa.array(["clash"] * len(t)))
        pq.write_table(t, folder / p.name)
    return str(folder)


def empties(sf: str, folder: Path) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    for p in Path(sf).glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), folder / p.name)
    return str(folder)


def result(query, spark, sf):
    """Rows whose first two columns aren't null, as a sorted list."""
    df = query(spark, sf)
    return sorted((tuple(r) for r in df.collect() if None not in tuple(r)[:2]), key=repr)
