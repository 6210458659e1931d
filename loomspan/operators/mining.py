"""Mining as one operator: gate, chunk, route, purge, file, mark and index."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import classify, splitting
from loomspan.operators import records as R

#: Ways to split a text, by the kind of source.
SPLITTERS = {"files": splitting.chunk_files, "conversations": splitting.chunk_conversations}
#: Version of the rows that mining writes; older rows are mined again.
VERSION = 2


class Mined(NamedTuple):
    """store: the store afterwards; added: its new rows, sentinels among them; closets: index rows of them."""

    store: DataFrame
    added: DataFrame
    closets: DataFrame


def _named(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24))


def mined(files: DataFrame, stored: DataFrame, wing: str, rooms: list[dict], added_by: str, filed_at: str, kind: str = "files", version: int = VERSION) -> Mined:
    """Files `files` (source_file, mtime, text) into `stored`.

    Only sources that aren't read yet in this version, or have changed, are
    mined. Their old rows go, their pieces come; a source without a piece
    (blank, noise or too short) leaves a sentinel row, so that it isn't tried
    again until it changes. Ids are of place and content, so mining twice
    changes nothing. Null texts are blank; of repeated sources each is mined
    once, the greatest text counts. An empty `files` changes nothing.

    `stored` has id, content, wing, room, source_file, chunk_index, added_by,
    filed_at, normalize_version and source_mtime; further columns stay, null
    in new rows. Texts aren't shuffled but for repeated sources.
    """
    if kind not in SPLITTERS:
        raise ValueError(f"kind must be one of {sorted(SPLITTERS)}, got {kind!r}")
    one = files.filter("source_file is not null").groupBy("source_file").agg(F.max(F.struct("mtime", "text")).alias("f")).select("source_file", "f.mtime", "f.text")
    todo = R.unread(one, R.read_sources(stored, version))
    pieces = SPLITTERS[kind](todo, ["source_file", "mtime"], "text")
    placed = pieces.withColumn("room", classify.room(F.col("source_file"), F.col("content"), rooms))
    common = [F.lit(wing).alias("wing"), F.lit(added_by).alias("added_by"), F.lit(filed_at).alias("filed_at"), F.lit(version).alias("normalize_version"), F.col("mtime").alias("source_mtime")]
    rows = placed.select(_named(f"drawer_{wing}_", "source_file", F.col("chunk_index").cast("string"), "content").alias("id"), "content", "room", "source_file", "chunk_index", *common)
    empty = todo.select("source_file", "mtime").join(pieces.select("source_file").distinct(), "source_file", "left_anti")
    marks = empty.select(_named("_reg_", "source_file").alias("id"), F.lit("").alias("content"), F.lit("_registry").alias("room"), "source_file", F.lit(0).alias("chunk_index"), *common)
    added = rows.unionByName(marks)
    kept = stored.join(todo.select("source_file"), "source_file", "left_anti")
    store = kept.select(*stored.columns).unionByName(added, allowMissingColumns=True)
    lines = classify.pack(classify.closet_lines(F.col("content"), F.col("id"), F.col("wing"), F.col("room"), F.col("source_file")))
    packs = rows.select("id", "wing", "room", "source_file", F.posexplode(lines).alias("place", "content"))
    closets = packs.select(_named("closet_", "id", F.col("place").cast("string")).alias("closet_id"), "content", "wing", "room", "source_file")
    return Mined(store, added, closets)


def parted(records: DataFrame, healthy: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(those whose key is in `healthy`, all others); null keys are never healthy."""
    good = healthy.select(key).distinct()
    return records.join(good, key, "left_semi"), records.join(good, key, "left_anti")
