"""Problem 1: pieces of oversized texts, cut at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.tables import load

#: Most characters of a piece, and most that it repeats of the piece before.
LIMIT = 1200
OVERLAP = 100
#: Least share of the limit that a piece cut at a better kind of boundary has.
LEAST = 0.5

_TOKEN = re.compile(r"\s*\S+\s*?(?=\s|$)|\s+$")
_PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n\s*|\r[ \t]*\r\s*")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)|[。！？]+")
_LINE = re.compile(r"\r\n|\n|\r")


def boundaries(text: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Token ends as prefix sums of token lengths, and sorted ends of paragraphs, sentences, lines and words."""
    lengths = np.fromiter((m.end() - m.start() for m in _TOKEN.finditer(text)), np.int64)
    ends = np.cumsum(lengths)
    at = lambda pattern: np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
    return ends, {"paragraph": at(_PARAGRAPH), "sentence": at(_SENTENCE), "line": at(_LINE), "word": ends}


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of each piece, in order.

    The last boundary at or before `limit` is found by binary search, the best
    kind first that leaves a piece of half the limit at least, then any kind;
    without one the piece is cut at the limit. A piece starts `overlap`
    characters before the end of the one before it or, where it is at most
    `overlap` away, at the next word. Texts within the limit are one piece;
    the empty text is none.
    """
    if not text:
        return []
    if overlap >= limit:
        raise ValueError("overlap must be less than limit")
    _, kinds = boundaries(text)
    starts = np.fromiter((m.start() for m in re.finditer(r"(?<!\S)\S", text)), np.int64)
    n, start, out = len(text), 0, []
    done = 0
    while n - start > limit:
        cut, how = 0, "hard"
        for least in (start + int(limit * LEAST), start + overlap):
            for kind, ends in kinds.items():
                i = np.searchsorted(ends, start + limit, "right") - 1
                if i >= 0 and ends[i] > max(least, done):
                    cut, how = int(ends[i]), kind
                    break
            if cut:
                break
        if not cut:
            cut = start + limit
        out.append((start, cut, how))
        done = cut
        back = cut - overlap
        i = np.searchsorted(starts, back, "left")
        start = int(starts[i]) if i < len(starts) and starts[i] < cut else back
    out.append((start, n, "end"))
    return out


#: What counts as blank at a text's two ends.
BLANKS = " \t\r\n"


def core(content: Column) -> Column:
    """Without spaces, tabs and line breaks at the two ends."""
    return F.trim(content, F.lit(BLANKS))


def split_texts(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows of `df` whose text exceeds the limit, as pieces.

    Returns the keys and (chunk_index int, start int, end int, boundary, piece):
    offsets count from the first character that isn't blank. Without the
    repeated part the pieces join to the text without the blanks at its ends.
    Null, blank and short texts have no rows. Short rows never reach Python;
    each row is split by itself, so there is no shuffle.
    """
    long = df.select(*keys, core(F.col(text)).alias("core")).filter(F.char_length("core") > limit)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*own, i, a, b, how, t[a:b]) for own, t in zip(pdf[keys].itertuples(index=False, name=None), pdf["core"]) for i, (a, b, how) in enumerate(pieces(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=[*keys, "chunk_index", "start", "end", "boundary", "piece"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", chunk_index int, start int, end int, boundary string, piece string"
    return long.mapInPandas(run, schema)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content_hash, chunk_index, start, end, boundary, piece) of every oversized drawer.

    A drawer filed several times with one content has one set of pieces, told
    apart from other contents under the same id by content_hash.
    """
    drawers = load(spark, sf_dir, "drawers").filter(F.length("content") > LIMIT).select("id", F.xxhash64("content").alias("content_hash"), "content").dropDuplicates(["id", "content_hash"])
    return split_texts(drawers, ["id", "content_hash"], "content")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id) of the drawers that had to be split."""
    drawers = load(spark, sf_dir, "drawers").filter(F.length("content") > LIMIT)
    return split_texts(drawers, ["id"], "content").filter("chunk_index = 1").select("id").dropDuplicates()


def p1_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n_characters, least_pieces, fits, covers, overlaps): what must hold of the pieces of each oversized content.

    n_characters is what the pieces give back without their repeated parts;
    least_pieces whether there are at least as many as the limit allows; fits:
    no piece exceeds the limit; covers: indexes and offsets are without a hole;
    overlaps: no piece repeats more than OVERLAP characters.
    """
    pieces = p1_pieces(spark, sf_dir).withColumn("size", F.char_length("piece"))
    along = W.partitionBy("id", "content_hash").orderBy("chunk_index")  # the pieces of one content
    before = pieces.withColumn("last", F.lag("end").over(along)).withColumn("place", F.row_number().over(along) - 1)
    repeated = F.coalesce(F.col("last") - F.col("start"), F.lit(0))
    one = before.groupBy("id", "content_hash").agg(
        F.sum(F.col("size") - repeated).cast("long").alias("n_characters"),
        F.count("*").alias("n"),
        F.max("size").alias("most"),
        F.min((F.col("place") == F.col("chunk_index")) & (F.col("end") - F.col("start") == F.col("size")) & (repeated >= 0) & ((F.col("place") > 0) | (F.col("start") == 0))).alias("covers"),
        F.max(repeated).alias("repeated"),
    )
    return one.select("id", "n_characters", (F.col("n") * LIMIT >= F.col("n_characters")).alias("least_pieces"), (F.col("most") <= LIMIT).alias("fits"), "covers", (F.col("repeated") <= OVERLAP).alias("overlaps")).dropDuplicates()


P1_CHECKED_SQL = r"""SELECT DISTINCT id, CAST(length(core) AS BIGINT) AS n_characters, true AS least_pieces, true AS fits, true AS covers, true AS overlaps
FROM (SELECT id, regexp_replace(content, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS core FROM drawers) WHERE length(core) > 1200"""
P1_FOUND_SQL = r"SELECT DISTINCT id FROM drawers WHERE length(regexp_replace(content, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) > 1200"
