"""Problem 9: held-out passages inside a corpus, by q-gram filtering.

Texts are reduced to lower-case words, each between blanks. By the q-gram lemma
a passage of L characters that occurs with at most e edits shares at least
L + 1 - q (e + 1) q-grams with its place, all in a band of e + 1 neighbouring
diagonals (place in the document minus place in the item). Hits are counted in
overlapping bands; regions that meet the bound are verified by an alignment
that stays in the band. Items are indexed in classes by the length of their
shortest passage, each with a q of its own, so a short item doesn't weaken the
filter for the others. Documents are only scanned: no texts are shuffled.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.tables import load

#: Consecutive words of an item that make a leak; items with fewer count as a whole.
WORDS = 12
#: Edited characters that the search allows in a passage; p9_found keeps the passages without one.
EDITS = 1
#: The q of a class of items is the greatest of these that leaves LEFT q-grams of each passage after the edits.
QS = (32, 24, 16, 8, 4, 2, 1)
LEFT = 4
#: Characters of item text in one index; more items are taken in several scans.
BLOCK_CHARACTERS = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


@functools.cache
def _folds() -> np.ndarray:
    """For each code point its letter or digit without marks, 32 for other characters, 0 for those left out."""
    n = 0x20000
    out = np.full(n, 32, np.uint32)
    for i in range(n):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] in "LN":
            parts = unicodedata.normalize("NFD", c)
            out[i] = ord(parts[0]) if all(unicodedata.category(x)[0] == "M" for x in parts[1:]) else i
        elif kind[0] == "M" or kind == "Cf":
            out[i] = 0
    return out


def folded(text: str) -> np.ndarray:
    """Code points of the lower-case words without marks, each word after one blank, a blank at the end.

    Line feeds (code 10) are kept apart only where they are U+001E, the mark
    between texts of a batch.
    """
    code = np.frombuffer(text.casefold().encode("utf-32-le", "surrogatepass"), np.uint32)
    folds = _folds()
    out = np.where(code < len(folds), folds[np.minimum(code, len(folds) - 1)], code)
    out[code == 0x1E] = 0x1E
    out = out[out != 0]
    blank = out == 32
    keep = ~(blank & np.concatenate([[False], blank[:-1]]))
    return out[keep]


def _padded(text: str) -> np.ndarray:
    f = folded(text.replace("\x1e", " "))
    if not len(f) or f[0] != 32:
        f = np.concatenate([[np.uint32(32)], f])
    return f if f[-1] == 32 else np.concatenate([f, [np.uint32(32)]])


def qgram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on, by doubling."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    power, level, done, at = code.astype(np.uint64), 1, None, 0
    base = _BASE
    with np.errstate(over="ignore"):
        rest = q
        factor = np.uint64(1)
        while rest:
            if rest & 1:
                part = power[at:]
                if done is None:
                    done = part.copy()
                else:
                    size = min(len(done), len(part))
                    done = done[:size] + factor * part[:size]
                at += level
                factor = factor * base
            rest >>= 1
            if rest:
                size = len(power) - level
                power = power[:size] + base * power[level:]
                base = base * base
                level *= 2
    return done[: len(code) - q + 1]


class ItemIndex:
    """The q-grams of some items, in classes by their shortest passage, and the bounds of the lemma."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, edits: int = EDITS, q: int = QS[0]):
        self.edits, self.ids, self.texts, self.windows = edits, [], [], []
        classes: dict[int, list[int]] = {}
        for item, text in items:
            f = _padded(text)
            blanks = np.flatnonzero(f == 32)
            n = len(blanks) - 1
            if n < 1:
                continue
            size = min(words, n)
            # a passage with the blanks around it
            spans = np.column_stack([blanks[: n - size + 1], blanks[size:] + 1])
            shortest = int((spans[:, 1] - spans[:, 0]).min())
            own = next((x for x in QS if x <= q and shortest + 1 - x * (edits + 1) >= LEFT), 1)
            classes.setdefault(own, []).append(len(self.ids))
            self.ids.append(item)
            self.texts.append(f)
            self.windows.append(spans)
        self.shortest = np.array([(w[:, 1] - w[:, 0]).min() for w in self.windows], np.int64)
        self.longest = np.array([(w[:, 1] - w[:, 0]).max() for w in self.windows], np.int64)
        self.classes = [_ClassIndex(self, q, np.array(members)) for q, members in sorted(classes.items())]
        self.flat = np.concatenate([*self.texts, np.zeros(0, np.uint32)])
        self.offset = np.cumsum([0, *map(len, self.texts)])

    def regions(self, code: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Rows (text, item, least and greatest diagonal, first and last place) of the bands that meet the bound."""
        return np.concatenate([np.zeros((0, 6), np.int64), *[c.regions(code, text_of) for c in self.classes]])

    def verified(self, code: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """Rows (text, item, edits): the least edits of an item's passage in each text, where within the budget."""
        rows = [np.zeros((0, 3), np.int64)]
        for part in np.array_split(regions, max(1, len(regions) // 512)):
            pairs = []
            for k, (_, item, low, high, first, last) in enumerate(part.tolist()):
                w = self.windows[item]
                # passages whose place meets the hits; the others have a region of their own
                met = w[(w[:, 0] + high >= first - self.longest[item]) & (w[:, 0] + low < last)]
                pairs.append(np.column_stack([np.full(len(met), k), met + self.offset[item], met[:, 0] + low]))
            if not pairs:
                continue
            of, begin, end, at = np.concatenate(pairs).T
            d = banded_distance(self.flat, begin, end, code, at, part[of, 3] - part[of, 2] + 1, self.edits)
            ok = d <= self.edits
            rows.append(np.column_stack([part[of[ok], 0], part[of[ok], 1], d[ok]]))
        return np.concatenate(rows)


class _ClassIndex:
    """The q-grams of the items of one class, with the class's q."""

    def __init__(self, index: ItemIndex, q: int, members: np.ndarray):
        self.q, self.edits = q, index.edits
        self.bound = np.maximum(index.shortest + 1 - q * (index.edits + 1), 1)
        self.longest = index.longest
        hashes = [qgram_hashes(index.texts[i], q) for i in members]
        sizes = [len(h) for h in hashes]
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.item_of = np.repeat(members, sizes)[order]
        self.place = np.concatenate([np.arange(n) for n in sizes])[order]
        self.hashes, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _BITS)] = True
        self.least = int(self.bound[members].min())

    def regions(self, code: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        none = np.zeros((0, 6), np.int64)
        h = qgram_hashes(code, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _BITS)])
        k = np.searchsorted(self.hashes, h[at])
        k[k == len(self.hashes)] = 0
        real = self.hashes[k] == h[at]
        at, k = at[real], k[real]
        if not len(at):
            return none
        # a text has to hold the bound's number of hits, and the hits of a passage lie in e + 1 runs at most
        run = np.cumsum(np.concatenate([[0], np.diff(at) != 1]))
        long = np.bincount(run)[run] >= -(-self.least // (self.edits + 1))
        texts = text_of[at]
        some = np.zeros(int(texts.max()) + 1, bool)
        some[texts[long]] = True
        some &= np.bincount(texts, minlength=len(some)) >= self.least
        kept = some[texts]
        at, k = at[kept], k[kept]
        if not len(at):
            return none
        n = self.count[k]
        where = np.repeat(at, n)
        inner = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(self.first[k], n) + inner
        item, diagonal = self.item_of[entry], where - self.place[entry]
        # bands of 2 w diagonals, one every w: any w + 1 neighbouring diagonals lie in one of them
        w = max(self.edits, 1)
        band = np.concatenate([diagonal // w, diagonal // w - 1])
        item, where, text = np.tile(item, 2), np.tile(where, 2), np.tile(text_of[where], 2)
        order = np.lexsort((where, band, item, text))
        text, item, band, where = text[order], item[order], band[order], where[order]
        # at least `bound` hits within the longest passage
        last = np.arange(len(where)) + self.bound[item] - 1
        e = np.minimum(last, len(where) - 1)
        ok = (last < len(where)) & (text[e] == text) & (item[e] == item) & (band[e] == band) & (where[e] - where <= self.longest[item] + self.edits - self.q)
        rows = np.column_stack([text[ok], item[ok], band[ok], where[ok], where[e[ok]] + self.q])
        if not len(rows):
            return none
        # one row for overlapping regions of a text, an item and a band
        same = (rows[1:, :3] == rows[:-1, :3]).all(1) & (rows[1:, 3] <= rows[:-1, 4])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        stop = np.maximum.reduceat(rows[:, 4], first)
        one = rows[first]
        return np.column_stack([one[:, 0], one[:, 1], one[:, 2] * w, (one[:, 2] + 2) * w - 1, one[:, 3], stop])


def banded_distance(items: np.ndarray, begin: np.ndarray, end: np.ndarray, code: np.ndarray, at: np.ndarray, width: np.ndarray, most: int) -> np.ndarray:
    """Least edits between each passage items[begin:end] and a part of `code`, in a band of diagonals.

    A passage stands at `at` of `code` on the band's first diagonal; the band
    has `width` diagonals and `most` more on each side. Distances beyond
    `most` are most + 1. Cells outside the band count as beyond it.
    """
    if not len(begin):
        return np.zeros(0, np.int64)
    far = most + 1
    order = np.argsort(begin - end, kind="stable")  # the longest first, so that those still open are the first rows
    begin, size, at, width = begin[order], (end - begin)[order], at[order] - most, width[order] + 2 * most
    wide = int(width.max())
    diagonals = np.arange(wide)
    cost = np.where(diagonals < width[:, None], 0, far).astype(np.int16)
    closed = cost == far
    bare = np.concatenate([code, [np.uint32(0x1E)]])
    out = np.full(len(begin), far, np.int64)
    row = np.arange(len(begin))
    i = 0
    while len(row):
        n = int(np.searchsorted(-size, -i, "left"))  # rows with more than i characters
        out[row[n:]] = cost[n:].min(1)
        # rows that end here go, and now and then those beyond the budget
        live = np.flatnonzero((cost[:n] < far).any(1)) if i % 4 == 0 else slice(0, n)
        row, begin, size, at, cost, closed = row[live], begin[live], size[live], at[live], cost[live], closed[live]
        place = at[:, None] + i + diagonals
        read = bare[np.where((place >= 0) & (place < len(code)), place, len(code))]
        new = cost + (read != items[np.minimum(begin + i, len(items) - 1), None])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a character that the text lacks
        for k in range(1, wide):  # characters that only the text has
            np.minimum(new[:, k], new[:, k - 1] + 1, out=new[:, k])
        new[closed] = far
        cost = np.minimum(new, far)
        i += 1
    result = np.empty_like(out)
    result[order] = out
    return result


def leaks(documents: DataFrame, items: Iterable[tuple[int, str]], words: int = WORDS, edits: int = 0, q: int = QS[0]) -> DataFrame:
    """(doc_id, item_id, edits) where a document holds `words` consecutive words of an item.

    Items with fewer words must occur whole. Case, punctuation, marks and line
    breaks don't matter. A passage may differ by `edits` characters, the
    blanks around it among them. Null and blank texts and items hold nothing.
    One row for each document row and item; the least number of edits is given.
    """
    spark = documents.sparkSession
    out = None
    for block in _blocks(items):
        # an index of BLOCK_CHARACTERS at most
        shared = spark.sparkContext.broadcast(ItemIndex(block, words, edits, q))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            between = np.full(edits + 1, 0x1E, np.uint32)  # so many that no passage reaches over them
            for pdf in batches:
                found = [pd.DataFrame({"doc_id": [], "item_id": [], "edits": []})]
                for part in _parts(pdf):
                    texts = [_padded(t) for t in part["text"]]
                    code = np.concatenate([x for t in texts for x in (t, between)])
                    text_of = np.repeat(np.arange(len(texts)), [len(t) + len(between) for t in texts])
                    text, item, d = index.verified(code, index.regions(code, text_of)).T
                    if len(text):
                        least = pd.DataFrame({"text": text, "item": item, "edits": d}).groupby(["text", "item"], as_index=False)["edits"].min()
                        found.append(pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[least["text"]], "item_id": np.array(index.ids)[least["item"]], "edits": least["edits"]}))
                yield pd.concat(found, ignore_index=True)

        found = documents.select("doc_id", "text").filter("text is not null and doc_id is not null").mapInPandas(run, "doc_id long, item_id long, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(items: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of BLOCK_CHARACTERS, read one at a time; one empty block where there are none."""
    block: list[tuple[int, str]] = []
    size, any_ = 0, False
    for i, t in items:
        if t is None:
            continue
        if block and size + len(t) > BLOCK_CHARACTERS:
            yield block
            block, size, any_ = [], 0, True
        block.append((i, t))
        size += len(t)
    if block or not any_:
        yield block


def _parts(pdf: pd.DataFrame, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    size = pdf["text"].str.len().to_numpy().cumsum() // most
    for _, part in pdf.groupby(size, sort=False):
        yield part


def held_out(spark: SparkSession, sf_dir: str) -> Iterator[tuple[int, str]]:
    """The evaluation items, in order, a partition at a time."""
    rows = load(spark, sf_dir, "eval_items").filter("text is not null and item_id is not null").select("item_id", "text").orderBy("item_id", "text")
    return ((r.item_id, r.text) for r in rows.toLocalIterator())


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, edits): documents with a passage of an item in which at most EDITS characters are edited."""
    found = leaks(load(spark, sf_dir, "documents"), held_out(spark, sf_dir), edits=EDITS)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): twelve consecutive words of an item, or all of a shorter one.

    Of the passages that the search finds within its edit budget those whose
    alignment has no edit.
    """
    return p9_near(spark, sf_dir).filter("edits = 0").select("doc_id", "item_id")


# Every run of so many words of every document against those of the items; d.words and i.words without marks.
P9_FOUND_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS words FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
passages AS (
  SELECT DISTINCT item_id, least(12, len(words)) AS n, array_to_string(list_slice(words, pos, pos + least(12, len(words)) - 1), ' ') AS passage
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(12, len(words)) + 2)) AS pos FROM i WHERE len(words) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), runs AS (
  SELECT DISTINCT doc_id, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS passage
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM passages) WHERE len(words) >= n)
)
SELECT DISTINCT doc_id, item_id FROM runs JOIN passages USING (n, passage)
"""
