"""Problem 8: encoding of the whole corpus by a tokenization automaton.

The automaton has a state for each token, the one read last, and arcs labelled
with tokens. It is compiled from the merges, one gadget each in their order:
the gadget of (u, v) -> w adds the arc w wherever u then v was allowed and
takes the arc v away from the states that the arc u leads to. Of all tokens
that begin with v those lose their arc whose own merges over v come no earlier
than the gadget's; with the tokens numbered so that each token stands before
those that it is the left part of, later merges first, they are one range of
numbers. A state's lost arcs are therefore a table of ranges. Arcs are read
byte by byte through a table of transitions that all states share, so a word
is encoded by walking tables: each prefix of a word has one state only, and
the labels on the way back are the ids.

The tables are compiled once, on the driver, and broadcast; executors need no
vocabulary file. Their size is that of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import importlib.util
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspan.tables import load

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Entries after which a worker's table of encoded words starts anew, and the longest word it keeps.
CACHE = 300_000
LONGEST_KEPT = 64


def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes and id of each token of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Automaton:
    """A deterministic automaton for one byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
        self.texts = {i: t for t, i in ranks.items()}
        #: For each token its merge (left, right); bytes have none.
        self.merges = _merges(ranks)
        self._compile(ranks)

    def _compile(self, ranks: dict[bytes, int]) -> None:
        """The tables of states and of transitions."""
        made = sorted(i for t, i in ranks.items() if len(t) == 1 or i in self.merges)
        begun: dict[int, list[int]] = {i: [] for i in made}  # tokens by their left part, later merges first
        gadgets: dict[int, list[tuple[int, int]]] = {i: [] for i in made}  # (token made, right part) by the left part
        for w in reversed([i for i in made if i in self.merges]):
            u, v = self.merges[w]
            begun[u].append(w)
            gadgets[u].append((w, v))
        number: dict[int, int] = {}
        last: dict[int, int] = {}  # the last number of a token and those that begin with it
        for root in (i for i in made if i not in self.merges):
            stack = [root]
            while stack:
                t = stack.pop()
                if t < 0:
                    last[~t] = len(number) - 1
                else:
                    number[t] = len(number)
                    stack.append(~t)
                    stack.extend(reversed(begun[t]))

        def lost(v: int, w: int) -> tuple[int, int]:
            """Numbers of the tokens that begin with v and aren't yet made of it when the merge w comes."""
            later = [c for c in begun[v] if c >= w]
            return number[v], last[later[-1]] if later else number[v]

        ranges = {u: [(w, *lost(v, w)) for w, v in sorted(g)] for u, g in gadgets.items()}
        low, high, first = [], [], {}
        for u in made:
            # the gadgets of u, and those of its right parts that come before these were merged away
            own, part, until = [], u, 1 << 60
            while True:
                own += [(x, y) for w, x, y in ranges[part] if w < until]
                if part not in self.merges:
                    break
                part, until = self.merges[part][1], part
            begin, at = len(low), -1
            for x, y in sorted(own):
                if x <= at + 1 and len(low) > begin:
                    at = high[-1] = max(at, y)
                else:
                    low.append(x)
                    high.append(y)
                    at = y
            first[u] = (begin, len(low))
        size = max(ranks.values()) + 1
        self.low, self.high = np.array(low, np.int32), np.array(high, np.int32)
        self.begin, self.end, self.number = np.zeros(size, np.int32), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for u, (x, y) in first.items():
            self.begin[u], self.end[u], self.number[u] = x, y, number[u]
        go: dict[int, int] = {}
        label = [-1]
        for i in made:
            node = 0
            for c in self.texts[i]:
                key = node << 8 | c
                if key not in go:
                    go[key] = len(label)
                    label.append(-1)
                node = go[key]
            label[node] = i
        self.go = np.array(list(go.items()), np.int64)
        self.label = np.array(label, np.int32)

    @functools.cached_property
    def tables(self) -> tuple:
        """The tables in the form in which single entries are read fastest."""
        return dict(self.go.tolist()), self.label.tolist(), self.begin.tolist(), self.end.tolist(), self.number.tolist(), self.low.tolist(), self.high.tolist()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def allowed(self, u: int, v: int) -> bool:
        """Has the state of u an arc v: is the encoding of their joined text just the two of them?"""
        _, _, begin, end, number, low, high = self.tables
        k = bisect.bisect_right(low, number[v], begin[u], end[u]) - 1
        return k < begin[u] or high[k] < number[v]

    def encode(self, word: bytes) -> tuple[int, ...]:
        go, label, begin, end, number, low, high = self.tables
        n = len(word)
        state, start = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            u = state[i]
            x, y = (begin[u], end[u]) if i else (0, 0)
            node, j = 0, i
            while j < n:
                node = go.get(node << 8 | word[j], 0)
                if not node:
                    break
                j += 1
                t = label[node]
                if t >= 0 and state[j] < 0:
                    if y > x:
                        k = bisect.bisect_right(low, number[t], x, y) - 1
                        if k >= x and high[k] >= number[t]:
                            continue
                    state[j], start[j] = t, i
        out, at = [], n
        while at:
            out.append(state[at])
            at = start[at]
        return tuple(out[::-1])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.texts[i] for i in ids)


def _merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The merge (left, right) of each token, found in order: the two tokens that its text was before.

    Of all ways to part a text into two earlier tokens it is the one in which
    no merge across the border comes before the parts' own. Walking both parts'
    merges back, the latest first, is the pair test of published linear-time
    encoders for byte-pair vocabularies.
    """
    texts = {i: t for t, i in ranks.items()}
    merges: dict[int, tuple[int, int]] = {}

    def apart(u: int, v: int, limit: int) -> bool:
        while True:
            joined = ranks.get(texts[u] + texts[v])
            if joined is not None and joined < limit and merges.get(joined) == (u, v):
                return False
            if u > v:
                if u not in merges:
                    return True
                limit, u = u, merges[u][1]
            else:
                if v not in merges:
                    return True
                limit, v = v + 1, merges[v][0]

    for text, i in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(text)):
            u, v = ranks.get(text[:cut]), ranks.get(text[cut:])
            if u is not None and v is not None and u < i and v < i and apart(u, v, i):
                merges[i] = (u, v)
                break
    return merges


# The pre-splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same in the standard library's classes, which agree on texts without the characters of _UNLIKE.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@functools.cache
def _unlike() -> re.Pattern:
    """Characters that the two patterns class unlike, found by asking both."""
    import sys

    import regex

    letter, number, space = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")
    out = []
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if not 0xD800 <= i < 0xE000 and i > 127 and (c.isalnum() or c.isspace()):
            fast = (c.isalpha() or (c.isalnum() and not c.isdecimal()), c.isdecimal(), c.isspace())
            if fast != (bool(letter.match(c)), bool(number.match(c)), bool(space.match(c))):
                out.append(c)
    return re.compile("[" + re.escape("".join(out)) + "\x1c-\x1f]")


class Encoder:
    """Splits texts into words and encodes each word once."""

    def __init__(self, automaton: Automaton):
        import regex

        self.automaton = automaton
        self.exact = regex.compile(PATTERN)
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        words, encode = self.words, self.automaton.encode
        for w in self.exact.findall(chunk) if _unlike().search(chunk) else _FAST.findall(chunk):
            ids = words.get(w)
            if ids is None:
                ids = encode(w.encode("utf-8", "surrogatepass"))
                if len(w) <= LONGEST_KEPT:
                    words[w] = ids
            out.extend(ids)
        ids = tuple(out)
        if len(chunk) <= LONGEST_KEPT:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """A split before each single blank never changes the words, so texts are looked up in such chunks."""
        out: list[int] = []
        chunks = self.chunks
        pieces = text.split(" ")
        held = pieces[0]
        for p in pieces[1:]:
            if p and not p[0].isspace():
                ids = chunks.get(held)
                out.extend(self._chunk(held) if ids is None else ids)
                held = " " + p
            else:
                held += " " + p
        if held:
            out.extend(chunks.get(held) or self._chunk(held))
        if len(chunks) > CACHE or len(self.words) > CACHE:
            chunks.clear()
            self.words.clear()
        return out


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    path = Path(folder) / f"{name}.tiktoken"
    if path.exists():
        return str(path)
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent / path.name) if spec and spec.origin else str(path)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of one vocabulary file, compiled once a process."""
    return Encoder(Automaton(ranks_of(path)))


_OWN: dict[str, Encoder] = {}


def _shared(df: DataFrame, path: str) -> Callable[[], Encoder]:
    """Compiles the automaton on the driver; gives what finds a worker's own encoder of it."""
    automaton = df.sparkSession.sparkContext.broadcast(encoder(path).automaton)  # of the size of the vocabulary

    def own() -> Encoder:
        a = automaton.value
        if a.key not in _OWN:
            _OWN[a.key] = Encoder(a)
        return _OWN[a.key]

    return own


def encode_texts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids) of each row; the empty and the null text have an empty list.

    Narrow: no shuffle, a batch at a time. Strings that look like special
    tokens are ordinary text; blank texts are encoded as they are.
    """

    own = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = own()
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend(enc.encode(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_texts(df: DataFrame, key: str, path: str) -> DataFrame:
    """(key, text) from (key, ids): the labels along the arcs; null ids give a null text."""

    own = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = own().automaton
        for b in batches:
            texts = [None if i is None else auto.decode(i).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, "ids").mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of each document by byte_bpe_50k."""
    return encode_texts(load(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path())


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, round_trip): tokens of each document, and whether decoding gives its text back."""
    from pyspark.sql import functions as F

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    own = _shared(docs, vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = own()
        for b in batches:
            n, same = [], []
            for t in b.column(1).to_pylist():
                ids = enc.encode(t) if t else []
                n.append(len(ids))
                same.append(enc.automaton.decode(ids) == (t or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(same)], names=["doc_id", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, "doc_id long, n_tokens int, round_trip boolean").select("doc_id", "n_tokens", F.col("round_trip"))
