import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import tokenizer as tk

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ENC = tk.encoder(tk.vocabulary_path())
TEXTS = [
    "", " ", "  ", "\n\n a  b\r\n\tc ", "It's we'll I'd don't 'S", "<|endoftext|> is text", "naïve café Straße ÀÉ", "漢字かな交じり文", "👩‍👩‍👧 🙏🏽", "﻿bom", "a​b é", "²³ ½ Ⅷ ٣", "\x1c\x1d x\x85y z w", "x" * 5000, "aaaaaaaaaaaaaaaaaaaaaa", "=" * 300, "0123456789" * 50, "  leading", "trailing  ", "a \n b", "a 　 b",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids(library, text):
    ids = ENC.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert ENC.automaton.decode(ids).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    t.encode_special_tokens = True
    assert ENC.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_other_vocabulary():
    import tiktoken

    ranks = tk.ranks_of(tk.vocabulary_path(name="byte_bpe_multi_50k"))
    own, other = tk.Encoder(tk.Automaton(ranks)), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in TEXTS:
        assert own.encode(t) == other.encode_ordinary(t)


def test_rows(spark, sf, library):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, " "), (4, " ")], "doc_id long, text string")
    got = sorted((r.doc_id, r.ids) for r in tk.encode_texts(df, "doc_id", "text", tk.vocabulary_path()).collect())
    assert got == [(1, [64, 275]), (2, []), (3, []), (4, [220]), (4, [220])]
    back = {r.doc_id: r.text for r in tk.decode_texts(tk.encode_texts(df, "doc_id", "text", tk.vocabulary_path()), "doc_id", tk.vocabulary_path()).collect()}
    assert back == {1: "a b", 2: "", 3: "", 4: " "}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in tk.p8_ids(spark, sf).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_arcs_are_those_of_the_merges():
    import random

    import tiktoken

    ranks = tk.ranks_of(tk.vocabulary_path())
    a = ENC.automaton
    core = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng, kept = random.Random(5), sorted(i for i in a.texts if a.number[i] >= 0)
    ascii_ = [i for i in kept if a.texts[i].isascii() and len(a.texts[i]) < 6]
    seen = set()
    for _ in range(4000):
        u, v = rng.choice(ascii_), rng.choice(ascii_)
        joined = core.encode_ordinary((a.texts[u] + a.texts[v]).decode())
        assert a.allowed(u, v) == (joined == [u, v])
        seen.add(joined == [u, v])
    assert seen == {True, False}
    for w, (u, v) in list(a.merges.items())[::50]:
        assert not a.allowed(u, v) and a.texts[u] + a.texts[v] == a.texts[w]


def test_a_small_vocabulary_of_repeated_letters():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaaa": 257, b"ab": 258, b"aab": 259}
    a = tk.Automaton(ranks)

    def merged(word):
        parts = [bytes([c]) for c in word]
        while True:
            best = min(((ranks[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if best is None:
                return tuple(ranks[p] for p in parts)
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    import itertools

    for n in range(1, 9):
        for w in itertools.product(b"ab", repeat=n):
            assert a.encode(bytes(w)) == merged(bytes(w))
