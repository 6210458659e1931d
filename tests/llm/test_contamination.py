import random
import re

import numpy as np
import pytest
from pyspark.sql import Row

from loomspan.llm import contamination as c


def plain(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = set()
    for d, t in docs:
        for i, q in items:
            if t and q:
                a, b = words(t), words(q)
                k = min(12, len(b))
                if k and any(a[x : x + k] == b[y : y + k] for x in range(len(a) - k + 1) for y in range(len(b) - k + 1)):
                    out.add((d, i))
    return out


def made(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, text(rng.choice([9, 12, 30, 60]))) for i in range(25)]
    docs = []
    for d in range(150):
        own = text(rng.randint(0, 120))
        if rng.random() < 0.6:
            _, q = rng.choice(items)
            n = rng.choice([5, 11, 12, 13, 40])
            at = rng.randrange(max(1, len(q) - n + 1))
            part = [w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", ".\n", " -- ", "…"]) for w in q[at : at + n]]
            own[len(own) // 2 : len(own) // 2] = part
        docs.append((d, " ".join(own)))
    return docs, [(i, " ".join(q).capitalize() + ".") for i, q in items]


def run(spark, docs, items, **k):
    df = spark.createDataFrame([Row(doc_id=d, text=t) for d, t in docs], "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in c.leaks(df, items, **k).collect()}


def test_against_brute_force(spark):
    docs, items = made()
    docs += [(900, None), (901, ""), (902, " \n "), (903, items[0][1] * 300), (904, items[3][1])]
    items += [(90, None), (91, ""), (92, "...")]
    assert run(spark, docs, items) == plain(docs, items)


def test_edits(spark):
    item = [(1, "the amber lantern keeps its silent watch over every sleeping harbour town tonight")]
    near = "so the amber lantern keeps its silnt watch over every sleeping harbour town tonight ok"
    far = "so the amber lanterns keeps its silnt watch oer every sleepng harbour town tonight ok"
    assert run(spark, [(1, near), (2, far)], item) == set()
    assert run(spark, [(1, near), (2, far)], item, edits=1, q=13) == {(1, 1)}


@pytest.mark.parametrize("most", [0, 1, 2])
def test_distance_in_a_band(most):
    """Against all alignments that stay in the band."""
    rng = random.Random(most)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        at, width = rng.randint(-2, 8), rng.randint(1, 4)
        low, high = at - most, at + width - 1 + most
        far = 99
        d = {(0, k): 0 for k in range(low, high + 1)}
        for i in range(1, len(a) + 1):
            for k in range(low, high + 1):
                j = i - 1 + k
                same = 0 <= j < len(t) and t[j] == a[i - 1]
                d[i, k] = min(d[i - 1, k] + (not same), d.get((i - 1, k + 1), far) + 1, d.get((i, k - 1), far) + 1)
        best = min(d[len(a), k] for k in range(low, high + 1))
        code = lambda x: np.array([ord(c) for c in x], np.uint32)
        got = c.banded_distance(code("xy" + a), np.array([2]), np.array([2 + len(a)]), code(t), np.array([at]), np.array([width]), most)[0]
        assert got == min(best, most + 1)


def test_edited_passages_are_found(spark):
    """Recall of passages with one edited character, which the lemma says is whole."""
    rng = random.Random(11)
    _, items = made()
    docs = []
    for d in range(300):
        i, text = rng.choice(items)
        words = re.findall(r"[^\W_]+", text.lower())
        size = min(12, len(words))
        start = rng.randrange(len(words) - size + 1)
        passage = " ".join(words[start : start + size])
        k = rng.randrange(len(passage))
        edited = rng.choice([passage[:k] + "q" + passage[k + 1 :], passage[:k] + passage[k + 1 :], passage[:k] + "q" + passage[k:]])
        docs.append((d, i, f"Lorem ipsum {edited} dolor."))
    got = run(spark, [(d, t) for d, _, t in docs], items, edits=1)
    assert {(d, i) for d, i, _ in docs} <= got


def test_a_short_item_leaves_the_others_their_filter():
    _, items = made()
    index = c.ItemIndex([*items, (500, "ab")])
    assert sorted(x.q for x in index.classes)[-1] >= 8 and len(index.classes) <= 4
    alone = c.ItemIndex(items)
    text = c._padded("ab " * 5 + "the word ab stands in many texts " * 40)
    of = np.zeros(len(text), np.int64)
    assert {index.ids[i] for i in index.regions(text, of)[:, 1]} <= {500} and not len(alone.regions(text, of))


def test_no_passage_over_two_documents(spark):
    item = [(1, "the amber lantern keeps its silent watch over every sleeping harbour town tonight")]
    first, second = item[0][1].split(" over ")
    assert run(spark, [(1, first + " over"), (2, second)], item, edits=1) == set()


def test_hashes_are_of_q_characters():
    x = c.folded("abcdefghij abcdefghij klmno")
    for q in (1, 2, 3, 5, 8, 10):
        h = c.qgram_hashes(x, q)
        assert len(h) == len(x) - q + 1 and h[0] == h[11] and len(set(h.tolist())) > 5
    assert len(c.qgram_hashes(x, 500)) == 0


def test_nothing(spark):
    assert run(spark, [], [(1, "a b c")]) == set() and run(spark, [(1, "a b c")], []) == set()
