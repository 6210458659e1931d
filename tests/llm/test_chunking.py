import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm.chunking import BLANKS, LIMIT, OVERLAP, boundaries, pieces, split_texts


def check(text, limit=LIMIT, overlap=OVERLAP):
    out = pieces(text, limit, overlap)
    assert "".join(text[max(a, out[i - 1][1] if i else 0) : b] for i, (a, b, _) in enumerate(out)) == text
    for i, (a, b, kind) in enumerate(out):
        assert 0 < b - a <= limit
        if i:
            assert 0 <= out[i - 1][1] - a <= overlap and b > out[i - 1][1]
        if kind == "hard":
            # no word end that would have moved on
            ends = boundaries(text)[1]["word"]
            last = out[i - 1][1] if i else 0
            assert not any(max(a + overlap, last) < e <= a + limit for e in ends)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\r\t!?é漢", max_size=400), st.integers(5, 60))
def test_any_text(text, limit):
    check(text, limit, limit // 4)


def test_kinds_and_extremes():
    assert pieces("") == []
    assert pieces("short") == [(0, 5, "end")]
    assert [k for _, _, k in check("a" * 5000)].count("hard") == 4
    paragraphs = "\n\n".join("word " * 100 for _ in range(20))
    assert {k for _, _, k in check(paragraphs)} == {"paragraph", "end"}
    rng = random.Random(2)
    sentence = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(12)) + ". "
    assert {k for _, _, k in check(sentence * 400)} == {"sentence", "end"}
    with pytest.raises(ValueError):
        pieces("x" * 50, 10, 10)


def test_rows(spark):
    rows = [("a", None), ("b", ""), ("c", " \n "), ("d", "x" * 1200 + " \n"), ("e", "y " * 900), ("e", "y " * 900), (None, "z " * 700)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, content string, piece int")
    got = split_texts(df, ["id"], "content").collect()
    assert {r.id for r in got} == {"e", None}
    assert sorted(r.chunk_index for r in got if r.id is None) == [0, 1]
    assert len([r for r in got if r.id == "e"]) == 4
    assert split_texts(df.limit(0), ["id"], "content").collect() == []
    assert all(r.piece == ("y " * 900).strip(BLANKS)[r.start : r.end] for r in got if r.id == "e")
