import numpy as np

from loomspan.llm import quality as q

TABLE = "\n".join(f"| {i} | {i * 7 % 90} | {i * 3.5} | x{i} |" for i in range(20))
LOG = "\n".join(f"2025-06-12T07:22:{i:02d} WARN [abc] k={i} v=0x{i:04x}" for i in range(20))
PROSE = "The garden was quiet, and the old gate creaked when she opened it. Nobody had been here since the winter.\n" * 6
LIST = "\n".join(f"- [ ] item {w}" for w in "alpha beta gamma delta epsilon zeta eta theta iota".split() * 2)


def test_features():
    raw, chars, text_of = q.line_features(["", "  \n", "one two\n\n| 1 | 2 |", "x"])
    assert text_of.tolist() == [2, 2, 3] and chars.tolist() == [6, 5, 1]
    f = dict(zip(q.FEATURES, raw.T))
    assert f["digits"].tolist() == [0, 2 / 5, 0] and f["marker"].tolist() == [0, 0, 0]
    assert q.line_features([])[0].shape == (0, len(q.FEATURES))
    common = dict(zip(q.FEATURES, q.line_features(["the and xylograph"])[0].T))["common"]
    assert common.tolist() == [2 / 3]


def test_parts_sum_up():
    texts = [PROSE, TABLE, LOG, "\r\n".join(PROSE.split("\n")), "漢字 " * 50, "🙏", "﻿x"]
    whole = q.line_features(texts)[0]
    assert np.allclose(whole, np.concatenate([q.line_features([t])[0] for t in texts]))
    assert np.isfinite(whole).all()


def test_held_out_accuracy(spark):
    rows = q.labelled_sample(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "doc_labels")), most=100_000)
    rows = [(t, k) for t, k in rows if t.strip()]
    train, test = rows[::2], rows[1::2]
    m = q.train([t for t, _ in train], [k for _, k in train])
    raw, chars, text_of = q.line_features([t for t, _ in test])
    other = q.shares(m.responsibilities(raw), chars, text_of, len(test)) @ m.other > 0.5
    truth = np.array([k != "prose" for _, k in test])
    assert (other == truth).mean() >= 0.97


def test_rows(spark):
    m = q.train([PROSE, PROSE * 2, TABLE, LOG, LIST, "yes, thanks"], ["prose", "prose", "table", "log", "list", "prose"])
    df = spark.createDataFrame([(1, PROSE), (2, TABLE), (3, None), (4, ""), (5, " \n"), (6, TABLE + "\n" + PROSE), (2, TABLE), (7, "ok")], "doc_id long, text string")
    got = sorted((r.doc_id, r.kind != "prose") for r in q.classify(df, m).collect())
    assert got == [(1, False), (2, True), (2, True), (6, False), (7, False)]
    none = q.train([], [])
    assert {r.kind for r in q.classify(df, none).collect()} == {"prose"}
    assert q.classify(df.limit(0), m).collect() == []


def test_mixture_is_bounded_and_repeatable():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 4)), rng.normal(6, 1, (300, 4))])
    a, b = (q.fit_mixture(x, np.ones(len(x)), 4, 20) for _ in range(2))
    assert all(np.allclose(p, r) for p, r in zip(a, b))
    assert len(q.fit_mixture(x[:2], np.ones(2), 10, 5)[2]) == 2
