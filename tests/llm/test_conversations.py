import random

from loomspan.llm import conversations as cv

SCHEMA = "conversation_id string, message_id string, parent string, position int, role string, at long, text string"


def both(spark, rows, linked):
    df = spark.createDataFrame(rows, SCHEMA)
    short = sorted(map(tuple, cv.rebuild(df, linked).collect()))
    long = sorted(map(tuple, cv._long(df.drop("text"), linked).collect()))
    mixed = sorted(map(tuple, cv.rebuild(df, linked, most_rows=5).collect()))
    assert short == long == mixed
    return short


def chain(conv, roles, start=0):
    return [(conv, f"{conv}{i}", f"{conv}{i - 1}" if i else None, None, r, start + i, "x") for i, r in enumerate(roles)]


def test_links(spark):
    u, a = "user", "assistant"
    rows = chain("ok", [u, a, None, u, a, a]) + chain("noreply", [u, a, u]) + chain("wrongstart", [a, u, a]) + chain("twice", [u, u, a]) + chain("silent", [None, None])
    rows += [r for r in chain("hole", [u, a, u, a]) if r[1] != "hole1"]
    rows += chain("roots", [u, a]) + [("roots", "extra", None, None, u, 9, "x")]
    rows += chain("circle", [u, a]) + [("circle", "c1", "c2", None, u, 9, "x"), ("circle", "c2", "c1", None, a, 9, "x")]
    rows += chain("late", [u, a]) + [("late", "late1", "late0", None, a, 99, "x"), ("late", "late1", "late0", None, a, None, "x")]
    rows += [("tree", "t0", None, None, u, 1, "x"), ("tree", "t1", "t0", None, a, 5, "x"), ("tree", "t2", "t0", None, a, 2, "x")]
    got = both(spark, rows, True)
    assert got == [("late", 0, "late0"), ("late", 1, "late1"), *[("ok", i, f"ok{m}") for i, m in enumerate([0, 1, 3, 4, 5])], ("tree", 0, "t0"), ("tree", 1, "t2"), ("tree", 2, "t1")]


def test_positions(spark):
    place = lambda conv, items: [(conv, f"{conv}{i}", None, p, r, i, "x") for i, (p, r) in enumerate(items)]
    rows = place("ok", [(1, "assistant"), (0, "user"), (2, None)]) + place("hole", [(0, "user"), (2, "assistant")]) + place("same", [(0, "user"), (0, "assistant")]) + place("none", [(None, "user"), (0, "user")]) + place("one", [(1, "user"), (2, "assistant")])
    assert both(spark, rows, False) == [("ok", 0, "ok1"), ("ok", 1, "ok0")]


def test_long_conversation(spark):
    n = 9000
    rows = [("big", f"m{i:05d}", f"m{i - 1:05d}" if i else None, None, "user" if i % 2 == 0 else "assistant", i, "x") for i in range(n)]
    random.Random(1).shuffle(rows)
    got = cv._long(spark.createDataFrame(rows, SCHEMA).drop("text"), True).collect()
    assert sorted((r.turn, r.message_id) for r in got) == [(i, f"m{i:05d}") for i in range(n)]


def test_empty_and_nulls(spark):
    assert both(spark, [], True) == [] and both(spark, [], False) == []
    assert cv.rebuild(spark.createDataFrame([(None, "a", None, 0, "user", 1, "x"), ("c", None, None, 0, "user", 1, "x")], SCHEMA), True).collect() == []


def test_one_first_row_with_many_replies(spark, monkeypatch):
    """A star is ordered in ranges, none of which holds it whole."""
    monkeypatch.setattr(cv, "BLOCK", 50)
    rows = [("star", "r", None, None, "user", 0, "x")] + [("star", f"m{i:04d}", "r", None, "assistant", i % 97, "x") for i in range(400)]
    events = spark.createDataFrame(rows, "conversation_id string, message_id string, parent string, position int, role string, at long, text string")
    whole = sorted(tuple(r) for r in cv.rebuild(events, True).collect())
    assert len(whole) == 401 and whole == sorted(tuple(r) for r in cv.rebuild(events, True, most_rows=10).collect())
