"""Rooms, projects, registry, corrections, notes, preferences and evaluation modes."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import dialect as D
from loomspan.functions import text as T
from loomspan.operators import discovery as X
from loomspan.operators import evaluation as E


def test_rooms(spark):
    df = spark.createDataFrame([(p,) for p in ("src/api/a.py", "Front-End/x.ts", "node_modules/y.js", "My Notes/z.md", "ab/q.md", "top.md")], "relative string")
    assert {(r.room, r.folder) for r in X.rooms_from_folders(df).collect()} == {("src", "src"), ("backend", "api"), ("frontend", "Front-End"), ("my_notes", "My Notes"), ("general", None)}
    files = spark.createDataFrame([(p,) for p in ("a/budget-1.md", "b/cost.md", "c/team.md", "dist/cost.md")], "relative string")
    assert [(r.room, r.n) for r in X.rooms_from_files(files).collect()] == [("costs", 2)]
    s = spark.createDataFrame([(p,) for p in ("/p/-home-me-alpha/1.jsonl", "/p/-home-me-alpha/2.jsonl", "/q/-x-alpha/1.jsonl", "/p/-b-beta/1.jsonl", "/p/other/1.jsonl", "/p/-b-beta/n.txt")], "path string")
    assert [(r.project, r.sessions) for r in X.session_projects(s).collect()] == [("alpha", 2), ("beta", 1)]


def test_candidates_and_registry(spark):
    schema = "name string, type string, confidence double, n long"
    a = spark.createDataFrame([("Lumen", "project", 0.9, 5)], schema)
    b = spark.createDataFrame([("lumen", "project", 0.5, 2), ("Ann", "person", 0.8, 3), ("Odd", "uncertain", 0.4, 9)], schema)
    assert {r.name for r in X.merged_candidates(a, b).collect()} == {"Lumen", "Ann", "Odd"} and {r.name for r in X.merged_candidates(a, b, True).collect()} == {"Lumen", "Ann"}
    many = spark.createDataFrame([(f"n{i:02d}", "uncertain", 0.5, i) for i in range(20)], schema)
    assert [r.name for r in X.listed_candidates(many).orderBy("rank").collect()] == [f"n{i:02d}" for i in range(19, 11, -1)]
    reg = spark.createDataFrame([("Grace", "Gracie", "person", 1.0, True), ("Lumen", None, "project", 1.0, False)], "name string, alias string, type string, confidence double, ambiguous boolean")
    words = spark.createDataFrame([("grace", "Then Grace said hello"), ("Grace", "the grace of the dance"), ("GRACIE", ""), ("lumen", None), ("other", "x")], "word string, context string")
    got = [(r.word, r.type, r.confidence) for r in X.looked_up(words, reg).collect()]
    assert sorted(got) == sorted([("grace", "person", 0.8), ("Grace", "concept", 0.8), ("GRACIE", "person", 1.0), ("lumen", "project", 1.0), ("other", "unknown", 0.0)])


def test_corrections():
    speller = {"freind": "friend", "cohrently": "coherently", "zzzz": "unrelatedword", "lumen": "lemon"}.get
    fix = lambda t: X.corrected(t, lambda w: speller(w, w), frozenset({"lumen"}))
    assert fix("My freind,  cohrently\nzzzz lumen Freind fre1nd my_freind") == "My friend,  coherently\nzzzz lumen Freind fre1nd my_freind"
    assert fix("") == ""


def test_model_closets(spark):
    rows = [(f"d{i:03d}", "s" if i < 130 else None, i, f"text {i}", "E") for i in range(131)]
    df = spark.createDataFrame(rows, "id string, source_file string, chunk_index int, content string, entities string")
    got = X.closets_by_model(df, lambda t: {"topics": [str(t.count("text"))], "summary": "S" * 300}).collect()
    assert sorted(r.lines[0].split("|")[0] for r in got) == ["1", "30", "50", "50"] and all(len(r.lines[1].split("|")[0]) == 200 for r in got)


def test_notes(spark):
    note = {"id": "z-7", "people": ["Alice", "Gandalf"], "topics": ["a", "b", "c"], "content": 'She said "I love the quiet harbour"', "emotional_tone": ["joy", "zealous"], "notes": "a core pivot", "origin_moment": True}
    line = D.note_line(note, {"Alice": "ALC"}, ("gandalf",))
    assert line == '7:ALC|a_b|"I love the quiet harbour"|0.5|joy+zeal|ORIGIN+CORE+PIVOT'
    doc = {"source_file": "012-The Story.txt", "zettels": [note], "tunnels": [{"from": "z-1", "to": "z-2", "label": "because: x"}], "emotional_arc": "up"}
    text = D.encode_notes(doc)
    back = D.decode_notes(text)
    assert back["header"]["title"] == "The Story" and back["arc"] == "up" and back["links"] == ["T:1<->2|because"] and len(back["notes"]) == 1
    df = spark.createDataFrame([("a", json.dumps(doc)), ("b", "{broken"), ("c", None)], "path string, text string")
    assert [(r.path, r.summary) for r in D.encoded_notes(df).collect()] == [("a", text)]
    assert D.key_quote({"title": "x - the rest"}) == "the rest" and D.key_quote({}) == ""


def test_transformations(spark):
    assert len(T.TRANSFORMATIONS) == 13
    df = spark.createDataFrame([(" a \r\n\r\n b ",)], "t string")
    assert df.select(T.transformed(F.col("t"), ["newline_normalize", "line_trim", "blank_line_drop", "spellcheck_user"]).alias("r")).first().r == "a\nb"
    with pytest.raises(ValueError):
        T.transformed(F.col("t"), ["nope"])


def test_modes(spark):
    turns = spark.createDataFrame([("s", 0, "user", "I prefer green tea, always. I've been feeling tired lately."), ("s", 1, "assistant", "i prefer nothing"), ("s", 2, "user", "i prefer green tea!"), ("t", 0, "user", "hello"), ("u", 0, "user", None)], "session_id string, turn int, role string, content string")
    assert [tuple(r) for r in E.preference_documents(turns).collect()] == [("s", "User has mentioned: tired lately; green tea")]
    assert {r.session_id: r.text for r in E.session_texts(turns).collect()}["s"].count("\n") == 1
    q = spark.createDataFrame([("What did you suggest, can you remind me",), ("where is it",), (None,)], "q string")
    assert [r.a for r in q.coalesce(1).select(E.asks_assistant(F.col("q")).alias("a")).collect()] == [True, False, False]
    scored = spark.createDataFrame([(1, 10, "s", 0.5), (1, 11, "s", 0.4), (1, 12, "t", 0.45)], "query_id int, vec_id int, session_id string, fused double")
    best = E.best_per_session(scored)
    assert [(r.vec_id, r["rank"]) for r in best.orderBy("rank").collect()] == [(11, 1), (12, 2)]
    targets = spark.createDataFrame([(1, 12), (2, 12)], "query_id int, vec_id int")
    assert {r.query_id: r.hit for r in E.hit_at(best, targets, 1, "vec_id").collect()} == {1: False, 2: False} and {r.query_id: r.hit for r in E.hit_at(best, targets, 2, "vec_id").collect()} == {1: True, 2: False}
    f = spark.range(1).select(E.hall_fusion(F.lit(1.0), F.lit("b"), F.array(F.lit("a"), F.lit("b")), F.lit(True)).alias("x"), E.hall_fusion(F.lit(1.0), F.lit("a"), F.array(F.lit("a"))).alias("y")).first()
    assert f.x == pytest.approx(0.765) and f.y == 0.75
