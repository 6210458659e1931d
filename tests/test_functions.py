"""Splitting, text functions, classifiers, predicates and readers on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import classify as C
from loomspan.functions import dialect as D
from loomspan.functions import people as N
from loomspan.functions import splitting as S
from loomspan.functions import text as T
from loomspan.operators import predicates as P
from loomspan.sources import files as FI
from loomspan.sources import transcripts as TR


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_smart_split():
    assert S.smart_split("") == [] and S.smart_split("  ") == []
    text = "A first one. " * 200
    parts = S.smart_split(text)
    assert all(800 <= len(p) <= 1200 for p in parts[:-1]) and all(p.endswith(".") for p in parts)
    assert "".join(parts).replace(" ", "") == text.replace(" ", "")
    assert [len(p) for p in S.smart_split("x" * 3000)] == [1200, 1200, 600]
    code = "intro\n```\n" + "line of code\n" * 200 + "```\nafter"
    assert any(p.count("```") == 2 and len(p) > 1200 for p in S.smart_split(code))
    with pytest.raises(ValueError):
        S.smart_split("x", 0, 10)
    with pytest.raises(ValueError):
        S.smart_split("x", 20, 10)


def test_exchanges_and_paragraphs():
    assert S.exchanges("intro\n> q1\na1\n\n> q2\n---\nlost\n> q3") == ["> q1\n\na1", "> q2", "> q3"]
    assert S.paragraphs("short\n\n" + "y" * 900) == ["y" * 800, "y" * 100]
    assert len(S.paragraphs("\n".join(f"this is line {i}" for i in range(60)))) == 3
    assert S.paragraphs("") == []


def test_chunk_rows(spark):
    log = "\n".join(f"2025-01-01 10:00:{i:02d} x" for i in range(20))
    df = spark.createDataFrame([(1, "Some prose that is long enough to be kept as one piece. " * 3), (2, log), (3, None), (4, ""), (5, "tiny")], "k int, t string")
    assert {r.k for r in S.chunk_files(df, ["k"], "t").collect()} == {1}
    talk = "> one question here please tell me\nan answer that is long\n> two is another question here\nmore\n> three question with words\nyes"
    got = S.chunk_conversations(spark.createDataFrame([(1, talk)], "k int, t string"), ["k"], "t").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == [0, 1, 2] and got[0].content.startswith("> one")


def test_lines(spark):
    assert one(spark, "a\n[7] b\nc", T.numbered_lines) == "[1] a\n[7] b\n[3] c"
    assert one(spark, None, T.numbered_lines) == "" == one(spark, "", T.numbered_lines)
    part = lambda a, b: lambda c: T.line_range(c, a, b)
    assert one(spark, "a\nb\nc", part(2, 9)) == "[2] b\n[3] c" and one(spark, "a", part(3, 5)) == "" == one(spark, "a\nb", part(2, 1)) and one(spark, "a\nb", part(-3, 1)) == "[1] a"


def test_noise(spark):
    assert one(spark, "<system-reminder>x\ny</system-reminder>\nkeep", T.strip_noise) == "keep"
    assert one(spark, "<system-reminder>x\n\nkeep</b>", T.strip_noise) == "<system-reminder>x\n\nkeep</b>"
    assert one(spark, "a\nRan 2 Stop hooks\nb [12 tokens] (ctrl+o to expand)", T.strip_noise) == "a\nb"
    for t, expected in [(None, True), (" ", True), ("plain words", False), ("INFO:a\nERROR:b\nword", False), ("INFO:a\nERROR:b\nDEBUG:c\nword", True), ('{"a": 1}\n{"b": 2}\nx', True), ("[truncated, 99 chars]", True), ("1: a\n2+ b\n3- c", True), ("→ a\n→ b\nc", True), ("x → a → b → c → d → e → f → g", True)]:
        assert one(spark, t, T.is_noise) == expected, t


def test_sanitize_query():
    assert T.sanitize_query(None) == ("", "passthrough") and T.sanitize_query(" short one ") == ("short one", "passthrough")
    long = "You are a helper. " * 30
    assert T.sanitize_query(long + "\nWhere did the amber lantern go?") == ("Where did the amber lantern go?", "question_extraction")
    assert T.sanitize_query(long + "\n\"find the lantern notes\"") == ("find the lantern notes", "tail_sentence")
    assert T.sanitize_query("x" * 600)[1] == "tail_sentence" and len(T.sanitize_query("x" * 600)[0]) == 250


def test_classes(spark):
    assert one(spark, "we love the database and the api server", C.hall) == "technical"
    assert one(spark, None, C.hall) == "general" == one(spark, "zzz", C.topic)
    assert one(spark, "happy code", C.hall) == "emotions"  # a tie goes to the first
    df = spark.createDataFrame([("We decided to go because of the framework.",), ("The bug, the crash and the error are resolved.",), ("Nothing here.",), (None,)], "s string")
    assert [r.memory_type for r in C.with_memory(df.coalesce(1), "s").collect()] == ["decision", "milestone", None, None]
    assert one(spark, "Ann is Bob's sister and Eve's brother is Max.", C.claims) == [("Ann", "sister", "Bob"), ("Max", "brother", "Eve")]
    assert one(spark, "a→d1,d2\nb→d2,d3", C.pointers) == ["d1", "d2", "d3"]
    packed = spark.createDataFrame([(["a" * 900, "b" * 500, "c" * 200, "d" * 2000, "e"],)], "x array<string>").select(C.pack(F.col("x")).alias("r")).first().r
    assert [len(p) for p in packed] == [1401, 200, 2000, 1]


def test_segments_and_prose(spark):
    assert one(spark, "> a\nb\nUser: c\nAI: d", C.segments) == ["> a\nb", "User: c", "AI: d"]
    assert one(spark, "p1\n\n\n\np2", C.segments) == ["p1", "p2"]
    assert len(one(spark, "\n".join(f"l{i}" for i in range(51)), C.segments)) == 3
    assert one(spark, "words here\n```\ncode\n```\nimport x\nmore words", C.prose) == "words here\nmore words"
    assert one(spark, "import x", C.prose) == "import x"


def test_dialect(spark):
    df = spark.createDataFrame([("Yesterday Alice decided on the GraphQL database because of hope.", "w", None, "/a/b.md"), (None, None, None, None)], "t string, wing string, room string, source string")
    got = [r.summary for r in D.with_summary(df.coalesce(1), "t", "wing", "room", "source").collect()]
    assert got[0].split("\n")[0] == "w|?|?|b" and got[0].split("\n")[1].startswith("0:ALI|graphql_") and got[0].endswith("determ+hope|DECISION+TECHNICAL")
    assert got[1] == "0:???|misc"
    assert D.top_words("Foo foo bar") == ["foo", "bar"] and D.top_words(None) == []
    assert spark.range(1).select(D.encode_emotions(F.array(F.lit("joy"), F.lit("joyful"), F.lit("zeal_x"))).alias("r")).first().r == "joy+zeal"


def test_people(spark):
    texts = spark.createDataFrame([("Alice said hello. Hey Alice, thanks Alice!\nShe smiled. Alice wrote it.",), ("We deployed Lumen. The Lumen pipeline runs. Lumen-v2 and Lumen.py",), (None,)], "text string")
    names = N.candidates(texts, ["the", "we"])
    assert {(r.name, r.n) for r in names.collect()} == {("Alice", 4), ("Lumen", 4)}
    got = {r.name: (r.type, r.confidence) for r in N.classified(N.scored(names, texts)).collect()}
    assert got["Alice"][0] == "person" and got["Lumen"][0] == "project"
    said = N.sayings('My father always said "measure twice". Dad told me \'never trust a smile\'. Her mother left.')
    assert [(r, q, c) for _, r, q, c, _ in said] == [("father", "measure twice", 0.75), ("dad", "never trust a smile", 0.75), ("mother", None, 0.4)]


def test_predicates(spark):
    df = spark.createDataFrame([("1", "a", 1), ("2", None, 5), ("3", "b", None)], "id string, wing string, n int")
    ids = lambda w: [r.id for r in df.filter(P.where_column(w)).orderBy("id").collect()]
    assert ids(None) == ids({}) == ["1", "2", "3"]
    assert ids({"wing": "a"}) == ["1"] and ids({"wing": {"$ne": "a"}}) == ["2", "3"] and ids({"wing": {"$nin": ["a"]}}) == ["2", "3"]
    assert ids({"n": {"$gte": 1, "$lt": 5}}) == ["1"] and ids({"$or": [{"wing": "b"}, {"n": {"$gt": 4}}]}) == ["2", "3"] and ids({"wing": {"$contains": "b"}}) == ["3"] and ids({"wing": None}) == ["2"]
    for bad in ({"n": {"$regex": "x"}}, {"$not": [{"n": 1}]}, {"$and": []}, {"n": {}}):
        with pytest.raises(P.UnsupportedFilter):
            P.where_column(bad)
    assert P.scope("w", "") == {"wing": "w"} and P.scope("w", "r") == {"$and": [{"wing": "w"}, {"room": "r"}]}
    assert [r.id for r in P.get(df, where={"n": {"$gte": 0}}, limit=1, offset=1, include=["n"]).collect()] == ["2"]


def test_transcript_formats():
    u, a = {"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}
    assert TR.normalise(json.dumps([u, a])) == ("message_exports", "> hi\nyo\n")
    assert TR.normalise(json.dumps([{"chat_messages": [{"sender": "human", "text": "q"}, {"sender": "ai", "text": "r"}]}]))[0] == "message_exports"
    tree = {"mapping": {"r": {"parent": None, "message": None, "children": ["x"]}, "x": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["q"]}}, "children": ["y", "z"]}, "y": {"parent": "x", "message": {"author": {"role": "assistant"}, "content": {"parts": ["r"]}}, "children": []}}}
    assert TR.normalise(json.dumps(tree)) == ("mapping_exports", "> q\nr\n")
    slack = [{"type": "message", "user": "A", "text": "x"}, {"type": "message", "user": "B", "text": "y"}, {"type": "join"}]
    assert TR.normalise(json.dumps(slack)) == ("channel_exports", "> [A] x\n[B] y\n")
    codex = [{"type": "session_meta"}, {"type": "event_msg", "payload": {"type": "user_message", "message": "q"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "r"}}]
    lines = lambda rows: "\n".join(map(json.dumps, rows)) + "\n{broken"
    assert TR.normalise(lines(codex))[0] == "event_sessions" and TR.event_sessions(lines(codex[1:])) is None
    gem = [{"type": "user", "content": [{"text": "early"}]}, {"type": "session_metadata"}, {"type": "user", "content": [{"text": "q"}]}, {"type": "gemini", "content": [{"text": "r"}, {"text": "s"}]}]
    assert TR.normalise(lines(gem)) == ("block_sessions", "> q\nr\ns\n")
    code = [{"type": "user", "message": {"content": "do it"}}, {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "1", "name": "Bash", "input": {"command": "ls"}}]}}, {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": "a\nb"}]}}, {"type": "assistant", "message": {"content": "done"}}]
    assert TR.normalise(lines(code)) == ("assistant_sessions", "> do it\n[Bash] ls\n→ a\n→ b\ndone\n")
    for plain in ("", None, "text only", "{not json", "[]", "> a\n> b\n> c"):
        assert TR.normalise(plain)[1] == (plain or "")


def test_tool_output():
    long = "\n".join(map(str, range(100)))
    assert TR.tool_output(long, "Bash").split("\n")[20] == "→ ... [60 lines omitted] ..." and len(TR.tool_output(long, "Bash").split("\n")) == 41
    assert TR.tool_output(long, "Grep").endswith("→ ... [80 more matches]") and TR.tool_output("x", "Read") == "" == TR.tool_output(None, "Bash")
    assert TR.tool_output("y" * 3000, "Other").endswith("... [truncated, 3000 chars]")
    assert TR.tool_call({"name": "Read", "input": {"file_path": "f", "offset": 5, "limit": 10}}) == "[Read f:5-15]"


def test_sessions():
    part = lambda n: ["Claude Code v1\n", "> write the parser now\n", f"⏺ 9:0{n} AM Monday, March 3, 2025\n"] + ["line\n"] * 10
    text = "".join(part(1) + part(2) + ["Claude Code v1\n", "previous messages\n"] + ["x\n"] * 3)
    got = TR.sessions(text, ["Ann"])
    assert [(n, name) for n, name, _ in got] == [(1, "2025-03-03_901AM_unknown_write-the-parser-now"), (2, "2025-03-03_902AM_unknown_write-the-parser-now")]
    assert TR.sessions("".join(part(1))) == [] and TR.sessions("") == []


def test_ignore_rules():
    rules = FI.rule_patterns(["# c", "*.log", "!keep.log", "build/", "/top.txt", "a/**/z.md", "docs/*.md"])
    is_ = lambda p: FI.is_ignored(p, rules)
    assert is_("x.log") and is_("d/x.log") and not is_("d/keep.log") and is_("build/x.py") and is_("d/build/y/z.py") and not is_("build")
    assert is_("top.txt") and not is_("d/top.txt") and is_("a/z.md") and is_("a/b/c/z.md") and is_("docs/x.md") and not is_("docs/d/x.md")


def test_files(spark, tmp_path):
    (tmp_path / "sub" / "node_modules").mkdir(parents=True)
    for name, body in {"a.md": b"hello", "b.log.md": "caf\xe9".encode("cp1252"), "sub/c.txt": "﻿é".encode(), "sub/node_modules/d.md": b"x", "e.bin": b"x", "f.meta.json": b"{}", "g.md": b""}.items():
        (tmp_path / name).write_bytes(body)
    files = FI.scan(spark, str(tmp_path), [".md", ".txt", ".json"], rules=["b.*"])
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.status) for r in FI.texts(files).collect()}
    assert got == {"a.md": ("hello", "ok"), "c.txt": ("é", "ok")}
    assert FI.decode("caf\xe9".encode("cp1252")) == "café" and FI.decode(None) is None
    assert FI.extract("x.docx", b"junk") == ("", "corrupt") and FI.extract("x.rtf", rb"{\rtf1 Hi \'e9\par there}") == ("Hi é\nthere", "ok")
