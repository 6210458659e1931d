"""Mining end to end: gate, pieces, purge, sentinels and index lines."""

import pytest

from loomspan.functions.splitting import smart_split
from loomspan.operators import mining
from loomspan.sources import files as sources

STORE = "id string, content string, wing string, room string, source_file string, chunk_index int, added_by string, filed_at string, normalize_version int, source_mtime double, extra string"
ROOMS = [{"name": "plans", "keywords": ["deadline"]}]
LONG = ". ".join(f"Sentence number {i} says something of the deadline that we set" for i in range(60)) + "."


def run(spark, files, stored, **k):
    f = spark.createDataFrame(files, "source_file string, mtime double, text string")
    s = stored if not isinstance(stored, list) else spark.createDataFrame(stored, STORE)
    return mining.mined(f, s, "w", ROOMS, "miner", "2026-01-01", **k)


def rows(df):
    return sorted((r.source_file, r.chunk_index, r.content, r.room) for r in df.collect())


def test_pieces_sentinels_and_purge(spark):
    old = [("o1", "old text", "w", "general", "/a/long.md", 0, "x", "2020", 1, 1.0, "e"), ("o2", "kept", "w", "general", "/a/other.md", 0, "x", "2020", 2, 1.0, "e"), ("o3", "hand", "w", "r", None, 0, "x", "2020", 2, None, None)]
    m = run(spark, [("/a/long.md", 2.0, LONG), ("/a/blank.md", 2.0, " \n"), ("/a/null.md", 2.0, None), ("/a/short.md", 2.0, "tiny"), ("/a/other.md", 1.0, "not read again, as it has not changed since it was filed")], old)
    got = rows(m.added)
    assert [g[2] for g in got if g[0] == "/a/long.md"] == smart_split(LONG) and {g[3] for g in got if g[0] == "/a/long.md"} == {"plans"}
    assert {g[0] for g in got if g[3] == "_registry"} == {"/a/blank.md", "/a/null.md", "/a/short.md"}
    store = {r.id: r for r in m.store.collect()}
    assert "o1" not in store and store["o2"].extra == "e" and "o3" in store and len(store) == 2 + len(got)
    assert all(r.content.strip() for r in m.closets.collect()) and {r.source_file for r in m.closets.collect()} == {"/a/long.md"}


def test_twice_changes_nothing_and_a_change_is_mined(spark):
    files = [("/a/x.md", 1.0, LONG), ("/a/none.md", 1.0, "")]
    first = run(spark, files, [])
    again = run(spark, files, first.store)
    assert again.added.count() == 0 and sorted(r.id for r in again.store.collect()) == sorted(r.id for r in first.store.collect())
    changed = run(spark, [("/a/x.md", 5.0, LONG[:900]), ("/a/none.md", 5.0, LONG[:700])], first.store)
    assert rows(changed.store) == rows(changed.added) and not changed.store.filter("room = '_registry'").count()


def test_empty_repeated_and_unknown(spark):
    assert run(spark, [], []).store.count() == 0
    assert len(rows(run(spark, [("/a/x.md", 1.0, LONG)] * 3, []).added)) == len(smart_split(LONG))
    with pytest.raises(ValueError):
        run(spark, [], [], kind="nothing")


def test_parted(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    good, bad = mining.parted(df, spark.createDataFrame([("a",), (None,)], "id string"))
    assert [r.id for r in good.collect()] == ["a"] and sorted((r.id for r in bad.collect()), key=str) == [None, "b"]


def test_forced_files_are_scanned(spark, tmp_path):
    for p in ("keep.md", "drop.md", "build/out.md", "build/other.md", "node_modules/x.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("text")
    found = lambda **k: sorted(r.relative for r in sources.scan(spark, str(tmp_path), [".md"], rules=["drop.md"], **k).collect())
    assert found() == ["keep.md"]
    assert found(include=["drop.md", "build/out.md", "/node_modules/"]) == ["build/out.md", "drop.md", "keep.md", "node_modules/x.md"]
