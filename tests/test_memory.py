"""The store's operations end to end."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomspan.memory import InvalidArgument, Memory


def letters(df):
    """Counts of eight letters as a vector."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return df.withColumn("embedding", F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in "aeiounst"]))


def test_records_and_search(spark, tmp_path):
    m = Memory(spark, str(tmp_path), letters)
    assert m.status().collect() == [] and m.list_drawers().collect() == []
    assert m.add_drawer("w", "diary", "the amber lantern hangs in the old harbour", "/v/a.md") == 1
    assert m.add_drawer("w", "diary", "the amber lantern hangs in the old harbour", "/v/a.md") == 0
    assert m.add_drawer("w", "notes", "z" * 1700, "/v/b.md") == 3 and m.add_drawer("u", "notes", "quiet unison of tuesdays", "/v/c.md") == 1
    for bad in (("", "r", "x"), ("a/b", "r", "x"), ("w", "r", " "), ("w", "r", "x" * 100_001)):
        with pytest.raises(InvalidArgument):
            m.add_drawer(*bad)
    assert {(r.wing, r.n) for r in m.list_wings().collect()} == {("w", 4), ("u", 1)} and {r.room for r in m.list_rooms("u").collect()} == {"notes"}
    assert m.taxonomy().filter("wing = 'w'").first().rooms == {"diary": 1, "notes": 3}
    hit = m.search("Where does the amber lantern hang?", limit=1).first()
    assert m.get_drawer(hit.id).first().source_file == "a.md"
    assert m.search("lantern", vector_disabled=True).first().id == hit.id and m.search("zzz missing", wing="u", vector_disabled=True).collect() == []
    assert [r.similarity for r in m.check_duplicate("quiet unison of tuesdays").collect()][0] == 1.0
    for bad in (lambda: m.search(" "), lambda: m.search("x", strategy="odd"), lambda: m.get(colour=1)):
        with pytest.raises(InvalidArgument):
            bad()
    m.update_drawer(hit.id, room="moved")
    m.update_drawer(hit.id, room=None)
    assert m.get_drawer(hit.id).first().room == "moved" and m.list_drawers("w", limit=2).first().total == 4
    live = spark.createDataFrame([("/v/a.md",)], "source_file string")
    assert {r.bucket: r.n for r in m.sync(["/v"], live).collect()} == {"kept": 1, "missing": 4}
    m.sync(["/v"], live, apply=True)
    assert [r.id for r in m.table("drawers").collect()] == [hit.id] and "amber lantern" in m.wake_up() and m.recall("w").count() == 1
    m.delete_drawer(hit.id)
    assert m.table("drawers").count() == 0 and "No memories" in m.wake_up()


def test_facts_graph_and_diary(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    assert m.kg_add("Alice", "works at", "Acme", "2020-01-01") == 1 and m.kg_add("Alice", "works at", "Acme") == 0
    assert [r.object for r in m.kg_query("Alice", "2021-01-01").collect()] == ["Acme"] and m.kg_query("Alice", "2019-01-01").collect() == []
    m.kg_invalidate("Alice", "works at", "Acme", "2022-01-01")
    assert m.kg_query("Alice", "2023-01-01").collect() == [] and m.kg_stats().first().expired_facts == 1 and m.kg_timeline("Acme").count() == 1
    m.add_drawers(spark.createDataFrame([(w, r, f"{w} {r}", None, "t", "2025-01-01T00:00:00Z") for w, r in (("a", "x"), ("b", "x"), ("b", "y"))], "wing string, room string, content string, source_file string, added_by string, filed_at string"))
    assert [r.room for r in m.traverse("x").collect()] == ["x", "y"] and m.find_tunnels("a", "b").count() == 1 and m.graph_stats().first().total_rooms == 2
    one, two = m.create_tunnel("a", "x", "b", "y", "l"), m.create_tunnel("b", "y", "a", "x", "again")
    assert one == two and m.list_tunnels("A").count() == 1 and m.follow_tunnels("a", "x").first().connected_room in ("x", "y")
    with pytest.raises(InvalidArgument):
        m.create_tunnel("a", "nowhere", "b", "y")
    m.potentiate(spark.createDataFrame([(one, datetime(2030, 1, 1))], "id string, at timestamp"))
    assert m.list_tunnels().first().strength == 1.05 and m.decay_pass("2040-01-01 00:00:00").first().at_floor == 1
    m.write("drawers", m.table("drawers").withColumn("entities", F.lit("P;Q")).unionByName(m.table("drawers").withColumn("entities", F.lit("P;Q"))))
    m.compute_hallways()
    assert m.list_hallways("a").first().n == 2 and m.compute_entity_tunnels() == 2
    m.delete_hallway(m.list_hallways("a").first().id)
    m.delete_tunnel(one)
    assert m.list_hallways("a").count() == 0 and m.list_tunnels().filter("kind = 'explicit'").count() == 0
    assert m.diary_write("Scribe", "w" * 900) == 2 and m.diary_read(" scribe", 1).count() == 1 and m.diary_read("other").count() == 0
