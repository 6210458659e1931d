"""Record, graph, fact and retrieval operators on small inputs; streams against batches."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import evaluation as E
from loomspan.operators import facts as K
from loomspan.operators import graph as G
from loomspan.operators import records as R
from loomspan.operators import retrieval as V
from loomspan.sources import store as ST
from loomspan.sources import transcripts as TR
from loomspan.streaming import sweep as X


def vectors(spark, n=200, seed=1, dims=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).round(4)
    x[3] = 0
    x[5] = x[4]
    rows = [(i, v.tolist() if i != 7 else None) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), x


def test_nearest(spark):
    df, x = vectors(spark)
    q = df.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in V.nearest(df, q, 5, block=7).collect()}
    y = x.astype(np.float32).astype(float)
    unit = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    for i in range(0, 200, 10):
        d = np.round(1 - unit @ unit[i], 12)
        order = [j for j in np.lexsort((np.arange(200), d)) if j != 7][:5]
        assert [got[i, k + 1] for k in range(5)] == order
    assert V.nearest(df, q.limit(0), 5).collect() == [] and V.nearest(df.limit(0), q, 5).collect() == []


def test_index_recall_and_near_pairs(spark):
    df, _ = vectors(spark, 600)
    q = df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    assert V.recall(V.nearest_by_lists(df, q, 5, 12), V.nearest(df, q, 5)).first().recall >= 0.9
    pairs = {(r.a, r.b) for r in V.near_pairs(df.withColumn("g", F.lit("s")), "vec_id", "g", 0.15).collect()}
    rows = {r.vec_id: np.array(r.embedding) for r in df.collect() if r.embedding and any(r.embedding)}
    exact = {(a, b) for a in rows for b in rows if a < b and 1 - rows[a] @ rows[b] / np.linalg.norm(rows[a]) / np.linalg.norm(rows[b]) < 0.15}
    assert pairs <= exact and len(pairs) >= 0.97 * len(exact) and (4, 5) in pairs


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "amber lantern lantern"), (2, "amber"), (3, ""), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(9, "Lantern lantern amber"), (8, "nothing here")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.bm25 for r in V.bm25_corpus(docs, q, "doc_id", "text").collect()}
    idf = lambda df: np.log((4 - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 1.0))
    assert set(got) == {(9, 1), (9, 2)}
    assert got[9, 1] == pytest.approx(idf(1) * part(2, 3) + idf(2) * part(1, 3)) and got[9, 2] == pytest.approx(idf(2) * part(1, 1))
    each = docs.crossJoin(q.select("query_id"))
    same = {(r.query_id, r.doc_id): r.bm25 for r in V.bm25(each, q, "doc_id", "text").collect()}
    assert len(same) == 8 and all(same[k] == pytest.approx(v) for k, v in got.items()) and same[8, 1] == 0


def test_boosts_never_hide(spark):
    hits = spark.createDataFrame([(1, 10, "s1", 0.2), (1, 11, "s2", 1.9), (1, 12, None, 0.5)], "query_id long, vec_id long, source string, distance double")
    closets = spark.createDataFrame([(1, "s1", 0.1, 1), (1, "s2", 1.6, 2), (1, "s1", 0.0, 3)], "query_id long, source string, distance double, rank int")
    got = {r.vec_id: (r.boost, round(r.effective, 6)) for r in V.boosted(hits, closets).collect()}
    assert got == {10: (0.4, 0.0), 11: (0.0, 1.9), 12: (0.0, 0.5)}
    with pytest.raises(ValueError):
        V.search(hits, hits, hits, strategy="magic")


def test_facts(spark):
    ts = datetime(2024, 1, 1)
    e = spark.createDataFrame([(i, n, "person", ts) for i, n in (("alice", "Alice"), ("max", "Max"), ("acme", "Acme"), ("newco", "NewCo"))], "id string, name string, type string, created_at timestamp")
    t = spark.createDataFrame([("1", "alice", "works_at", "acme", "2020-01-01", "2024-12-31"), ("2", "alice", "works_at", "newco", "2025-01-01", None), ("3", "alice", "parent_of", "max", "2015-04-01", None), ("4", "max", "likes", "max", None, None)], "id string, subject string, predicate string, object string, valid_from string, valid_to string")
    ask = spark.createDataFrame([("Alice",)], "name string")
    at = lambda d: sorted(r.object for r in K.entity_facts(t, e, ask, "outgoing", d).filter("predicate = 'works_at'").collect())
    assert at("2023-06-01") == ["Acme"] and at("2025-06-01") == ["NewCo"] and at("2024-12-31T23:59:59Z") == ["Acme"] and at("2010-01-01") == []
    assert K.entity_facts(t, e, spark.createDataFrame([("Max",)], "name string"), "both").count() == 3
    closed = K.invalidated(t, "Alice", "works at", "NewCo", "2026-01-01")
    assert {r.id: r.valid_to for r in closed.collect()}["2"] == "2026-01-01"
    with pytest.raises(K.InvertedInterval):
        K.invalidated(t, "Alice", "works_at", "NewCo", "2024-01-01")
    with pytest.raises(ValueError):
        K.entity_facts(t, e, ask, "sideways")
    said = spark.createDataFrame([("x", "Alice is Max's sister."), ("y", None)], "text_id string, text string")
    assert [(r.type, r.recorded) for r in K.contradictions(said, t, e, "2026-01-01").collect()] == [("relationship_mismatch", "parent_of")]


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(250)})
    a, b = names[::3], names
    got = {(r.name, r.other): r.distance for r in K.similar_names(spark.createDataFrame([(x,) for x in a], "name string"), spark.createDataFrame([(x,) for x in b], "name string")).collect()}

    def edit(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    assert got == {(x, y): d for x in a for y in set(b) - set(a) if 1 <= (d := edit(x, y)) <= 2}


def test_dynamics(spark):
    t0 = datetime(2025, 1, 1)
    edges = G.with_dynamics(spark.createDataFrame([("a", t0), ("b", t0)], "id string, created_at timestamp"))
    acc = spark.createDataFrame([("a", datetime(2025, 1, 1, 0, 30)), ("a", datetime(2025, 1, 1, 2)), ("a", datetime(2025, 1, 1, 2, 10)), ("zz", t0)] + [("a", datetime(2025, 2, 1))] * 100, "id string, at timestamp")
    p = {r.id: r for r in G.potentiated(edges, acc).collect()}
    assert p["a"].strength == 5.0 and p["a"].access_count == 103 and round(p["a"].stability, 6) == 1.2 and p["b"].strength == 1.0
    d = lambda days, stab: spark.range(1).select(G.decayed(F.lit(1.0), F.lit(stab), F.lit(t0), F.lit(t0) + F.make_dt_interval(F.lit(days))).alias("d")).first().d
    assert d(1, 1.0) == pytest.approx(np.exp(-1)) and d(9, 1.0) == 0.05 and d(-1, 1.0) == 1.0 and d(1, 0.0) == pytest.approx(np.exp(-1))


def test_graph(spark):
    rows = [(str(i), room, wing, hall, None) for i, (room, wing, hall) in enumerate([("r1", "a", "h"), ("r1", "b", None), ("r2", "b", None), ("r3", "c", None), ("general", "a", "h"), (None, "a", "h"), ("r2", "c", None)])]
    n = G.room_nodes(spark.createDataFrame(rows, "id string, room string, wing string, hall string, date string"))
    assert [(r.room, r.hop) for r in G.walk(n, "r1", 2).collect()] == [("r1", 0), ("r2", 1), ("r3", 2)] and [r.room for r in G.walk(n, "r1", 1).collect()] == ["r1", "r2"]
    assert G.walk(n, "nowhere").collect() == [] and G.room_edges(n).count() == 1 and {r.room for r in G.tunnel_rooms(n).collect()} == {"r1", "r2"}
    rec = spark.createDataFrame([("1", "w", "x", "B; A;B"), ("2", "w", "y", "A;B;C"), ("3", "w", None, "C"), ("4", "v", "x", "A;B"), ("5", "w", "x", None)], "id string, wing string, room string, entities string")
    got = [(r.wing, r.entity_a, r.entity_b, r.n, r.rooms) for r in G.cooccurrences(rec).collect()]
    assert got == [("w", "A", "B", 2, ["x", "y"])]
    tid = lambda a, b: spark.range(1).select(G.tunnel_id(F.lit(a), F.lit("r"), F.lit(b), F.lit("s" if a == "w1" else "r")).alias("i")).first().i
    x = spark.range(1).select(G.tunnel_id(F.lit("w1"), F.lit("r"), F.lit("w2"), F.lit("s")).alias("a"), G.tunnel_id(F.lit("w2"), F.lit("s"), F.lit("w1"), F.lit("r")).alias("b")).first()
    assert x.a == x.b and len(x.a) == 16 and tid("w1", "w2") == x.a
    stored = spark.createDataFrame([], "id string, source_wing string, source_room string, target_wing string, target_room string, label string, kind string, created_at timestamp, updated_at timestamp, strength double, stability double, last_activated timestamp, access_count bigint")
    add = lambda a, b, at: spark.createDataFrame([(a, "r", b, "r", "l", "explicit", at)], "source_wing string, source_room string, target_wing string, target_room string, label string, kind string, at timestamp")
    one = G.upserted_tunnels(stored, add("W 1", "w2", datetime(2025, 1, 1)))
    two = G.upserted_tunnels(one, add("w2", "w-1", datetime(2025, 2, 1)))
    assert [(r.created_at, r.updated_at) for r in two.collect()] == [(datetime(2025, 1, 1), datetime(2025, 2, 1))]
    assert [r.direction for r in G.followed(two, "w_1", "r").collect()] == ["incoming"]


def test_greedy_against_plain(spark):
    rng = random.Random(3)
    docs = [(f"d{i:03d}", f"s{i % 3}", "x" * rng.randint(5, 60)) for i in range(120)] + [("null", "s0", None)]
    group = {d: g for d, g, _ in docs}
    near = [(a, b) for a in group for b in group if a < b and group[a] == group[b] and rng.random() < 0.05]
    close = {frozenset(p) for p in near}
    expected = set()
    for d, g, t in sorted(docs, key=lambda r: (-len(r[2] or ""), r[0])):
        if len(t or "") >= 20 and not any(frozenset((d, k)) in close for k in expected):
            expected.add(d)
    got = R.greedy_kept(spark.createDataFrame(docs, "id string, source_file string, content string"), spark.createDataFrame(near, "a string, b string"))
    assert {r.id for r in got.collect() if r.kept} == expected and got.count() == len(docs)


def test_writes(spark):
    stored = spark.createDataFrame([], "id string")
    add = spark.createDataFrame([("w", "r", "y" * 1700, None, "me", None), ("w", "r", "short", None, "me", None), ("w", "r", "short", None, "me", None), ("w", "r", " ", None, "me", None), ("w", "r", None, None, "me", None)], "wing string, room string, content string, source_file string, added_by string, filed_at string")
    new = R.filed(stored, add)
    assert sorted(r.chunk_index for r in new.collect()) == [0, 0, 1, 2]
    assert R.filed(new.select("id"), add).collect() == []
    base = spark.createDataFrame([("1", "a", "b"), ("2", "c", None)], "id string, x string, y string")
    assert sorted(map(tuple, R.updated(base, spark.createDataFrame([("1", None, "z")], "id string, x string, y string")).collect())) == [("1", "a", "z"), ("2", "c", None)]
    assert sorted(map(tuple, R.upserted(base, spark.createDataFrame([("2", "q", "q"), ("3", "n", "n")], "id string, x string, y string")).collect())) == [("1", "a", "b"), ("2", "q", "q"), ("3", "n", "n")]
    assert [r.id for r in R.without(base, spark.createDataFrame([("1",)], "id string")).collect()] == ["2"]
    assert not R.diverged(200_000, 199_000) and R.diverged(400_000, 200_000)


def test_evaluation(spark):
    df = spark.createDataFrame([("the red cat", "a red cat!"), ("", ""), ("x", ""), ("a b", "c d")], "p string, t string")
    assert [r.f for r in df.coalesce(1).select(E.token_f1(F.col("p"), F.col("t")).alias("f")).collect()] == [1.0, 1.0, 0.0, 0.0]
    q = spark.createDataFrame([("What did \"the old gate\" say to Marlow?", "Marlow saw the old gate", 1.0)], "q string, d string, x double").select(E.full_fusion(F.col("x"), F.col("q"), F.col("d")).alias("f"), E.keyword_fusion(F.col("x"), F.col("q"), F.col("d")).alias("k")).first()
    assert q.f == pytest.approx((1 - 0.5 * 2 / 3) * 0.4 * 0.8) and q.k == pytest.approx(1 - 0.3 * 3 / 4)
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id int, vec_id int, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 12), (1, 99)], "query_id int, vec_id int")
    m = {r.query_id: r for r in E.ranking_measures(ranked, rel, 3, "vec_id").collect()}
    dcg, ideal = 1 / np.log2(3) + 1 / np.log2(4), 1 + 1 / np.log2(3)
    assert m[1].ndcg == pytest.approx(dcg / ideal, abs=1e-6) and (m[1].recall_any, m[1].recall_all) == (1.0, 0.0) and m[2].ndcg == 0


class Notes(ST.RecordSource):
    @classmethod
    def name(cls):
        return "notes_for_test"

    def items(self):
        return ["a", "b"]

    def records(self, item):
        for i in range(3):
            yield (f"{item}{i}", f"text {i}", item, i, None, "general")


def test_sources(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ST.register(spark, Notes)
    assert spark.read.format("notes_for_test").load().count() == 6
    assert ST.resolve(None, None, lambda: "notes_for_test") == "notes_for_test" and ST.resolve() == "parquet"
    with pytest.raises(ValueError):
        ST.resolve("nope")
    eav = spark.createDataFrame([("1", "wing", "w", None, None, None), ("1", "n", None, 5, None, None), ("1", "x", None, None, 1.5, None), ("2", "ok", None, None, None, True)], "id string, key string, string_value string, int_value long, float_value double, bool_value boolean")
    got = {r.id: (r.wing, r.n, r.extra) for r in ST.pivoted(eav, ["wing", "n"]).collect()}
    assert got == {"1": ("w", "5", {"x": "1.5"}), "2": (None, None, {"ok": "true"})}
    ST.export(spark.createDataFrame([("1", "c1", "w", "r"), ("2", None, None, None)], "id string, content string, wing string, room string"), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e" / "rooms")).filter("value like '## %'").count() == 2 and spark.read.text(str(tmp_path / "e" / "index")).count() == 2
    ST.log(spark, str(tmp_path / "log"), "add", {"wing": "w", "content": "secret"}, "ok")
    row = spark.read.json(str(tmp_path / "log")).first()
    assert row.params.content == "<6 characters>" and row.params.wing == "w"


def test_sweep_stream_equals_batch(spark, tmp_path):
    line = lambda s, u, t, kind="user", text="hello": f'{{"type": "{kind}", "uuid": "{u}", "sessionId": "{s}", "timestamp": "{t}", "message": {{"role": "{kind}", "content": "{text}"}}}}'
    src = tmp_path / "in"
    src.mkdir()
    first = [line("s", "1", "2025-01-01T00:00:00Z"), line("s", "2", "2025-01-01T00:00:01Z", "assistant"), line("s", "2", "2025-01-01T00:00:01Z", "assistant"), "{broken", line("s", "", "2025-01-01T00:00:01Z"), line("s", "9", "2025-01-01T00:00:01Z", "tool"), line("s", "8", "2025-01-01T00:00:01Z", "user", "  ")]
    (src / "a.jsonl").write_text("\n".join(first))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        X.sweep_stream(TR.session_messages(spark.readStream.text(str(src))), out, ck).awaitTermination(60)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert run() == ["sweep_s_1", "sweep_s_2"]
    (src / "b.jsonl").write_text("\n".join([line("s", "2", "2025-01-01T00:00:01Z", "assistant"), line("s", "3", "2025-01-01T00:00:02Z")]))
    assert run() == ["sweep_s_1", "sweep_s_2", "sweep_s_3"] == run()
    batch = TR.session_messages(spark.read.text(str(src)))
    stored = spark.createDataFrame([("sweep_s_2", "s", "2025-01-01T00:00:01Z")], "id string, session_id string, timestamp string")
    states = {r.id: r.state for r in X.swept(batch, stored).collect()}
    assert states == {"sweep_s_1": "skipped", "sweep_s_2": "present", "sweep_s_3": "added"}
    assert tuple(X.sweep_counts(X.swept(batch, stored)).first()) == (1, 1, 2, 1)


def test_replace_and_gates(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    schema = "source_file string, content string"
    (src / "1.json").write_text('{"source_file": "a", "content": "old"}\n{"source_file": "b", "content": "keep"}')
    go = lambda: X.replace_sources(spark.readStream.schema(schema).json(str(src)), out, ck).awaitTermination(60)
    go()
    (src / "2.json").write_text('{"source_file": "a", "content": "new"}')
    go()
    assert sorted((r.source_file, r.content) for r in spark.read.parquet(out).collect()) == [("a", "new"), ("b", "keep")]
    files = spark.createDataFrame([("p", "## A\nx\n## B\ny\n")], "path string, text string")
    state = spark.createDataFrame([], "path string, hash string, entries int")
    changed = X.changed_files(files, state)
    assert changed.count() == 1 and X.changed_files(files, changed.select("path", "hash")).count() == 0
    entries = TR.diary_entries(files)
    assert [(r.header, r.body) for r in entries.orderBy("entry_index").collect()] == [("## A", "x"), ("## B", "y")]
    assert X.new_entries(entries, spark.createDataFrame([("p", 1)], "path string, entries int")).count() == 1


def test_lexical_search_scores_old_records_too(spark):
    rows = [(f"r{i:04d}", "lantern and some other words of no use", f"2025-01-01T{i // 60:02d}:{i % 60:02d}:00") for i in range(700)] + [("best", "brass lantern", "2020-01-01T00:00:00")]
    df = spark.createDataFrame(rows, "id string, content string, filed_at string")
    asked = spark.createDataFrame([(1, "brass lantern"), (2, "of no"), (3, "missing")], "query_id long, text string")
    got = [(r.query_id, r.id, r["rank"]) for r in V.lexical_search(df, asked, "id").collect()]
    assert (1, "best", 1) in got and sum(q == 1 for q, _, _ in got) == 5
    # no usable word: the latest 500; no match: nothing
    assert [i for q, i, r in sorted(got, key=lambda x: (x[0], x[2])) if q == 2] == [f"r{i:04d}" for i in range(200, 205)]
    assert {q for q, _, _ in got} == {1, 2}


def test_lexical_search_agrees_where_no_bound_is_met(spark):
    rows = [(f"r{i}", " ".join(random.Random(i).choices(["of", "tin", "lamp", "oil", "a", "wick"], k=i % 9)), f"2025-01-{i % 28 + 1:02d}") for i in range(120)]
    df = spark.createDataFrame(rows, "id string, content string, filed_at string")
    asked = spark.createDataFrame([(1, "a tin of oil"), (2, "lamp lamp"), (3, "of a")], "query_id long, text string")
    whole, bounded = (sorted(map(tuple, V.lexical_search(df, asked, "id", n=120, whole=w).collect())) for w in (True, False))
    assert whole == bounded and len(whole) > 200


def test_greedy_never_leaves_records_undecided(spark):
    # each record near the next longer one: every second is kept
    docs = [(f"d{i}", "s", "x" * (30 - i)) for i in range(7)]
    near = [(f"d{i}", f"d{i + 1}") for i in range(6)]
    args = spark.createDataFrame(docs, "id string, source_file string, content string"), spark.createDataFrame(near, "a string, b string")
    assert {r.id for r in R.greedy_kept(*args).collect() if r.kept} == {"d0", "d2", "d4", "d6"}
    with pytest.raises(RuntimeError):
        R.greedy_kept(*args, most_rounds=2)


def test_sign_codes_grow_with_the_rows():
    from loomspan.operators import retrieval

    small, large = retrieval.sign_codes(100, 0.15), retrieval.sign_codes(10**6, 0.15)
    assert small[0] == 8 and large[0] > small[0] and large[1] > small[1]
    for bits, n in (small, large):
        same = (1 - math.acos(0.85) / math.pi) ** bits
        assert 1 - (1 - same) ** n >= 0.998


def test_hydration_sorts_no_source(spark):
    from loomspan.operators import retrieval

    rows = [(f"r{i}", "a" if i < 40 else f"s{i}", i, f"text {i} {'apple pear' if i == 7 else 'plum'}") for i in range(60)]
    records = spark.createDataFrame(rows, "vec_id string, source_file string, chunk_index int, text string")
    hits = spark.createDataFrame([("q", "r3", "a"), ("q", "r50", "s50")], "query_id string, vec_id string, source string")
    queries = spark.createDataFrame([("q", "apple pear")], "query_id string, text string")
    out = retrieval.hydrated(hits, records, queries, "vec_id")
    assert {r.vec_id: r.text for r in out.collect()} == {"r3": "text 6 plum\n\ntext 7 apple pear\n\ntext 8 plum", "r50": "text 50 plum"}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
