"""Queries over vector, lexical and hybrid retrieval.

Queries are the vectors whose vec_id is divisible by 50, each with the whole
text of the document of that id. A source's index entry (closet) is the
vector of its first document.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import evaluation as E
from loomspan.operators import retrieval as R
from loomspan.tables import load


def _vectors(spark, sf):
    return load(spark, sf, "embeddings")


def _asked(spark, sf):
    v = _vectors(spark, sf).filter("vec_id % 50 = 0")
    text = load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return v.join(text, "vec_id", "left").select(F.col("vec_id").alias("query_id"), "embedding", F.coalesce("text", F.lit("")).alias("text"), "label")


def _records(spark, sf):
    """(vec_id, embedding, text, source_file, chunk_index): documents with vectors, places by id within a source."""
    place = W.partitionBy("source").orderBy("doc_id")
    docs = load(spark, sf, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))
    own = docs.join(_vectors(spark, sf), F.col("doc_id") == F.col("vec_id"))
    return own.select("vec_id", "embedding", F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("source_file"), (F.row_number().over(place) - 1).alias("chunk_index"))


def _closets(spark, sf):
    first = _records(spark, sf).filter("source_file <> ''").groupBy("source_file").agg(F.min(F.struct("vec_id", "embedding")).alias("f"))
    return first.select(F.col("f.vec_id").alias("closet_id"), "f.embedding", "source_file")


def knn_exact(spark, sf):
    return R.nearest(_vectors(spark, sf), _asked(spark, sf), 10).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def knn_filtered(spark, sf):
    return R.nearest(_vectors(spark, sf).filter("label in (1, 3, 5)"), _asked(spark, sf), 5).select("query_id", "vec_id", "rank")


def max_distance(spark, sf):
    return R.nearest(_vectors(spark, sf), _asked(spark, sf), 20).filter("distance <= 0.6").select("query_id", "vec_id")


def check_duplicate(spark, sf):
    near = R.nearest(_vectors(spark, sf), _asked(spark, sf), 5)
    return near.filter(1 - F.col("distance") >= 0.9).select("query_id", "vec_id")


PROBES = 12


def knn_lists(spark, sf):
    return R.nearest_by_lists(_vectors(spark, sf), _asked(spark, sf), 10, PROBES).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def knn_recall(spark, sf):
    v, q = _vectors(spark, sf), _asked(spark, sf)
    return R.recall(R.nearest_by_lists(v, q, 10, PROBES), R.nearest(v, q, 10))


def _questions(spark, sf):
    return load(spark, sf, "eval_items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark, sf):
    s = R.bm25_corpus(load(spark, sf, "documents"), _questions(spark, sf), "doc_id", "text")
    return R.top(s.withColumn("bm25", F.round("bm25", 6)), 10, "doc_id", "bm25").select("query_id", "doc_id", "bm25", "rank")


def lexical_search(spark, sf):
    """The best five of all drawers that share a longer word with a question."""
    own = load(spark, sf, "drawers").select("id", "content", "filed_at").dropDuplicates()
    return R.lexical_search(own, _questions(spark, sf), "id")


def hybrid_fuse(spark, sf):
    near = R.nearest(_vectors(spark, sf), _asked(spark, sf), 10).join(load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text")), "vec_id")
    fused = R.hybrid(near.select("query_id", "vec_id", "distance"), R.bm25(near, _asked(spark, sf), "vec_id", "text"), "vec_id")
    return fused.select("query_id", "vec_id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


def rank_boost(spark, sf):
    asked = _asked(spark, sf)
    near = R.nearest(_records(spark, sf), asked, 15).join(_records(spark, sf).select("vec_id", F.col("source_file").alias("source")), "vec_id")
    index = R.nearest(_closets(spark, sf), asked, 10, "closet_id").join(_closets(spark, sf).select("closet_id", F.col("source_file").alias("source")), "closet_id")
    return R.boosted(near.select("query_id", "vec_id", "source", "distance"), index).select("query_id", "vec_id", "boost", F.round("effective", 6).alias("effective"))


def neighbour_expand(spark, sf):
    r = _records(spark, sf)
    matched = r.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("match_id"), "source_file", "chunk_index")
    return R.neighbours(matched, r).select("match_id", F.md5("joined").alias("md5"), "total")


def search_vector(spark, sf):
    return R.search(_records(spark, sf), _closets(spark, sf), _asked(spark, sf), 5)


def search_union(spark, sf):
    return R.search(_records(spark, sf), _closets(spark, sf), _asked(spark, sf), 5, strategy="union")


def _candidates(spark, sf):
    """Nearest 50 documents of each query with their texts and the query's text."""
    asked = _asked(spark, sf)
    near = R.nearest(_vectors(spark, sf), asked, 50).join(load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text")), "vec_id")
    return near.join(asked.select("query_id", F.col("text").alias("question")), "query_id")


def keyword_fusion(spark, sf):
    fused = _candidates(spark, sf).withColumn("fused", F.round(E.keyword_fusion(F.col("distance"), F.col("question"), F.col("text")), 9))
    return R.top(fused.drop("rank"), 10, "vec_id", "fused", ascending=True).select("query_id", "vec_id", F.round("fused", 6).alias("fused"))


def full_fusion(spark, sf):
    fused = _candidates(spark, sf).withColumn("fused", F.round(E.full_fusion(F.col("distance"), F.col("question"), F.col("text")), 9))
    return R.top(fused.drop("rank"), 10, "vec_id", "fused", ascending=True).select("query_id", "vec_id", F.round("fused", 6).alias("fused"))


def temporal_fusion(spark, sf):
    """Nearest ten, lifted by nearness of their filing to the query document's, within 30 days."""
    when = load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.unix_micros(F.col("filed_at").cast("timestamp")).alias("at"))
    asked = _asked(spark, sf)
    near = R.nearest(_vectors(spark, sf), asked, 10).join(when, "vec_id", "left").join(when.select(F.col("vec_id").alias("query_id"), F.col("at").alias("asked_at")), "query_id", "left")
    days = (F.col("at") - F.col("asked_at")) / 8.64e10
    return near.select("query_id", "vec_id", F.round(E.temporal_fusion(F.col("distance"), days, F.lit(30.0)), 6).alias("fused"))


def room_fusion(spark, sf):
    own = load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "room")
    asked = own.select(F.col("vec_id").alias("query_id"), F.col("room").alias("asked_room"))
    near = R.nearest(_vectors(spark, sf), _asked(spark, sf), 10).join(own, "vec_id", "left").join(asked, "query_id", "left")
    return near.select("query_id", "vec_id", F.round(E.room_fusion(F.col("distance"), F.coalesce(F.col("room") == F.col("asked_room"), F.lit(False))), 6).alias("fused"))


def ranking_measures(spark, sf):
    """Relevant to a query are the vectors of its label."""
    v, q = _vectors(spark, sf), _asked(spark, sf)
    relevant = q.select("query_id", "label").join(v.select("vec_id", "label"), "label").select("query_id", "vec_id")
    return E.ranking_measures(R.nearest(v, q, 10), relevant, 10, "vec_id")


def session_halls(spark, sf):
    m = load(spark, sf, "messages").filter("session_id is not null").select("session_id", "uuid", "role", "content").dropDuplicates()
    side = lambda r: F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("content")))), " ")
    g = m.groupBy("session_id").agg(side("user").alias("u"), side("assistant").alias("a"))
    return g.select("session_id", E.session_hall(F.col("u"), F.col("a")).alias("hall"))


def token_f1(spark, sf):
    """F1 of each evaluation item against the next one."""
    q = load(spark, sf, "eval_items").select("item_id", "text")
    nxt = q.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return q.join(nxt, "item_id").select("item_id", F.round(E.token_f1(F.col("text"), F.col("other")), 6).alias("f1"))


def nearest_rank(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return E.nearest_rank(e, "event_type", "value", 0.95)


QUERIES = {f.__name__: f for f in (knn_exact, knn_filtered, max_distance, check_duplicate, knn_lists, knn_recall, bm25_topk, lexical_search, hybrid_fuse, rank_boost, neighbour_expand, search_vector, search_union, keyword_fusion, full_fusion, temporal_fusion, room_fusion, ranking_measures, session_halls, token_f1, nearest_rank)}

_DIST = "list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
_TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_STOP = ", ".join(f"'{w}'" for w in E.STOP_WORDS)
_NOTN = ", ".join(f"'{w}'" for w in E.NOT_NAMES)


def _near(k: int, records: str = "embeddings", key: str = "vec_id", name: str = "n", where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT q.vec_id AS query_id, v.{key}, {_DIST} AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.{key}) AS INTEGER) AS rank
        FROM embeddings q CROSS JOIN {records} v WHERE q.vec_id % 50 = 0 AND {where} QUALIFY rank <= {k})"""


_REC = """rec AS (SELECT vec_id, embedding, coalesce(text, '') AS text, coalesce(source, '') AS source_file, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1 AS chunk_index FROM documents JOIN embeddings ON doc_id = vec_id)"""
_CLO = "clo AS (SELECT min(vec_id) AS closet_id, arg_min(embedding, vec_id) AS embedding, source_file FROM rec WHERE source_file <> '' GROUP BY source_file)"
_BOOST = """b AS (SELECT query_id, source_file AS source, min(rank) AS rank, arg_min(distance, rank) AS distance FROM c JOIN clo USING (closet_id) GROUP BY 1, 2),
    l AS (SELECT n.query_id, n.vec_id, n.distance, r.source_file, r.chunk_index, r.text, CASE WHEN b.distance <= 1.5 AND b.rank <= 5 THEN [0.40, 0.25, 0.15, 0.08, 0.04][b.rank] ELSE 0.0 END AS boost
      FROM n JOIN rec r USING (vec_id) LEFT JOIN b ON b.query_id = n.query_id AND b.source = r.source_file)"""
_ASKED = "a AS (SELECT vec_id AS query_id, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0)"


def _bm(cand: str, prefix: str = "") -> str:
    """BM25 of the candidates (query_id, vec_id, text) of CTE `cand` against CTE a, as CTE {prefix}s."""
    p = prefix
    return f"""{p}t AS (SELECT query_id, vec_id, {_TOK.format(c='text')} AS w FROM {cand}),
    {p}m AS (SELECT query_id, count(*) AS n, avg(len(w)) AS mean FROM {p}t GROUP BY 1),
    {p}q AS (SELECT DISTINCT query_id, unnest({_TOK.format(c='text')}) AS word FROM a),
    {p}x AS (SELECT query_id, vec_id, len(w) AS length, unnest(w) AS word FROM {p}t),
    {p}f AS (SELECT query_id, vec_id, length, word, count(*) AS tf FROM {p}x SEMI JOIN {p}q USING (query_id, word) GROUP BY 1, 2, 3, 4),
    {p}d AS (SELECT query_id, word, count(*) AS df FROM {p}f GROUP BY 1, 2),
    {p}s AS (SELECT query_id, vec_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS bm25 FROM {p}f JOIN {p}d USING (query_id, word) JOIN {p}m USING (query_id) GROUP BY 1, 2)"""


_SEARCH = f"""WITH {_REC}, {_CLO}, {_ASKED}, {_near(15, 'rec')}, {_near(10, 'clo', 'closet_id', 'c')}, {_BOOST},
    cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY greatest(0.0, least(2.0, distance - boost)), vec_id) AS k FROM l) WHERE k <= 5),
    aw AS (SELECT query_id, list_distinct({_TOK.format(c='text')}) AS w FROM a),
    o AS (SELECT source_file, vec_id AS rec, text, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index, vec_id) AS n FROM rec),
    reach AS (SELECT DISTINCT cut.query_id, o.source_file, o.n, o.text, len(list_filter(aw.w, lambda x: contains(lower(o.text), x))) AS sc FROM cut JOIN o USING (source_file) JOIN aw USING (query_id) WHERE cut.boost > 0),
    best AS (SELECT query_id, source_file, n AS best FROM reach QUALIFY row_number() OVER (PARTITION BY query_id, source_file ORDER BY sc DESC, n) = 1),
    wide AS (SELECT query_id, source_file, substr(string_agg(o.text, chr(10) || chr(10) ORDER BY o.n), 1, 10000) AS wide FROM best JOIN o USING (source_file) WHERE o.n BETWEEN best - 1 AND best + 1 GROUP BY 1, 2),
    hv AS (SELECT cut.query_id, cut.vec_id, cut.distance, CASE WHEN cut.boost > 0 THEN coalesce(wide.wide, cut.text) ELSE cut.text END AS text, cut.source_file, cut.chunk_index FROM cut LEFT JOIN wide USING (query_id, source_file))"""
_RANK = """, g AS (SELECT h.query_id, h.vec_id, h.distance, coalesce(bm25, 0) AS bm25, max(coalesce(bm25, 0)) OVER (PARTITION BY h.query_id) AS most FROM h LEFT JOIN s USING (query_id, vec_id)),
    sc AS (SELECT query_id, vec_id, 0.6 * coalesce(greatest(0.0, 1 - distance), 0.0) + 0.4 * CASE WHEN most > 0 THEN bm25 / most ELSE 0.0 END AS score FROM g)
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM sc) WHERE rank <= 5"""
_CORPUS = f"""lt AS (SELECT vec_id, {_TOK.format(c='text')} AS w FROM rec), lm AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM lt),
    lq AS (SELECT DISTINCT query_id, unnest({_TOK.format(c='text')}) AS word FROM a), lx AS (SELECT vec_id, len(w) AS length, unnest(w) AS word FROM lt),
    lf AS (SELECT vec_id, length, word, count(*) AS tf FROM lx WHERE word IN (SELECT word FROM lq) GROUP BY 1, 2, 3), ld AS (SELECT word, count(*) AS df FROM lf GROUP BY 1),
    ls AS (SELECT query_id, vec_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS bm25 FROM lf JOIN lq USING (word) JOIN ld USING (word) CROSS JOIN lm GROUP BY 1, 2),
    lex AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, vec_id) <= 15)"""
_FUSE = f"""WITH {_near(50)}, {_ASKED}, x AS (SELECT n.query_id, n.vec_id, n.distance, lower(coalesce(d.text, '')) AS l, a.text AS q FROM n JOIN documents d ON d.doc_id = n.vec_id JOIN a ON a.query_id = n.query_id),
    k AS (SELECT *, list_filter(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({_STOP})) AS kw FROM x)"""



def _hits(side: str, phrases: list[str]) -> str:
    text = {"user": "u", "assistant": "s", "both": "u || s"}[side]
    return " + ".join("CAST(contains(" + text + ", '" + p.replace("'", "''") + "') AS INTEGER)" for p in phrases)


_WORDS = r"list_filter(string_split(trim(lower(regexp_replace(regexp_replace(regexp_replace(replace(coalesce({0}, ''), ',', ''), '\b(a|an|the|and)\b', ' ', 'g'), '\s+', ' ', 'g'), '[[:punct:]]', '', 'g'))), ' '), lambda w: w <> '')"
ORACLES = {
    "token_f1": f"""WITH q AS (SELECT a.item_id, {_WORDS.format("a.text")} AS a, {_WORDS.format("b.text")} AS b FROM eval_items a JOIN eval_items b ON b.item_id - 1 = a.item_id),
        s AS (SELECT item_id, len(a) AS n, len(b) AS m, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda v: v = w)), len(list_filter(b, lambda v: v = w))))), 0) AS same FROM q)
        SELECT item_id, round(CASE WHEN n = 0 OR m = 0 THEN CAST(n = m AS INTEGER) WHEN same = 0 THEN 0.0 ELSE 2 * (same / n) * (same / m) / (same / n + same / m) END, 6) AS f1 FROM s""",
    "knn_exact": f"WITH {_near(10)} SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM n",
    "knn_filtered": f"WITH {_near(5, where='v.label IN (1, 3, 5)')} SELECT query_id, vec_id, rank FROM n",
    "max_distance": f"WITH {_near(20)} SELECT query_id, vec_id FROM n WHERE distance <= 0.6",
    "check_duplicate": f"WITH {_near(5)} SELECT query_id, vec_id FROM n WHERE 1 - distance >= 0.9",
    "bm25_topk": f"""WITH a AS (SELECT item_id AS query_id, text FROM eval_items WHERE item_id % 50 = 0), rec AS (SELECT doc_id AS vec_id, text FROM documents),
        lt AS (SELECT vec_id, coalesce({_TOK.format(c='text')}, []) AS w FROM rec), lm AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM lt), {_CORPUS.split('lm AS', 1)[1].split('),', 1)[1].split(', lex AS')[0].strip().rstrip(',')}
        SELECT query_id, vec_id AS doc_id, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, vec_id) AS INTEGER) AS rank FROM ls QUALIFY rank <= 10""",
    "lexical_search": f"""WITH a AS (SELECT item_id AS query_id, text FROM eval_items WHERE item_id % 50 = 0), r AS (SELECT DISTINCT id AS vec_id, content AS text, filed_at FROM drawers),
        aw AS (SELECT DISTINCT query_id, unnest(list_filter({_TOK.format(c='text')}, lambda t: length(t) >= 3)) AS word FROM a), rw AS (SELECT DISTINCT vec_id, text, filed_at, unnest({_TOK.format(c='text')}) AS word FROM r),
        met AS (SELECT DISTINCT query_id, vec_id, text, filed_at FROM rw JOIN aw USING (word)),
        h AS (SELECT query_id, vec_id, text FROM met), {_bm('h')}
        SELECT query_id, vec_id AS id, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, vec_id) AS INTEGER) AS rank FROM (SELECT h.query_id, h.vec_id, coalesce(bm25, 0.0) AS bm25 FROM h LEFT JOIN s USING (query_id, vec_id)) QUALIFY rank <= 5""",
    "hybrid_fuse": f"""WITH {_near(10)}, {_ASKED}, h AS (SELECT n.query_id, n.vec_id, n.distance, coalesce(d.text, '') AS text FROM n JOIN documents d ON d.doc_id = n.vec_id), {_bm('h')},
        g AS (SELECT h.query_id, h.vec_id, h.distance, coalesce(bm25, 0) AS bm25, max(coalesce(bm25, 0)) OVER (PARTITION BY h.query_id) AS most FROM h LEFT JOIN s USING (query_id, vec_id))
        SELECT query_id, vec_id, round(bm25, 6) AS bm25, round(0.6 * greatest(0.0, 1 - distance) + 0.4 * CASE WHEN most > 0 THEN bm25 / most ELSE 0.0 END, 6) AS score FROM g""",
    "rank_boost": f"WITH {_REC}, {_CLO}, {_near(15, 'rec')}, {_near(10, 'clo', 'closet_id', 'c')}, {_BOOST} SELECT query_id, vec_id, CAST(boost AS DOUBLE) AS boost, round(greatest(0.0, least(2.0, distance - boost)), 6) AS effective FROM l",
    "neighbour_expand": f"""WITH {_REC}, t AS (SELECT source_file, count(*) AS total FROM rec GROUP BY 1)
        SELECT m.vec_id AS match_id, md5(string_agg(r.text, chr(10) || chr(10) ORDER BY r.chunk_index)) AS md5, any_value(t.total) AS total
        FROM rec m JOIN rec r ON r.source_file = m.source_file AND r.chunk_index BETWEEN m.chunk_index - 1 AND m.chunk_index + 1 JOIN t ON t.source_file = m.source_file WHERE m.vec_id % 50 = 0 GROUP BY 1""",
    "search_vector": f"{_SEARCH}, h AS (SELECT * FROM hv), {_bm('h')}{_RANK}",
    "search_union": f"""{_SEARCH}, {_CORPUS}, h AS (SELECT * FROM hv UNION ALL SELECT lex.query_id, lex.vec_id, NULL, r.text, r.source_file, r.chunk_index FROM lex JOIN rec r USING (vec_id)
        WHERE (lex.query_id, r.source_file, r.chunk_index) NOT IN (SELECT (query_id, source_file, chunk_index) FROM hv)), {_bm('h')}{_RANK}""",
    "keyword_fusion": f"""{_FUSE}, f AS (SELECT query_id, vec_id, round(distance * (1 - 0.3 * CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda w: contains(l, w))) / len(kw) ELSE 0.0 END), 9) AS fused FROM k)
        SELECT query_id, vec_id, round(fused, 6) AS fused FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused, vec_id) <= 10""",
    "full_fusion": f"""{_FUSE}, y AS (SELECT *, list_distinct(list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,15}}') AND w NOT IN ({_NOTN}))) AS nm,
          list_filter(list_transform(list_concat(regexp_extract_all(q, '''([^'']{{3,60}})''', 1), regexp_extract_all(q, '"([^"]{{3,60}})"', 1)), lambda p: trim(p)), lambda p: length(p) >= 3) AS ph FROM k),
        z AS (SELECT *, list_filter(kw, lambda w: NOT list_contains(list_transform(nm, lambda v: lower(v)), w)) AS pk FROM y),
        f AS (SELECT query_id, vec_id, round(distance * (1 - 0.5 * CASE WHEN len(pk) > 0 THEN len(list_filter(pk, lambda w: contains(l, w))) / len(pk) ELSE 0.0 END)
          * (1 - 0.6 * CASE WHEN len(ph) > 0 THEN len(list_filter(ph, lambda w: contains(l, lower(w)))) / len(ph) ELSE 0.0 END) * (1 - 0.2 * CASE WHEN len(nm) > 0 THEN len(list_filter(nm, lambda w: contains(l, lower(w)))) / len(nm) ELSE 0.0 END), 9) AS fused FROM z)
        SELECT query_id, vec_id, round(fused, 6) AS fused FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused, vec_id) <= 10""",
    "temporal_fusion": f"""WITH {_near(10)}, x AS (SELECT n.query_id, n.vec_id, n.distance, abs((epoch_us(d.filed_at) - epoch_us(q.filed_at)) / 86400000000.0) AS off FROM n LEFT JOIN documents d ON d.doc_id = n.vec_id LEFT JOIN documents q ON q.doc_id = n.query_id)
        SELECT query_id, vec_id, round(CASE WHEN off IS NULL THEN distance WHEN off <= 30 THEN distance * 0.6 WHEN off <= 90 THEN distance * (1 - 0.4 * (1 - (off - 30) / 60.0)) ELSE distance END, 6) AS fused FROM x""",
    "room_fusion": f"""WITH {_near(10)} SELECT n.query_id, n.vec_id, round(CASE WHEN d.room = q.room THEN distance * 0.8 ELSE distance END, 6) AS fused FROM n LEFT JOIN documents d ON d.doc_id = n.vec_id LEFT JOIN documents q ON q.doc_id = n.query_id""",
    "ranking_measures": f"""WITH {_near(10)}, x AS (SELECT n.query_id, n.rank, CASE WHEN v.label = q.label THEN 1 ELSE 0 END AS rel, q.label FROM n JOIN embeddings v ON v.vec_id = n.vec_id JOIN embeddings q ON q.vec_id = n.query_id),
        y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM x), t AS (SELECT label, count(*) AS total FROM embeddings GROUP BY 1),
        z AS (SELECT query_id, label, sum(CAST(round(rel / log2(rank + 1) * 1e12) AS BIGINT)) AS dcg, sum(CAST(round(rel / log2(best + 1) * 1e12) AS BIGINT)) AS ideal, sum(rel) AS hits FROM y GROUP BY 1, 2)
        SELECT query_id, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS recall_any, CASE WHEN hits >= total THEN 1.0 ELSE 0.0 END AS recall_all, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END, 6) AS ndcg FROM z JOIN t USING (label)""",
    "session_halls": """WITH m AS (SELECT DISTINCT session_id, uuid, role, content FROM messages WHERE session_id IS NOT NULL),
        g AS (SELECT session_id, lower(coalesce(string_agg(content, ' ' ORDER BY content) FILTER (role = 'user'), '')) AS u, lower(coalesce(string_agg(content, ' ' ORDER BY content) FILTER (role = 'assistant'), '')) AS s FROM m GROUP BY 1)
        SELECT session_id, CASE """
    + " ".join(f"WHEN {_hits(side, phrases)} >= {least} THEN '{hall}'" for hall, side, least, phrases in E.SESSION_HALLS)
    + " ELSE 'hall_general' END AS hall FROM g",
    "nearest_rank": """SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        WHERE i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)""",
}
#: The same without the bound of candidates.
