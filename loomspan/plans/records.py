"""Queries over filed records: filters, counts, pages, windows, pruning and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import predicates as P
from loomspan.operators import records as R
from loomspan.tables import load

META = ["id", "wing", "room", "hall", "source_file", "chunk_index", "added_by", "filed_at", "filed_at_ts", "normalize_version", "entities"]
#: Repeated rows of a record agree in these columns, so distinct rows are records.
_D = f"SELECT DISTINCT {', '.join(META)} FROM drawers"


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """A row a record; by id, so that only the columns a query has are read and shuffled."""
    return load(spark, sf, "drawers").select(*META).dropDuplicates(["id"])


WHERE = {"$and": [{"wing": {"$in": ["alderline", "dunmore"]}}, {"$or": [{"room": "backend"}, {"chunk_index": {"$gte": 3}}]}, {"added_by": {"$ne": "mcp"}}, {"hall": {"$nin": ["hall_events"]}}]}


def where_tree(spark, sf):
    return load(spark, sf, "drawers").filter(P.where_column(WHERE)).select("id", "wing", "room", "hall", "chunk_index").dropDuplicates()


def where_contains(spark, sf):
    return load(spark, sf, "documents").filter(P.document_column({"$and": [{"$contains": "copper"}, {"$not_contains": "manifest"}]}, "text")).select("doc_id", "lang")


def page_with_total(spark, sf):
    own = load(spark, sf, "drawers").filter(P.where_column(P.scope("alderline", "diary"))).select("id", "chunk_index").dropDuplicates()
    return P.page_with_total(own, None, 10, 5).select("id", "chunk_index", "total")


def current_records(spark, sf):
    return P.current(load(spark, sf, "drawers").select("id", "filed_at", "wing", "room", "chunk_index"))


def current_entities(spark, sf):
    own = load(spark, sf, "entities").select("id", "name", "type", F.unix_micros("created_at").alias("created_us"))
    return P.current(own, "id", "created_us")


def status_counts(spark, sf):
    return R.counts(load(spark, sf, "drawers"))


def taxonomy(spark, sf):
    return R.taxonomy(load(spark, sf, "drawers"), "?")


def wing_counts(spark, sf):
    return load(spark, sf, "drawers").groupBy(F.coalesce("wing", F.lit("unknown")).alias("wing")).agg(F.count("*").alias("n"))


def room_counts(spark, sf):
    return load(spark, sf, "drawers").filter("wing = 'brackwater'").groupBy(F.coalesce("room", F.lit("unknown")).alias("room")).agg(F.count("*").alias("n"))


def source_groups(spark, sf):
    return R.source_groups(load(spark, sf, "drawers"), 3)


def source_stats(spark, sf):
    return R.source_stats(R.source_groups(load(spark, sf, "drawers"), 2))


def unread_sources(spark, sf):
    files = load(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("source_file"), F.lit(None).cast("double").alias("mtime")).distinct()
    return R.unread(files, R.read_sources(load(spark, sf, "drawers"), 2)).select("source_file")


def latest_per_agent(spark, sf):
    own = load(spark, sf, "diary_entries").filter("agent is not null").select("id", "agent", "date", "topic").dropDuplicates()
    return R.latest_per_group(own, "agent", 5, "date").select("agent", "rank", "id", "date", "topic")


def essential_story(spark, sf):
    own = load(spark, sf, "drawers").select("id", "room", "source_file", "content", "filed_at_ts").dropDuplicates(["id"])
    return R.essential_story(own, F.col("filed_at_ts"))


def content_duplicates(spark, sf):
    own = load(spark, sf, "drawers").select("id", "wing", "room", "content").dropDuplicates()
    return R.content_duplicates(own, ["wing", "room"])


ROOTS = ["/vault/alderline", "/vault/alderline/backend", "/vault/dunmore"]


def pruning(spark, sf):
    live = load(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("source_file"))
    return R.pruning(meta(spark, sf).select("id", "room", "source_file"), ROOTS, live).groupBy("bucket").agg(F.count("*").alias("n"))


def longest_roots(spark, sf):
    root = R.root_of(F.coalesce("source_file", F.lit("")), ROOTS)
    return meta(spark, sf).groupBy(root.alias("root")).agg(F.count("*").alias("n"))


def epochs(spark, sf):
    return R.with_epochs(meta(spark, sf)).select("id", F.round("filed_at_ts", 3).alias("filed_at_ts"))


def filed_rows(spark, sf):
    added = load(spark, sf, "diary_entries").filter("wing is not null").select("wing", F.lit("diary").alias("room"), "content", F.lit(None).cast("string").alias("source_file"), F.lit("mcp").alias("added_by"), F.lit(None).cast("string").alias("filed_at")).dropDuplicates()
    return R.filed(load(spark, sf, "drawers").select("id"), added).select("id", "wing", "chunk_index", F.char_length("content").alias("size"), "parent_drawer_id")


def diary_writes(spark, sf):
    own = load(spark, sf, "diary_entries").filter("agent is not null and content is not null").select("agent", F.col("content").alias("entry"), "topic", F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("at")).dropDuplicates()
    return R.diary_rows(own).select("agent", "topic", "chunk_index", F.char_length("content").alias("size"))


def project_stats(spark, sf):
    own = load(spark, sf, "diary_entries").select("id", F.col("wing").alias("project"), F.col("agent").alias("name")).dropDuplicates().filter("project is not null and name is not null")
    return R.project_stats(own, ["scribe", "ember"])


def people(spark, sf):
    own = load(spark, sf, "triples").filter("predicate = 'member_of' and subject is not null and object is not null").select("id", F.col("subject").alias("name"), F.col("object").alias("email")).dropDuplicates()
    return R.recency_groups(own).select("name", "email", "person")


THEME_STOP = ["that", "this", "with", "from", "were", "have", "because", "about", "after"]


def themes(spark, sf):
    own = load(spark, sf, "messages").filter("role in ('user', 'human')").select("uuid", "content").dropDuplicates()
    return R.themes(own, THEME_STOP, 10)


def relational_control(spark, sf):
    """Revenue by region and year of the suppliers' own nation: joins, sets and a window over the star schema."""
    li, o, c, s = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders", "customer", "supplier"))
    n, r = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).filter("c_nationkey = s_nationkey")
    j = j.join(F.broadcast(n), j.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows
    g = j.groupBy(F.col("r_name").alias("region"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
    return g


QUERIES = {f.__name__: f for f in (where_tree, where_contains, page_with_total, current_records, current_entities, status_counts, taxonomy, wing_counts, room_counts, source_groups, source_stats, unread_sources, latest_per_agent, essential_story, content_duplicates, pruning, longest_roots, epochs, filed_rows, diary_writes, project_stats, people, themes, relational_control)}

ORACLES = {
    "where_tree": f"""SELECT id, wing, room, hall, chunk_index FROM ({_D}) WHERE wing IN ('alderline', 'dunmore')
        AND (room = 'backend' OR chunk_index >= 3) AND added_by IS DISTINCT FROM 'mcp' AND (hall IS NULL OR hall <> 'hall_events')""",
    "where_contains": "SELECT doc_id, lang FROM documents WHERE contains(text, 'copper') AND NOT contains(text, 'manifest')",
    "page_with_total": f"SELECT id, chunk_index, count(*) OVER () AS total FROM ({_D}) WHERE wing = 'alderline' AND room = 'diary' ORDER BY id LIMIT 10 OFFSET 5",
    "current_records": """SELECT id, filed_at, wing, room, chunk_index FROM drawers
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY filed_at DESC NULLS LAST, wing DESC NULLS LAST, room DESC NULLS LAST, chunk_index DESC NULLS LAST) = 1""",
    "current_entities": """SELECT id, name, type, epoch_us(created_at) AS created_us FROM entities
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, name DESC NULLS LAST, type DESC NULLS LAST) = 1""",
    "status_counts": """SELECT CASE grouping(w, r) WHEN 1 THEN 'wing' WHEN 2 THEN 'room' ELSE 'total' END AS level, w AS wing, r AS room, count(*) AS n
        FROM (SELECT coalesce(wing, 'unknown') AS w, coalesce(room, 'unknown') AS r FROM drawers) GROUP BY GROUPING SETS ((w), (r), ())""",
    "taxonomy": "SELECT coalesce(wing, '?') AS wing, coalesce(room, '?') AS room, count(*) AS n FROM drawers GROUP BY 1, 2",
    "wing_counts": "SELECT coalesce(wing, 'unknown') AS wing, count(*) AS n FROM drawers GROUP BY 1",
    "room_counts": "SELECT coalesce(room, 'unknown') AS room, count(*) AS n FROM drawers WHERE wing = 'brackwater' GROUP BY 1",
    "source_groups": "SELECT coalesce(source_file, 'unknown') AS source_file, count(DISTINCT id) AS n FROM drawers GROUP BY 1 HAVING count(DISTINCT id) >= 3",
    "source_stats": """SELECT count(*) AS sources, CAST(sum(n) AS BIGINT) AS records, CAST(coalesce(sum(CASE WHEN n > 20 THEN floor(n * 2 / 5) END), 0) AS BIGINT) AS estimated_duplicates
        FROM (SELECT coalesce(source_file, 'unknown') AS s, count(DISTINCT id) AS n FROM drawers GROUP BY 1 HAVING count(DISTINCT id) >= 2)""",
    "unread_sources": """SELECT DISTINCT source AS source_file FROM documents WHERE source IS NOT NULL AND source NOT IN (
        SELECT source_file FROM drawers WHERE source_file IS NOT NULL GROUP BY 1 HAVING min(coalesce(normalize_version, 0)) >= 2)""",
    "latest_per_agent": """SELECT agent, rank, id, date, topic FROM (SELECT *, CAST(row_number() OVER (PARTITION BY agent ORDER BY date DESC NULLS LAST, id) AS INTEGER) AS rank
        FROM (SELECT DISTINCT id, agent, date, topic FROM diary_entries WHERE agent IS NOT NULL)) WHERE rank <= 5""",
    "essential_story": """WITH d AS (SELECT DISTINCT ON (id) id, room, source_file, content, filed_at_ts FROM drawers),
        t AS (SELECT coalesce(room, 'general') AS room, coalesce(filed_at_ts, 3.0) AS weight, id,
          replace(trim(coalesce(content, '')), chr(10), ' ') AS txt, string_split(coalesce(source_file, ''), '/')[-1] AS file FROM d ORDER BY weight DESC, id LIMIT 15),
        l AS (SELECT *, '  - ' || CASE WHEN length(txt) > 200 THEN substr(txt, 1, 197) || '...' ELSE txt END || CASE WHEN file <> '' THEN '  (' || file || ')' ELSE '' END AS line FROM t),
        r AS (SELECT *, CAST(row_number() OVER (ORDER BY room, weight DESC, id) AS INTEGER) AS rank, row_number() OVER (PARTITION BY room ORDER BY weight DESC, id) = 1 AS first FROM l),
        u AS (SELECT *, sum(length(line) + CASE WHEN first THEN length(room) + 3 ELSE 0 END) OVER (ORDER BY rank) AS used FROM r)
        SELECT room, rank, line FROM u WHERE used <= 3200""",
    "content_duplicates": """SELECT sha256(concat_ws(chr(31), coalesce(wing, ''), coalesce(room, ''), coalesce(content, ''))) AS hash, min(id) AS kept, count(*) AS copies
        FROM (SELECT DISTINCT id, wing, room, content FROM drawers) GROUP BY 1 HAVING count(*) > 1""",
    "pruning": f"""SELECT CASE WHEN room = '_registry' OR starts_with(id, '_reg_') THEN 'kept' WHEN coalesce(source_file, '') NOT LIKE '/%' THEN 'no_source'
        WHEN NOT (source_file LIKE '/vault/alderline/%' OR source_file LIKE '/vault/dunmore/%') THEN 'out_of_scope'
        WHEN source_file NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) THEN 'missing' ELSE 'kept' END AS bucket, count(*) AS n FROM ({_D}) GROUP BY 1""",
    "longest_roots": f"""SELECT CASE WHEN source_file LIKE '/vault/alderline/backend/%' THEN '/vault/alderline/backend' WHEN source_file LIKE '/vault/alderline/%' THEN '/vault/alderline'
        WHEN source_file LIKE '/vault/dunmore/%' THEN '/vault/dunmore' END AS root, count(*) AS n FROM ({_D}) GROUP BY 1""",
    "epochs": f"SELECT id, round(coalesce(filed_at_ts, epoch_us(TRY_CAST(filed_at AS TIMESTAMPTZ)) / 1e6), 3) AS filed_at_ts FROM ({_D})",
    "filed_rows": """WITH a AS (SELECT DISTINCT wing, content FROM diary_entries WHERE wing IS NOT NULL AND regexp_matches(content, '\\S')),
        w AS (SELECT *, 'drawer_' || wing || '_diary_' || substr(sha256(wing || 'diary' || content), 1, 24) AS whole FROM a),
        c AS (SELECT wing, content, whole, unnest(generate_series(0, CAST(greatest(length(content) - 1, 0) // 800 AS BIGINT))) AS k FROM w)
        SELECT DISTINCT CASE WHEN length(content) > 800 THEN whole || '_chunk_' || lpad(CAST(k AS VARCHAR), 6, '0') ELSE whole END AS id, wing, CAST(k AS INTEGER) AS chunk_index,
          CAST(length(substr(content, k * 800 + 1, 800)) AS INTEGER) AS size, CASE WHEN length(content) > 800 THEN whole END AS parent_drawer_id
        FROM c WHERE CASE WHEN length(content) > 800 THEN whole || '_chunk_' || lpad(CAST(k AS VARCHAR), 6, '0') ELSE whole END NOT IN (SELECT id FROM drawers)""",
    "diary_writes": """WITH a AS (SELECT DISTINCT agent, content, topic FROM diary_entries WHERE agent IS NOT NULL AND regexp_matches(content, '\\S'))
        SELECT lower(trim(agent)) AS agent, coalesce(topic, 'general') AS topic, CAST(k AS INTEGER) AS chunk_index, CAST(length(substr(content, k * 800 + 1, 800)) AS INTEGER) AS size
        FROM (SELECT *, unnest(generate_series(0, CAST(greatest(length(content) - 1, 0) // 800 AS BIGINT))) AS k FROM a)""",
    "project_stats": """WITH c AS (SELECT wing AS project, agent AS name, count(*) AS n FROM (SELECT DISTINCT id, wing, agent FROM diary_entries WHERE wing IS NOT NULL AND agent IS NOT NULL) GROUP BY 1, 2),
        r AS (SELECT *, rank() OVER (PARTITION BY project ORDER BY n DESC) AS k FROM c),
        g AS (SELECT project, CAST(sum(n) AS BIGINT) AS commits, CAST(coalesce(sum(n) FILTER (name IN ('scribe', 'ember')), 0) AS BIGINT) AS own, min(k) FILTER (name IN ('scribe', 'ember')) AS k FROM r GROUP BY 1)
        SELECT project, commits, own, own > 0 AND (coalesce(k, 99) <= 5 OR own * 10 >= commits OR own >= 20) AS is_mine FROM g""",
    "people": """WITH RECURSIVE p AS (SELECT subject AS name, object AS email, count(DISTINCT id) AS n FROM triples WHERE predicate = 'member_of' AND subject IS NOT NULL AND object IS NOT NULL GROUP BY 1, 2),
        e AS (SELECT DISTINCT a.name AS x, b.name AS y FROM p a JOIN p b ON a.email = b.email),
        reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
        c AS (SELECT x AS name, min(y) AS c FROM reach GROUP BY 1),
        s AS (SELECT c.c, p.name, sum(p.n) AS n FROM p JOIN c ON c.name = p.name GROUP BY 1, 2),
        b AS (SELECT c, name AS person FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, name DESC) = 1)
        SELECT p.name, p.email, b.person FROM p JOIN c ON c.name = p.name JOIN b ON b.c = c.c""",
    "themes": f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(content, '')), '[a-z]{{4,}}')) AS word
        FROM (SELECT DISTINCT uuid, content FROM messages WHERE role IN ('user', 'human'))) WHERE word NOT IN ({', '.join(repr(w) for w in THEME_STOP)}) GROUP BY 1 ORDER BY n DESC, word LIMIT 10""",
    "relational_control": """SELECT r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey GROUP BY 1, 2""",
}
