"""Queries over splitting, summaries, attribution and incremental filing."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import dialect as D
from loomspan.functions import people as N
from loomspan.functions import splitting as S
from loomspan.functions.text import sanitize_query
from loomspan.operators import mining
from loomspan.operators import predicates as P
from loomspan.operators import records as R
from loomspan.operators import retrieval
from loomspan.runtime import partitions
from loomspan.sources import transcripts as TR
from loomspan.streaming import sweep as X
from loomspan.tables import load

#: Messages before this time are stored already; the sweep sees all.
CURSOR = "2025-06-01T00:00:00"
#: Rows up to which a conversation's messages are gathered.
GATHERED = 1_000


def _messages(spark, sf):
    m = load(spark, sf, "messages").filter("role in ('user', 'assistant') and trim(content) <> '' and timestamp is not null")
    return m.select("session_id", "uuid", F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), "role", "content")


def sweep_increment(spark, sf):
    m = _messages(spark, sf).groupBy("session_id", "uuid", "role", "content").agg(F.max("timestamp").alias("timestamp"))
    stored = m.filter(F.col("timestamp") < CURSOR).select(X.sweep_id(F.col("session_id"), F.col("uuid")).alias("id"), "session_id", "timestamp")
    return X.swept(m, stored).select("id", "state")


def sweep_totals(spark, sf):
    return X.sweep_counts(sweep_increment(spark, sf))


def save_points(spark, sf):
    m = load(spark, sf, "messages").filter("role = 'user' and timestamp is not null").groupBy("session_id", "uuid").agg(F.max("timestamp").alias("timestamp"))
    return X.save_points(m, 3)


def event_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    w = X.event_counts(e)
    return w.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def file_chunks(spark, sf):
    return S.chunk_files(load(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", "chunk_index", F.char_length("content").alias("size"))


def conversation_chunks(spark, sf):
    return S.chunk_conversations(load(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", "chunk_index", F.char_length("content").alias("size"))


def summaries(spark, sf):
    return D.with_summary(load(spark, sf, "documents"), "text", "wing", "room", "source").select("doc_id", "summary")


def clean_queries(spark, sf):
    @F.pandas_udf("query string, method string")
    def clean(q):
        import pandas as pd

        return pd.DataFrame([sanitize_query(x) for x in q], columns=["query", "method"])

    return load(spark, sf, "eval_items").select("item_id", clean("text").alias("c")).select("item_id", "c.query", "c.method")


def name_candidates(spark, sf):
    return N.candidates(load(spark, sf, "documents"), D.STOP_WORDS)


def sayings(spark, sf):
    own = load(spark, sf, "diary_entries").select("id", "content")
    return N.attributed(own, ["id"], "content", threshold=0.4).dropDuplicates()


def message_transcripts(spark, sf):
    """Messages of each conversation as a marked transcript; those of more than GATHERED rows are read in order instead of gathered."""
    c = load(spark, sf, "chat_messages").filter("lower(trim(sender)) in ('human', 'user', 'assistant', 'ai') and trim(text) <> ''")
    long = c.filter("conversation_uuid is not null").groupBy("conversation_uuid").agg(F.count("*").alias("n")).filter(F.col("n") > GATHERED).select("conversation_uuid")
    m = c.filter("conversation_uuid is not null").dropDuplicates(["conversation_uuid", "message_uuid"]).withColumn("sender", F.lower(F.trim("sender")))
    path = F.concat("conversation_uuid", F.lit(".json"))
    g = m.join(long, "conversation_uuid", "left_anti").groupBy("conversation_uuid").agg(F.array_sort(F.collect_list(F.struct("position", "message_uuid", "sender", "text"))).alias("m"))
    exported = g.select(path.alias("path"), F.to_json(F.transform("m", lambda x: F.struct(x["sender"].alias("sender"), x["text"].alias("text")))).alias("text"))
    short = TR.normalised(exported).select("path", "format", F.md5("transcript").alias("md5"))
    rows = m.join(long, "conversation_uuid", "left_semi").select(path.alias("path"), F.struct("position", "message_uuid").alias("place"), "sender", "text", F.to_json(F.struct("sender", "text")).alias("item"))
    return short.unionByName(TR.exported_digests(rows, partitions(spark)))


def greedy_dedup(spark, sf):
    """Documents of one source nearer than 0.15, the longest kept."""
    docs = load(spark, sf, "documents").select(F.col("doc_id"), "source", "text").join(load(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    near = retrieval.near_pairs(docs, "doc_id", "source", 0.15)
    return R.greedy_kept(docs, near, "source", "text", "doc_id")


#: Rooms of the mined corpus.
ROOMS = [{"name": "code", "keywords": ["function", "class", "import"]}, {"name": "planning", "keywords": ["plan", "deadline", "meeting"]}]


def mined_sources(spark, sf):
    """(source_file, n_records, n_sentinels) after the documents are mined twice into a store that already has some of them."""
    d = load(spark, sf, "documents")
    files = d.select(F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"), F.unix_seconds(F.col("filed_at").cast("timestamp")).cast("double").alias("mtime"), "text")
    own = load(spark, sf, "drawers").select("id", "content", "wing", "room", "source_file", "chunk_index", "added_by", "filed_at", "normalize_version").withColumn("source_mtime", F.lit(None).cast("double"))
    once = mining.mined(files, own.filter("source_file is null"), "corpus", ROOMS, "miner", "2026-01-01T00:00:00")
    again = mining.mined(files, once.store, "corpus", ROOMS, "miner", "2026-01-02T00:00:00")
    sentinel = P.is_registry_row()
    return again.store.filter("source_file is not null").groupBy("source_file").agg(F.sum(F.when(sentinel, 0).otherwise(1)).alias("n_records"), F.sum(F.when(sentinel, 1).otherwise(0)).alias("n_sentinels"))


QUERIES = {f.__name__: f for f in (sweep_increment, sweep_totals, save_points, event_windows, file_chunks, conversation_chunks, summaries, clean_queries, name_candidates, sayings, message_transcripts, greedy_dedup, mined_sources)}

_M = """m AS (SELECT session_id, uuid, role, content, max(strftime(timezone('UTC', timestamp), '%Y-%m-%dT%H:%M:%S.%g')) AS ts FROM messages WHERE role IN ('user', 'assistant') AND trim(content) <> '' AND timestamp IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_STATE = f"""{_M}, k AS (SELECT session_id, max(ts) AS cur FROM m WHERE ts < '{CURSOR}' GROUP BY 1),
    s AS (SELECT DISTINCT 'sweep_' || session_id || '_' || uuid AS id, CASE WHEN cur IS NOT NULL AND ts < cur THEN 'skipped' WHEN ts < '{CURSOR}' THEN 'present' ELSE 'added' END AS state FROM m LEFT JOIN k USING (session_id))"""
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in D.STOP_WORDS)
ORACLES = {
    "sweep_increment": f"WITH {_STATE} SELECT id, state FROM s",
    "sweep_totals": f"WITH {_STATE} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'present') AS present, count(*) FILTER (state <> 'skipped') AS upserted, count(*) FILTER (state = 'skipped') AS skipped FROM s",
    "save_points": """WITH m AS (SELECT session_id, uuid, max(timestamp) AS ts FROM messages WHERE role = 'user' AND timestamp IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY ts, uuid) - 1) // 3 AS save FROM m) SELECT session_id, save, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) = 3""",
    "event_windows": """SELECT CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) * 3600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "name_candidates": rf"""WITH d AS (SELECT regexp_replace(coalesce(text, ''), '[^\x00-\x7F\pP\pS\pZ\pC]', '_', 'g') AS t FROM documents),  -- letters beyond ASCII end no word
        f AS (SELECT unnest(list_concat(regexp_extract_all(t, '{N._SINGLE}'), regexp_extract_all(t, '{N._PHRASE}'))) AS name FROM d)
        SELECT name, count(*) AS n FROM f WHERE NOT list_has_any(regexp_split_to_array(lower(name), '\s+'), [{_STOP}]) GROUP BY 1 HAVING count(*) >= 3""",
}
