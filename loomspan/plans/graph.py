"""Queries over graphs derived from records."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import graph as G
from loomspan.plans.records import _D, meta
from loomspan.tables import load

NOW = "2027-01-01 00:00:00"


def _nodes(spark, sf):
    return G.room_nodes(meta(spark, sf).select("id", "room", "wing", "hall", F.substring("filed_at", 1, 10).alias("date")))


def room_nodes(spark, sf):
    return _nodes(spark, sf).select("room", *[F.array_join(c, ",").alias(c) for c in ("wings", "halls", "dates")], "n")


def room_edges(spark, sf):
    return G.room_edges(_nodes(spark, sf))


def tunnel_rooms(spark, sf):
    return G.tunnel_rooms(_nodes(spark, sf), "alderline", "Brackwater").select("room", "n")


def graph_stats(spark, sf):
    return G.graph_stats(_nodes(spark, sf))


def rooms_per_wing(spark, sf):
    return G.rooms_per_wing(_nodes(spark, sf))


def _event_nodes(spark, sf):
    """A user is a room, a wing is a stretch of two minutes and an event type."""
    e = spark.read.parquet(f"{sf}/events.parquet").filter("user_id is not null")
    wing = F.concat(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 120_000_000).cast("string"), F.lit("/"), F.coalesce("event_type", F.lit("")))
    return G.room_nodes(e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("room"), wing.alias("wing"), F.col("event_type").alias("hall"), F.lit(None).cast("string").alias("date")))


def bfs_rooms(spark, sf):
    return G.walk(_event_nodes(spark, sf), "1", 2, 1000).select("room", "hop", "n")


def fuzzy_rooms(spark, sf):
    return G.fuzzy_rooms(_nodes(spark, sf), "plan-diary")


def cooccurrences(spark, sf):
    return G.cooccurrences(meta(spark, sf)).select("id", "wing", "entity_a", "entity_b", "n", F.array_join("rooms", ",").alias("rooms"))


def topic_tunnels(spark, sf):
    own = load(spark, sf, "diary_entries").select("wing", "topic").filter("wing is not null and topic is not null")
    return G.topic_tunnels(own, 3)


def entity_tunnels(spark, sf):
    return G.entity_tunnels(G.cooccurrences(meta(spark, sf)))


def _edges(spark, sf):
    """Users as connections, made at their first event; every later event is an access."""
    e = spark.read.parquet(f"{sf}/events.parquet").filter("user_id is not null").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    edges = e.groupBy("id").agg(F.min("at").alias("created_at"))
    return G.with_dynamics(edges), e


def potentiate_batch(spark, sf):
    edges, e = _edges(spark, sf)
    p = G.potentiated(edges, e)
    return p.select("id", F.round("strength", 6).alias("strength"), F.round("stability", 6).alias("stability"), "access_count")


def decay_view(spark, sf):
    edges, e = _edges(spark, sf)
    p = G.potentiated(edges, e)
    s = G.decayed(F.col("strength"), F.lit(400.0), F.col("last_activated"), F.to_timestamp(F.lit(NOW)))
    return p.select("id", F.round(s, 6).alias("strength"))


def decay_stats(spark, sf):
    edges, e = _edges(spark, sf)
    return G.decay_stats(G.potentiated(edges, e), F.to_timestamp(F.lit(NOW)))


QUERIES = {f.__name__: f for f in (room_nodes, room_edges, tunnel_rooms, graph_stats, rooms_per_wing, bfs_rooms, fuzzy_rooms, cooccurrences, topic_tunnels, entity_tunnels, potentiate_batch, decay_view, decay_stats)}

_N = f"""d AS ({_D}), n AS (SELECT room, list_sort(list(DISTINCT wing)) AS wings, coalesce(list_sort(list(DISTINCT hall) FILTER (hall <> '')), []) AS halls, count(*) AS n,
    coalesce(list_sort(list(DISTINCT substr(filed_at, 1, 10)) FILTER (filed_at <> '')), []) AS dates FROM d WHERE room <> '' AND room <> 'general' AND wing <> '' GROUP BY 1)"""
_PAIRS = f"""d AS ({_D}), x AS (SELECT id, wing, room, list_sort(list_distinct(list_filter(list_transform(string_split(entities, ';'), lambda v: trim(v)), lambda v: v <> ''))) AS e FROM d WHERE wing IS NOT NULL AND entities IS NOT NULL),
    u AS (SELECT id, wing, room, unnest(e) AS a FROM x), p AS (SELECT u.id, u.wing, u.room, u.a, v.a AS b FROM u JOIN u v ON v.id = u.id AND u.a < v.a),
    h AS (SELECT wing, a, b, count(*) AS n, array_to_string(coalesce(list_sort(list(DISTINCT room) FILTER (trim(room) <> '')), []), ',') AS rooms FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
_TID = "substr(sha256(least(wing_a || '/' || room, wing_b || '/' || room) || '↔' || greatest(wing_a || '/' || room, wing_b || '/' || room)), 1, 16)"
_POT = """e AS (SELECT user_id AS id, ts AS tm, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts), min(ts) OVER (PARTITION BY user_id)) AS prev FROM events WHERE user_id IS NOT NULL),
    p AS (SELECT id, least(5.0, 1.0 + 0.05 * count(*)) AS strength, 1.0 + 0.1 * sum(CASE WHEN epoch_us(tm) - epoch_us(prev) >= 3600000000 THEN 1 ELSE 0 END) AS stability, count(*) AS access_count, max(tm) AS last FROM e GROUP BY 1)"""
_DAYS = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(last)) / 86400000000.0"

ORACLES = {
    "room_nodes": f"WITH {_N} SELECT room, array_to_string(wings, ',') AS wings, array_to_string(halls, ',') AS halls, array_to_string(dates[-5:], ',') AS dates, n FROM n",
    "room_edges": f"""WITH {_N}, w AS (SELECT room, n, halls, unnest(wings) AS wing FROM n), p AS (SELECT a.room, a.n, a.halls, a.wing AS wing_a, b.wing AS wing_b FROM w a JOIN w b ON a.room = b.room AND a.wing < b.wing)
        SELECT room, wing_a, wing_b, unnest(halls) AS hall, n FROM p""",
    "tunnel_rooms": f"WITH {_N} SELECT room, n FROM n WHERE len(wings) >= 2 AND list_contains(wings, 'alderline') AND list_contains(wings, 'brackwater') ORDER BY n DESC, room LIMIT 50",
    "graph_stats": f"WITH {_N} SELECT count(*) AS total_rooms, count(*) FILTER (len(wings) >= 2) AS tunnel_rooms, CAST(sum(len(wings) * (len(wings) - 1) // 2 * len(halls)) AS BIGINT) AS total_edges FROM n",
    "rooms_per_wing": f"WITH {_N} SELECT wing, count(*) AS rooms FROM (SELECT unnest(wings) AS wing FROM n) GROUP BY 1",
    "bfs_rooms": """WITH RECURSIVE m AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS room, CAST(CAST(floor(epoch_us(ts) / 120000000) AS BIGINT) AS VARCHAR) || '/' || coalesce(event_type, '') AS wing FROM events WHERE user_id IS NOT NULL),
        c AS (SELECT CAST(user_id AS VARCHAR) AS room, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1),
        r AS (SELECT '1' AS room, 0 AS hop UNION SELECT b.room, r.hop + 1 FROM r JOIN m a ON a.room = r.room JOIN m b ON b.wing = a.wing WHERE r.hop < 2)
        SELECT room, hop, n FROM (SELECT room, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY 1) JOIN c USING (room) ORDER BY hop, n DESC, room LIMIT 1000""",
    "fuzzy_rooms": f"WITH {_N} SELECT room, CASE WHEN contains(room, 'plan-diary') THEN 1.0 ELSE 0.5 END AS score FROM n WHERE contains(room, 'plan') OR contains(room, 'diary') ORDER BY score DESC, room LIMIT 5",
    "cooccurrences": f"WITH {_PAIRS} SELECT 'hallway_' || wing || '_' || a || '_' || b || '_' || substr(sha256(wing || '::' || a || '::' || b), 1, 8) AS id, wing, a AS entity_a, b AS entity_b, n, rooms FROM h",
    "topic_tunnels": f"""WITH k AS (SELECT translate(lower(trim(wing)), ' -', '__') AS wing, lower(trim(topic)) AS key, min(trim(topic)) AS topic FROM diary_entries WHERE trim(wing) <> '' AND trim(topic) <> '' GROUP BY 1, 2),
        p AS (SELECT a.wing AS wing_a, b.wing AS wing_b, 'topic:' || a.key AS room, a.topic, count(*) OVER (PARTITION BY a.wing, b.wing) AS shared FROM k a JOIN k b ON a.key = b.key AND a.wing < b.wing)
        SELECT {_TID} AS id, wing_a, wing_b, room, 'topic' AS kind, 'shared topic: ' || topic AS label FROM p WHERE shared >= 3""",
    "entity_tunnels": f"""WITH {_PAIRS}, k AS (SELECT DISTINCT translate(lower(trim(wing)), ' -', '__') AS wing, unnest([a, b]) AS entity FROM h),
        q AS (SELECT a.wing AS wing_a, b.wing AS wing_b, 'entity:' || a.entity AS room, a.entity FROM k a JOIN k b ON a.entity = b.entity AND a.wing < b.wing)
        SELECT {_TID} AS id, wing_a, wing_b, room, 'entity' AS kind, 'shared entity: ' || entity AS label FROM q""",
    "potentiate_batch": f"WITH {_POT} SELECT id, round(strength, 6) AS strength, round(stability, 6) AS stability, access_count FROM p",
    "decay_view": f"WITH {_POT} SELECT id, round(CASE WHEN {_DAYS} > 0 THEN greatest(0.05, strength * exp(-({_DAYS}) / 400.0)) ELSE strength END, 6) AS strength FROM p",
    "decay_stats": f"""WITH {_POT}, s AS (SELECT CASE WHEN {_DAYS} > 0 THEN greatest(0.05, strength * exp(-({_DAYS}) / stability)) ELSE strength END AS s FROM p)
        SELECT count(*) AS edges, round(avg(s), 6) AS mean_strength, count(*) FILTER (s <= 0.05) AS at_floor, count(*) FILTER (s >= 5.0) AS at_max FROM s""",
}
