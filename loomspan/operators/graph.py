"""Graphs over records: rooms and wings, co-occurring entities, tunnels, walks and connection strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions.text import listed, slug
from loomspan.runtime import checkpointed


def room_nodes(records: DataFrame) -> DataFrame:
    """(room, wings, halls, n, dates) of each room with a wing; not general or blank ones.

    `records` (id, room, wing, hall, date), a row a record. Wings, halls and
    the last five dates are sorted lists. Sets are small vocabularies.
    """
    own = records.filter("room <> '' and room <> 'general' and wing <> ''").groupBy("room", "wing", "hall", "date").agg(F.count("*").alias("n"))
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    dates = F.array_sort(F.collect_set(F.when(F.col("date") != "", F.col("date"))))
    return own.groupBy("room").agg(some("wing").alias("wings"), some("hall").alias("halls"), F.sum("n").alias("n"), F.slice(F.reverse(dates), 1, 5).alias("last")).select("room", "wings", "halls", "n", F.reverse("last").alias("dates"))


def room_edges(nodes: DataFrame) -> DataFrame:
    """(room, wing_a, wing_b, hall, n): pairs of a room's wings, for each of its halls; a room without halls has none."""
    left = nodes.select("room", "halls", "n", "wings", F.posexplode("wings").alias("i", "wing_a"))
    pairs = left.select("room", "halls", "n", "wing_a", F.explode(F.slice("wings", F.col("i") + 2, F.size("wings"))).alias("wing_b"))
    return pairs.select("room", "wing_a", "wing_b", F.explode("halls").alias("hall"), "n")


def tunnel_rooms(nodes: DataFrame, wing_a: str | None = None, wing_b: str | None = None, most: int = 50) -> DataFrame:
    """Rooms of two wings or more, with both given wings, the fullest first."""
    out = nodes.filter(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        if wing:
            out = out.filter(F.array_contains(F.transform("wings", slug), wing.lower().replace(" ", "_").replace("-", "_")))
    return out.orderBy(F.desc("n"), "room").limit(most)


def graph_stats(nodes: DataFrame) -> DataFrame:
    """One row (total_rooms, tunnel_rooms, total_edges)."""
    size = F.size("wings")
    return nodes.agg(F.count("*").alias("total_rooms"), F.count_if(size >= 2).alias("tunnel_rooms"), F.coalesce(F.sum((size * (size - 1) / 2).cast("bigint") * F.size("halls")), F.lit(0)).alias("total_edges"))


def rooms_per_wing(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("rooms"))


def walk(nodes: DataFrame, start: str, hops: int = 2, most: int = 50) -> DataFrame:
    """(room, hop, n, connected_via) reached from a room over shared wings, the nearest and fullest first.

    connected_via are wings shared with a room of the hop before. Each hop is
    two joins on wings and an anti join; wings seen are not walked again.
    """
    wings = nodes.select("room", F.explode("wings").alias("wing"))
    reached = checkpointed(nodes.filter(F.col("room") == start).select("room", F.lit(0).alias("hop"), F.array().cast("array<string>").alias("connected_via")))
    frontier = reached
    for hop in range(1, hops + 1):
        near = wings.join(frontier.select("room"), "room", "left_semi").select("wing").distinct()
        found = wings.join(near, "wing").join(reached.select("room"), "room", "left_anti").groupBy("room").agg(F.array_sort(F.collect_set("wing")).alias("connected_via"))
        frontier = checkpointed(found.select("room", F.lit(hop).alias("hop"), "connected_via"))
        reached = checkpointed(reached.unionByName(frontier))
    return reached.join(nodes.select("room", "n"), "room").orderBy("hop", F.desc("n"), "room").limit(most)


def fuzzy_rooms(nodes: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(room, score): 1.0 for rooms that contain the query, 0.5 for those with a part of it between hyphens."""
    q = query.lower()
    part = F.lit(False)
    for word in q.split("-"):
        part = part | F.col("room").contains(word)
    score = F.when(F.col("room").contains(q), 1.0).when(part, 0.5)
    return nodes.select("room", score.alias("score")).filter("score is not null").orderBy(F.desc("score"), "room").limit(most)


def cooccurrences(records: DataFrame, least: int = 2) -> DataFrame:
    """(id, wing, entity_a, entity_b, n, rooms, label): pairs of entities in one record, within a wing.

    `records` (id, wing, room, entities), a row a record, entities joined by
    `;`. A record's entities are few (25 at most where they are written), so
    its pairs are made in place; counts are combined before the shuffle.
    """
    own = records.select("wing", F.when(F.trim("room") != "", F.col("room")).alias("room"), F.array_sort(listed(F.col("entities"))).alias("e")).filter("wing is not null").filter(F.size("e") >= 2)
    left = own.select("wing", "room", "e", F.posexplode("e").alias("i", "entity_a"))
    pairs = left.select("wing", "room", "entity_a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("entity_b"))
    by_room = pairs.groupBy("wing", "entity_a", "entity_b", "room").agg(F.count("*").alias("n"))
    out = by_room.groupBy("wing", "entity_a", "entity_b").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("room")).alias("rooms")).filter(F.col("n") >= max(1, least))
    key = F.concat_ws("::", "wing", "entity_a", "entity_b")
    size = F.size("rooms")
    shown = F.when(size == 0, "(no room tags)").otherwise(F.concat(F.array_join(F.slice("rooms", 1, 3), ", "), F.when(size > 3, F.concat(F.lit(", +"), (size - 3).cast("string"), F.lit(" more"))).otherwise("")))
    label = F.concat(F.col("entity_a"), F.lit(" ↔ "), F.col("entity_b"), F.lit(" ("), F.col("n").cast("string"), F.lit(" records: "), shown, F.lit(")"))
    ident = F.concat(F.lit("hallway_"), F.concat_ws("_", "wing", "entity_a", "entity_b"), F.lit("_"), F.substring(F.sha2(key, 256), 1, 8))
    return out.select(ident.alias("id"), "wing", "entity_a", "entity_b", "n", "rooms", label.alias("label"))


def tunnel_id(wing_a: Column, room_a: Column, wing_b: Column, room_b: Column) -> Column:
    """An id that is the same for both directions."""
    a, b = F.concat_ws("/", wing_a, room_a), F.concat_ws("/", wing_b, room_b)
    return F.substring(F.sha2(F.concat(F.least(a, b), F.lit("↔"), F.greatest(a, b)), 256), 1, 16)


def _linked(by_wing: DataFrame, key: str, kind: str, shown: str, least: int, room: Column) -> DataFrame:
    a = by_wing.select(F.col("wing").alias("wing_a"), key, F.col(shown).alias("name"))
    b = by_wing.select(F.col("wing").alias("wing_b"), key)
    pairs = a.join(b, key).filter("wing_a < wing_b")
    if least > 1:
        enough = pairs.groupBy("wing_a", "wing_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
        pairs = pairs.join(enough, ["wing_a", "wing_b"], "left_semi")
    return pairs.select(tunnel_id(F.col("wing_a"), room, F.col("wing_b"), room).alias("id"), "wing_a", "wing_b", room.alias("room"), F.lit(kind).alias("kind"), F.concat(F.lit(f"shared {kind}: "), F.col("name")).alias("label"))


def topic_tunnels(topics: DataFrame, least: int = 1, wing: str | None = None) -> DataFrame:
    """(id, wing_a, wing_b, room, kind, label): wings that share `least` topics or more, a row a topic.

    `topics` (wing, topic); topics match whatever the case. Wings are few, so
    a topic has a row for each of its wings, whatever the number of records.
    """
    own = topics.filter("trim(wing) <> '' and trim(topic) <> ''").groupBy(slug(F.trim("wing")).alias("wing"), F.lower(F.trim("topic")).alias("key")).agg(F.min(F.trim("topic")).alias("topic"))
    out = _linked(own, "key", "topic", "topic", max(1, least), F.concat(F.lit("topic:"), F.col("key")))
    return out if wing is None else out.filter((F.col("wing_a") == wing) | (F.col("wing_b") == wing))


def entity_tunnels(hallways: DataFrame, wing: str | None = None) -> DataFrame:
    """The same for entities that lie in hallways (wing, entity_a, entity_b) of two wings."""
    own = hallways.select(slug(F.trim("wing")).alias("wing"), F.explode(F.array("entity_a", "entity_b")).alias("entity")).filter("trim(entity) <> ''").distinct()
    out = _linked(own, "entity", "entity", "entity", 1, F.concat(F.lit("entity:"), F.col("entity")))
    return out if wing is None else out.filter((F.col("wing_a") == wing) | (F.col("wing_b") == wing))


def upserted_tunnels(stored: DataFrame, added: DataFrame) -> DataFrame:
    """`stored` with `added` (source_wing, source_room, target_wing, target_room, label, kind, at) by symmetric id.

    created_at and the dynamics of a tunnel that is there stay.
    """
    new = added.withColumn("id", tunnel_id(slug(F.col("source_wing")), F.col("source_room"), slug(F.col("target_wing")), F.col("target_room")))
    last = new.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("at"), "label"))).filter("n = 1").drop("n")
    keep = stored.select("id", F.col("created_at").alias("was"), "strength", "stability", "last_activated", "access_count")
    merged = last.join(keep, "id", "left").select(
        "id", "source_wing", "source_room", "target_wing", "target_room", "label", "kind", F.coalesce("was", "at").alias("created_at"), F.when(F.col("was").isNotNull(), F.col("at")).alias("updated_at"),
        F.coalesce("strength", F.lit(1.0)).alias("strength"), F.coalesce("stability", F.lit(1.0)).alias("stability"), F.coalesce("last_activated", "at").alias("last_activated"), F.coalesce("access_count", F.lit(0).cast("bigint")).alias("access_count"),
    )
    return stored.join(last.select("id"), "id", "left_anti").unionByName(merged)


def followed(tunnels: DataFrame, wing: str, room: str, records: DataFrame | None = None) -> DataFrame:
    """(tunnel_id, direction, connected_wing, connected_room, label, preview) of a place's tunnels; the source end wins."""
    own = wing.lower().replace(" ", "_").replace("-", "_")
    at = lambda w, r: (slug(F.col(w)) == own) & (F.col(r) == room)
    side = F.when(at("source_wing", "source_room"), "outgoing").when(at("target_wing", "target_room"), "incoming")
    hit = tunnels.withColumn("direction", side).filter("direction is not null")
    far = lambda c: F.when(F.col("direction") == "outgoing", F.col(f"target_{c}")).otherwise(F.col(f"source_{c}"))
    out = hit.select(F.col("id").alias("tunnel_id"), "direction", far("wing").alias("connected_wing"), far("room").alias("connected_room"), "label", far("drawer_id").alias("drawer_id") if "target_drawer_id" in tunnels.columns else F.lit(None).cast("string").alias("drawer_id"))
    if records is None:
        return out.withColumn("preview", F.lit(None).cast("string"))
    return out.join(records.select(F.col("id").alias("drawer_id"), F.substring("content", 1, 300).alias("preview")), "drawer_id", "left")


# ---- connection strength ----------------------------------------------------

# Fixed values of the decay and reinforcement of connections.
FLOOR, CEILING, GROWTH, SPACED_HOURS, STEADIER = 0.05, 5.0, 0.05, 1.0, 0.1


def with_dynamics(edges: DataFrame) -> DataFrame:
    """Defaults for the dynamics that an edge lacks; those it has stay."""
    has = set(edges.columns)
    value = lambda c, d: (F.coalesce(F.col(c), d) if c in has else d).alias(c)
    own = [c for c in edges.columns if c not in ("strength", "stability", "last_activated", "access_count")]
    return edges.select(*own, value("strength", F.lit(1.0)), value("stability", F.lit(1.0)), value("last_activated", F.col("created_at")), value("access_count", F.lit(0).cast("bigint")))


def potentiated(edges: DataFrame, accesses: DataFrame) -> DataFrame:
    """`edges` (id, strength, stability, last_activated, access_count) after all `accesses` (id, at), in order of time.

    Each adds GROWTH up to CEILING; one at least an hour after the one before
    also adds to stability. Increments are equal, so sums do.
    """
    joined = accesses.join(edges.select("id", "last_activated"), "id").filter("at is not null")
    before = F.coalesce(F.lag("at").over(W.partitionBy("id").orderBy("at")), F.col("last_activated"))
    spaced = F.coalesce((F.unix_micros("at") - F.unix_micros(before)) / 3.6e9 >= SPACED_HOURS, F.lit(False))
    sums = joined.select("id", "at", spaced.alias("spaced")).groupBy("id").agg(F.count("*").alias("n"), F.count_if("spaced").alias("steps"), F.max("at").alias("last"))
    out = edges.join(sums, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        *[c for c in edges.columns if c not in ("strength", "stability", "last_activated", "access_count")],
        F.when(n > 0, F.least(F.lit(CEILING), F.col("strength") + GROWTH * n)).otherwise(F.col("strength")).alias("strength"),
        (F.col("stability") + STEADIER * F.coalesce("steps", F.lit(0))).alias("stability"),
        F.coalesce("last", "last_activated").alias("last_activated"),
        (F.col("access_count") + n).alias("access_count"),
    )


def decayed(strength: Column, stability: Column, last: Column, now: Column) -> Column:
    """Strength at `now`: falls by exp(-days / stability), never under the floor; unchanged before `last`.

    The stored strength stays, so any number of calls for one time agree.
    """
    days = (F.unix_micros(now) - F.unix_micros(last)) / 8.64e10
    steady = F.when(F.coalesce(stability, F.lit(1.0)) > 0, F.coalesce(stability, F.lit(1.0))).otherwise(1.0)
    return F.when(days > 0, F.greatest(F.lit(FLOOR), strength * F.exp(-days / steady))).otherwise(strength)


def decay_stats(edges: DataFrame, now: Column) -> DataFrame:
    """One row (edges, mean_strength, at_floor, at_max) at `now`."""
    s = decayed(F.col("strength"), F.col("stability"), F.col("last_activated"), now)
    return edges.select(s.alias("s")).agg(F.count("*").alias("edges"), F.round(F.avg("s"), 6).alias("mean_strength"), F.count_if(F.col("s") <= FLOOR).alias("at_floor"), F.count_if(F.col("s") >= CEILING).alias("at_max"))
