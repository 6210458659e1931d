"""Problem 4: conversations rebuilt from message rows.

Rows are an event log: all rows of one message id are folded to its last
version (by time, rows without a time first; an edit to blank text deletes the
turn but keeps its place). Conversations of up to MOST_ROWS rows are gathered
whole and ordered in one step. Longer ones are never gathered: their places
come from pointer doubling over the parents, and turns are numbered and checked
in blocks, ranges of the rows in order of (conversation, place, time, id), whose
summaries are joined per conversation. A conversation of any share of the rows,
or one first row with any number of replies, lies in many such ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.runtime import checkpointed, partitions
from loomspan.tables import load

#: Rows up to which a conversation is ordered by one task.
MOST_ROWS = 10_000
#: Rows of a block of longer conversations, about.
BLOCK = 200_000

# Spellings of the two speaking roles.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}


def role_of(name: Column) -> Column:
    """user, assistant or null, whatever the case and surrounding blanks."""
    plain = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    return F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[plain]


def _spoken(text: Column) -> Column:
    return F.coalesce(F.trim(text, F.lit(" \t\r\n")) != "", F.lit(False))


def message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "messages")
    role = role_of(F.coalesce("role", "type"))
    return m.select(
        F.col("session_id").alias("conversation_id"), F.col("uuid").alias("message_id"), F.col("parent_uuid").alias("parent"), F.lit(None).cast("int").alias("position"),
        F.when(_spoken(F.col("content")), role).alias("role"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), F.col("content").alias("text"),
    )


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "chat_messages")
    return c.select(
        F.col("conversation_uuid").alias("conversation_id"), F.col("message_uuid").alias("message_id"), F.lit(None).cast("string").alias("parent"), "position",
        F.when(_spoken(F.col("text")), role_of(F.col("sender"))).alias("role"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "text",
    )


def fold(events: list[tuple]) -> dict[str, tuple]:
    """Last version of each message, from (message_id, parent, position, role, at)."""
    last: dict[str, tuple] = {}
    for e in events:
        rank = tuple((x is not None, x if x is not None else "") for x in (e[4], e[3], e[1])) + ((e[2] is not None, e[2] or 0),)
        if e[0] not in last or rank > last[e[0]][0]:
            last[e[0]] = (rank, e)
    return {k: v[1] for k, v in last.items()}


def ordered(messages: dict[str, tuple], linked: bool) -> list[tuple] | None:
    """The messages in order, or None if the conversation is broken.

    `linked`: each follows its parent; siblings are ordered by time and id
    after all rows nearer to the first row. Otherwise by position.
    """
    rows = list(messages.values())
    if not linked:
        rows.sort(key=lambda e: (e[2] is not None, e[2] or 0))
        return rows if [e[2] for e in rows] == list(range(len(rows))) else None
    roots = [e for e in rows if e[1] is None]
    if len(roots) != 1 or any(e[1] is not None and e[1] not in messages for e in rows):
        return None
    below: dict[str, list[tuple]] = {}
    for e in rows:
        if e[1] is not None:
            below.setdefault(e[1], []).append(e)
    out, level = [], roots
    while level:
        level.sort(key=lambda e: (e[4] is None, e[4] or 0, e[0]))
        out += level
        level = [x for e in level for x in below.get(e[0], [])]
    return out if len(out) == len(rows) else None  # rows in a circle are never reached


def turns(rows: list[tuple] | None) -> list[str]:
    """Message ids of the turns of a sound conversation, else nothing."""
    spoken = [e for e in rows or [] if e[3] is not None]
    if not spoken or spoken[0][3] != "user" or spoken[-1][3] == "user":
        return []
    if any(a[3] == b[3] == "user" for a, b in zip(spoken, spoken[1:])):
        return []
    return [e[0] for e in spoken]


def _short(events: DataFrame, linked: bool) -> DataFrame:
    """Turns of conversations that each fit one task."""
    grouped = events.groupBy("conversation_id").agg(F.collect_list(F.struct("message_id", "parent", "position", "role", "at")).alias("events"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conversation, rows in zip(pdf["conversation_id"], pdf["events"]):
                messages = fold([(r["message_id"], r["parent"], None if linked else r["position"], r["role"], r["at"]) for r in rows])
                out += [(conversation, i, m) for i, m in enumerate(turns(ordered(messages, linked)))]
            yield pd.DataFrame(out, columns=["conversation_id", "turn", "message_id"])

    return grouped.mapInPandas(run, "conversation_id string, turn long, message_id string")


def _folded(events: DataFrame) -> DataFrame:
    """The last version of each message, combined before the shuffle."""
    newest = F.max(F.struct("at", "role", "parent", "position")).alias("v")
    return events.groupBy("conversation_id", "message_id").agg(newest).select("conversation_id", "message_id", "v.*")


def _placed_by_parent(messages: DataFrame) -> DataFrame:
    """Adds depth by pointer doubling and tie order as `place`; conversations with rows never reached are left out."""
    here = messages.select("conversation_id", "message_id", F.col("parent").alias("above"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    here = checkpointed(here)
    # rows in a circle never end; a path is at most as long as the longest conversation
    longest = here.groupBy("conversation_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, int(longest).bit_length() + 1)):
        up = here.select("conversation_id", F.col("message_id").alias("above"), F.col("above").alias("higher"), F.col("depth").alias("more"))
        here = checkpointed(here.join(up, ["conversation_id", "above"], "left").select("conversation_id", "message_id", F.col("higher").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        if not here.filter("above is not null").limit(1).collect():
            break
    circular = here.filter("above is not null").select("conversation_id").distinct()
    known = messages.select("conversation_id", F.col("message_id").alias("parent"), F.lit(True).alias("known"))
    checked = messages.join(known, ["conversation_id", "parent"], "left")
    lost = (F.col("parent").isNotNull() & F.col("known").isNull()).cast("int")
    health = checked.groupBy("conversation_id").agg(F.sum(lost).alias("lost"), F.sum(F.col("parent").isNull().cast("int")).alias("first_rows"))
    whole = health.filter("lost = 0 and first_rows = 1").join(circular, "conversation_id", "left_anti").select("conversation_id")
    placed = messages.join(here.select("conversation_id", "message_id", "depth"), ["conversation_id", "message_id"]).join(whole, "conversation_id", "left_semi")
    return placed.select("conversation_id", "message_id", "role", F.col("depth").alias("place"), "at")


def _placed_by_position(messages: DataFrame) -> DataFrame:
    count = messages.groupBy("conversation_id", "position").agg(F.count("*").alias("n"))
    whole = count.groupBy("conversation_id").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count("*").alias("places"), F.max("n").alias("most"), F.sum(F.col("position").isNull().cast("int")).alias("none"))
    sound = whole.filter("a = 0 and b = places - 1 and most = 1 and none = 0").select("conversation_id")
    return messages.join(sound, "conversation_id", "left_semi").select("conversation_id", "message_id", "role", F.col("position").cast("long").alias("place"), "at")


def _long(events: DataFrame, linked: bool) -> DataFrame:
    """The same turns for conversations of any length, without gathering one."""
    messages = checkpointed(_folded(events))
    placed = _placed_by_parent(messages) if linked else _placed_by_position(messages)
    order = ["conversation_id", "place", F.col("at").isNull(), "at", "message_id"]
    ranges = max(partitions(events.sparkSession), -(-messages.count() // BLOCK))
    # written once, so that a row's range doesn't change between the reads below
    ranged = checkpointed(placed.filter("role is not null").repartitionByRange(ranges, *order).withColumn("block", F.spark_partition_id()))
    inside = W.partitionBy("conversation_id", "block").orderBy(*order[1:])
    rows = ranged.withColumn("n", F.row_number().over(inside)).withColumn("before", F.lag("role").over(inside))
    summary = rows.groupBy("conversation_id", "block").agg(F.count("*").alias("size"), F.max_by("role", "n").alias("final"))
    along = W.partitionBy("conversation_id").orderBy("block")
    earlier = summary.select("conversation_id", "block", F.coalesce(F.sum("size").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lag("final").over(along).alias("final"))
    numbered = rows.join(earlier, ["conversation_id", "block"]).select("conversation_id", "message_id", "role", (F.col("offset") + F.col("n") - 1).alias("turn"), F.coalesce("before", "final").alias("before"))
    wrong = F.when(F.col("before").isNull(), F.col("role") != "user").otherwise((F.col("before") == "user") & (F.col("role") == "user"))
    verdict = numbered.groupBy("conversation_id").agg(F.max(wrong.cast("int")).alias("wrong"), F.max_by("role", "turn").alias("final"))
    sound = verdict.filter("wrong = 0 and final = 'assistant'").select("conversation_id")
    return numbered.join(sound, "conversation_id", "left_semi").select("conversation_id", "turn", "message_id")


def rebuild(events: DataFrame, linked: bool, most_rows: int = MOST_ROWS) -> DataFrame:
    """(conversation_id, turn, message_id) of all sound conversations.

    Broken are: a parent that isn't there, none or several first rows, rows in
    a circle (linked), positions that aren't 0, 1, 2 ... (otherwise). Dropped
    are also conversations without turns, whose first turn isn't the user's or
    in which a user's turn isn't followed by the assistant's. Rows without a
    conversation or message id are left out.
    """
    own = events.filter("conversation_id is not null and message_id is not null").drop("text")
    sizes = own.groupBy("conversation_id").count().filter(F.col("count") > most_rows).select("conversation_id")
    if not sizes.limit(1).collect():  # the only way to know; one column, combined before the shuffle
        return _short(own, linked)
    return _short(own.join(sizes, "conversation_id", "left_anti"), linked).unionByName(_long(own.join(sizes, "conversation_id", "left_semi"), linked))


def _sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, bool]]:
    return [("messages", message_events(spark, sf_dir), True), ("chat_messages", chat_events(spark, sf_dir), False)]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, conversation_id, turn, message_id) of the turns of all sound conversations."""
    parts = [rebuild(e, linked).select(F.lit(name).alias("source_table"), "conversation_id", "turn", "message_id") for name, e, linked in _sources(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts)


def p4_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, conversation_id, turn, role, message_id, text): the turns with their last texts."""
    parts = []
    for name, e, linked in _sources(spark, sf_dir):
        newest = e.groupBy("conversation_id", "message_id").agg(F.max(F.struct("at", "role", "text")).alias("v"))
        texts = newest.select("conversation_id", "message_id", "v.role", "v.text")
        parts.append(rebuild(e, linked).join(texts, ["conversation_id", "message_id"]).select(F.lit(name).alias("source_table"), "conversation_id", "turn", "role", "message_id", "text"))
    return reduce(DataFrame.unionByName, parts)


P4_FOUND_SQL = r"""
WITH RECURSIVE m AS (
  SELECT session_id AS conv, uuid AS id, parent_uuid AS parent,
    CASE WHEN trim(coalesce(content, ''), E' \t\r\n') = '' THEN NULL
         WHEN lower(trim(coalesce(role, type), E' \t\r\n')) IN ('user', 'human') THEN 'user'
         WHEN lower(trim(coalesce(role, type), E' \t\r\n')) IN ('assistant', 'ai') THEN 'assistant' END AS role
  FROM messages QUALIFY row_number() OVER (PARTITION BY session_id, uuid ORDER BY timestamp DESC NULLS LAST, role DESC NULLS LAST) = 1
), whole AS (
  SELECT m.conv FROM m LEFT JOIN m p ON p.conv = m.conv AND p.id = m.parent GROUP BY m.conv
  HAVING count(*) FILTER (m.parent IS NOT NULL AND p.id IS NULL) = 0 AND count(*) FILTER (m.parent IS NULL) = 1
), walk AS (
  SELECT m.conv, m.id, m.role, 0 AS place FROM m SEMI JOIN whole ON whole.conv = m.conv WHERE m.parent IS NULL
  UNION ALL SELECT m.conv, m.id, m.role, walk.place + 1 FROM m JOIN walk ON walk.conv = m.conv AND walk.id = m.parent
), c AS (
  SELECT conversation_uuid AS conv, message_uuid AS id, position,
    CASE WHEN trim(coalesce(text, ''), E' \t\r\n') = '' THEN NULL
         WHEN lower(trim(sender, E' \t\r\n')) IN ('user', 'human') THEN 'user'
         WHEN lower(trim(sender, E' \t\r\n')) IN ('assistant', 'ai') THEN 'assistant' END AS role
  FROM chat_messages QUALIFY row_number() OVER (PARTITION BY conversation_uuid, message_uuid ORDER BY created_at DESC NULLS LAST) = 1
), listed AS (
  SELECT 'messages' AS source_table, conv, id, role, place FROM walk
  UNION ALL
  SELECT 'chat_messages', conv, id, role, position FROM c
  WHERE conv IN (SELECT conv FROM c GROUP BY conv HAVING min(position) = 0 AND max(position) = count(*) - 1 AND count(DISTINCT position) = count(*))
), spoken AS (
  SELECT *, row_number() OVER w - 1 AS turn, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM listed WHERE role IS NOT NULL WINDOW w AS (PARTITION BY source_table, conv ORDER BY place)
)
SELECT source_table, conv AS conversation_id, turn, id AS message_id FROM spoken
WHERE (source_table, conv) NOT IN (
  SELECT (source_table, conv) FROM spoken
  WHERE (before IS NULL AND role <> 'user') OR (role = 'user' AND coalesce(after, '') <> 'assistant'))
"""

P4_CONVERSATIONS_SQL = rf"""
WITH texts AS (
  SELECT 'messages' AS source_table, session_id AS conversation_id, uuid AS message_id, content AS text, coalesce(role, type) AS name, epoch_us(timestamp) AS at_us FROM messages
  UNION ALL SELECT 'chat_messages', conversation_uuid, message_uuid, text, sender, epoch_us(created_at) FROM chat_messages
), roles AS (
  SELECT *, CASE WHEN trim(coalesce(text, ''), E' \t\r\n') = '' THEN NULL
    WHEN lower(trim(name, E' \t\r\n')) IN ('user', 'human') THEN 'user' WHEN lower(trim(name, E' \t\r\n')) IN ('assistant', 'ai') THEN 'assistant' END AS role FROM texts
), newest AS (
  SELECT * FROM roles QUALIFY row_number() OVER (PARTITION BY source_table, conversation_id, message_id ORDER BY at_us DESC NULLS LAST, role DESC NULLS LAST, text DESC NULLS LAST) = 1
)
SELECT source_table, conversation_id, turn, role, message_id, text FROM ({P4_FOUND_SQL}) JOIN newest USING (source_table, conversation_id, message_id)
"""
