"""Incremental filing of session messages, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sweep_id(session: Column, message: Column) -> Column:
    return F.concat(F.lit("sweep_"), session, F.lit("_"), message)


def rows_of(messages: DataFrame, label: str | None = None) -> DataFrame:
    """Records of messages (session_id, uuid, timestamp, role, content), with ids that make repeats harmless."""
    return messages.select(
        sweep_id(F.col("session_id"), F.col("uuid")).alias("id"),
        F.concat(F.upper("role"), F.lit(": "), "content").alias("content"),
        "session_id", "timestamp", F.col("uuid").alias("message_uuid"), "role", F.lit(label).cast("string").alias("source_file"), F.lit("sweep").alias("ingest_mode"),
    )


def cursors(stored: DataFrame) -> DataFrame:
    """(session_id, cursor): the greatest stored time of each session, as text."""
    return stored.filter("timestamp <> ''").groupBy("session_id").agg(F.max("timestamp").alias("cursor"))


def swept(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages as rows with `state`: added, present or skipped.

    Strictly older than the session's cursor: skipped; messages at the cursor
    are tried again, and present if their id is stored. `stored` (id, session_id, timestamp).
    """
    rows = rows_of(messages).dropDuplicates(["id"])
    joined = rows.join(cursors(stored), "session_id", "left").join(stored.select("id", F.lit(True).alias("there")).dropDuplicates(["id"]), "id", "left")
    state = F.when(F.col("cursor").isNotNull() & (F.col("timestamp") < F.col("cursor")), "skipped").when(F.col("there"), "present").otherwise("added")
    return joined.withColumn("state", state).drop("cursor", "there")


def sweep_counts(states: DataFrame) -> DataFrame:
    """One row (added, present, upserted, skipped)."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    return states.agg(is_("added").alias("added"), is_("present").alias("present"), (is_("added") + is_("present")).alias("upserted"), is_("skipped").alias("skipped"))


def sweep_stream(messages: DataFrame, folder: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Files messages (as `rows_of`, time as text) as they arrive, each id once within the delay.

    The checkpoint remembers the files read, so a restart neither loses nor
    repeats; later repeats than the delay are dropped by id on reading.
    """
    timed = messages.withColumn("event_time", F.try_to_timestamp("timestamp")).filter("event_time is not null").withWatermark("event_time", delay)
    once = timed.dropDuplicatesWithinWatermark(["session_id", "uuid"])
    return rows_of(once).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replace_sources(stream: DataFrame, folder: str, checkpoint: str, key: str = "source_file") -> StreamingQuery:
    """For each batch, the records of its sources are replaced: purge, then insert.

    Records lie in a folder a source; a source's folder is overwritten whole.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """`files` (path, text) whose content hash isn't in `state` (path, hash), with the hash."""
    hashed = files.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return hashed.join(state.select("path", "hash"), ["path", "hash"], "left_anti")


def new_entries(entries: DataFrame, state: DataFrame) -> DataFrame:
    """`entries` (path, entry_index) beyond the number of entries that `state` (path, entries) has."""
    return entries.join(state.select("path", "entries"), "path", "left").filter(F.col("entry_index") >= F.coalesce("entries", F.lit(0))).drop("entries")


def save_points(messages: DataFrame, every: int = 15) -> DataFrame:
    """(session_id, save, n): each `every` human messages of a session in order of time make a save.

    `messages` (session_id, uuid, timestamp). Sums of counts an hour give each
    message its place, so a long session isn't sorted in one task but for hours.
    """
    hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp"))
    rows = messages.select("session_id", "uuid", "timestamp", hour.alias("hour"))
    sums = rows.groupBy("session_id", "hour").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("session_id").orderBy(F.asc_nulls_last("hour")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("session_id", "hour", before.alias("offset"))
    inside = rows.withColumn("n", F.row_number().over(W.partitionBy("session_id", "hour").orderBy("timestamp", "uuid")))
    same = (inside["session_id"] == offsets["session_id"]) & inside["hour"].eqNullSafe(offsets["hour"])
    placed = inside.join(offsets, same).select(inside["session_id"], (F.col("offset") + F.col("n")).alias("place"))
    return placed.groupBy("session_id", F.floor((F.col("place") - 1) / every).alias("save")).agg(F.count("*").alias("n")).filter(F.col("n") == every)


def event_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts a window, batch or streaming; later events than the delay are dropped in a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
