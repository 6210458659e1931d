"""Counts, pages, budgets, pruning and writes over filed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators.predicates import is_registry_row
from loomspan.runtime import checkpointed


def counts(records: DataFrame, default: str = "unknown") -> DataFrame:
    """(level, wing, room, n): totals by wing, by room and in all, in one pass; nulls count under `default`. An empty table has no rows."""
    own = records.select(F.coalesce("wing", F.lit(default)).alias("wing"), F.coalesce("room", F.lit(default)).alias("room"))
    sets = own.groupingSets([["wing"], ["room"], []], "wing", "room").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 1, "wing").when(F.col("g") == 2, "room").otherwise("total").alias("level"), "wing", "room", "n")


def taxonomy(records: DataFrame, default: str = "unknown") -> DataFrame:
    return records.groupBy(F.coalesce("wing", F.lit(default)).alias("wing"), F.coalesce("room", F.lit(default)).alias("room")).agg(F.count("*").alias("n"))


def taxonomy_tree(records: DataFrame, default: str = "unknown") -> DataFrame:
    """(wing, rooms): a map from room to count for each wing."""
    return taxonomy(records, default).groupBy("wing").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("room", "n")))).alias("rooms"))


def source_groups(records: DataFrame, least: int = 5, pattern: str | None = None, wing: str | None = None) -> DataFrame:
    """(source_file, n) of sources with `least` records or more; null sources are `unknown`."""
    own = records if wing is None else records.filter(F.col("wing") == wing)
    source = F.coalesce("source_file", F.lit("unknown"))
    own = own.select(source.alias("source_file"), "id").dropDuplicates()
    if pattern:
        own = own.filter(F.lower("source_file").contains(pattern.lower()))
    return own.groupBy("source_file").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def source_stats(groups: DataFrame) -> DataFrame:
    """One row (sources, records, estimated_duplicates): 40 % of each source with more than 20."""
    return groups.agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(F.col("n") > 20, F.floor(F.col("n") * 2 / 5))), F.lit(0)).cast("bigint").alias("estimated_duplicates"))


def read_sources(records: DataFrame, version: int) -> DataFrame:
    """(source_file, mtime) of sources whose records are all of the present version."""
    has_mtime = "source_mtime" in records.columns
    mtime = F.max("source_mtime") if has_mtime else F.lit(None).cast("double")
    g = records.filter("source_file is not null").groupBy("source_file").agg(F.min(F.coalesce("normalize_version", F.lit(0))).alias("v"), mtime.alias("mtime"))
    return g.filter(F.col("v") >= version).select("source_file", "mtime")


def unread(files: DataFrame, read: DataFrame, precision: float = 0.001) -> DataFrame:
    """`files` (source_file, mtime) that aren't read yet, or have changed since by more than a millisecond."""
    same = (files["source_file"] == read["source_file"]) & (read["mtime"].isNull() | files["mtime"].isNull() | (F.abs(files["mtime"] - read["mtime"]) < precision))
    return files.join(read, same, "left_anti")


def page(records: DataFrame, wing: str | None, limit: int, offset: int) -> DataFrame:
    own = records if not wing else records.filter(F.col("wing") == wing)
    return own.orderBy("id").offset(offset).limit(limit)


def latest_per_group(records: DataFrame, group: str, n: int, at: str = "filed_at", key: str = "id") -> DataFrame:
    """The n latest records of each group as column rank; ties by key; null times come last."""
    order = W.partitionBy(group).orderBy(F.desc_nulls_last(at), key)
    return records.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def essential_story(records: DataFrame, importance: Column, most: int = 15, budget: int = 3200, snippet: int = 200) -> DataFrame:
    """(room, rank, line): the `most` weightiest records by room, while their lines fit a budget of characters.

    `records` (id, room, source_file, content). A room's heading counts when
    its first line is reached; the first line that doesn't fit ends the list.
    The weight defaults to 3; ties go to the lesser id.
    """
    own = records.withColumn("weight", F.coalesce(importance, F.lit(3.0)))
    # a top-k of `most` rows, so the frames below are over these alone
    top = own.orderBy(F.desc("weight"), "id").limit(most)
    room = F.coalesce("room", F.lit("general"))
    text = F.replace(F.trim(F.coalesce("content", F.lit(""))), F.lit("\n"), F.lit(" "))
    short = F.when(F.char_length(text) > snippet, F.concat(F.substring(text, 1, snippet - 3), F.lit("..."))).otherwise(text)
    file = F.element_at(F.split(F.coalesce("source_file", F.lit("")), "/"), -1)
    line = F.concat(F.lit("  - "), short, F.when(file != "", F.concat(F.lit("  ("), file, F.lit(")"))).otherwise(""))
    rows = top.select(room.alias("room"), "weight", "id", line.alias("line"))
    order = [F.col("room"), F.desc("weight"), F.col("id")]
    ranked = rows.withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumn("first", F.row_number().over(W.partitionBy("room").orderBy(F.desc("weight"), "id")) == 1)
    heading = F.when(F.col("first"), F.char_length("room") + 3).otherwise(0)
    used = F.sum(F.char_length("line") + heading).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    sized = ranked.withColumn("used", used)
    over = F.max(F.when(F.col("used") > budget, 1).otherwise(0)).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return sized.withColumn("over", over).filter("over = 0").select("room", "rank", "line")


def content_duplicates(records: DataFrame, keys: list[str], text: str = "content", key: str = "id") -> DataFrame:
    """(hash, kept, copies): records of one place and content, the least id kept; combined before the shuffle."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k), F.lit("")) for k in keys], F.coalesce(F.col(text), F.lit(""))), 256)
    return records.groupBy(h.alias("hash")).agg(F.min(key).alias("kept"), F.count("*").alias("copies")).filter("copies > 1")


def is_short(text: Column, least: int = 20) -> Column:
    return F.char_length(F.coalesce(text, F.lit(""))) < least


def greedy_kept(records: DataFrame, near: DataFrame, group: str = "source_file", text: str = "content", key: str = "id", least: int = 20, most_rounds: int | None = None) -> DataFrame:
    """`records` (key, group, text) with `kept`: longest first, a record goes if it is near one that stays.

    `near` (a, b) are the pairs closer than the threshold, of one group. The
    order-dependent rule is settled in rounds: a record whose nearer and longer
    neighbours are all decided is decided too; at least the longest undecided
    one of each group is, in every round, until none is left; an error if that takes
    more than `most_rounds`. No group is gathered. Shorter than `least` or
    without text: not kept. Ties of length go to the lesser key.
    """
    own = records.select(key, F.col(group).alias("grp"), F.char_length(F.coalesce(text, F.lit(""))).alias("size"))
    long = own.filter(F.col("size") >= least)
    rank = F.struct((-F.col("size")).alias("s"), F.col(key).alias("k"))
    # one place a key, also where ids repeat, so that no two records wait for each other
    place = long.groupBy(F.col(key).alias("x")).agg(F.min(rank).alias("r"))
    both = near.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y"))).dropDuplicates()
    # edges from a record to those before it
    edges = both.join(place, "x").join(place.select(F.col("x").alias("y"), F.col("r").alias("ry")), "y").filter(F.col("ry") < F.col("r")).select("x", "y")
    edges = checkpointed(edges)
    state = checkpointed(long.select(F.col(key).alias("x")).join(edges.select("x").distinct(), "x", "left_anti").select("x", F.lit(True).alias("kept")))
    todo = checkpointed(edges.select("x").distinct())
    rounds = 0
    while todo.limit(1).collect():
        if rounds == most_rounds:
            raise RuntimeError(f"records are undecided after {most_rounds} rounds")
        rounds += 1
        seen = edges.join(todo, "x", "left_semi").join(state.select(F.col("x").alias("y"), "kept"), "y", "left")
        verdict = seen.groupBy("x").agg(F.max(F.coalesce("kept", F.lit(False))).alias("hit"), F.max(F.col("kept").isNull()).alias("open"))
        decided = verdict.filter("hit or not open").select("x", (~F.col("hit")).alias("kept"))
        state = checkpointed(state.unionByName(decided))
        todo = checkpointed(todo.join(decided, "x", "left_anti"))
    return own.join(state.withColumnRenamed("x", key), key, "left").select(key, F.col("grp").alias(group), F.coalesce("kept", F.lit(False)).alias("kept"))


def pruning(records: DataFrame, roots: list[str], live: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """`records` (id, room, source_file) with bucket: kept, gitignored, missing, no_source or out_of_scope.

    `live` (source_file) are the files there are; `ignored` those under ignore
    rules. Sentinels are kept. A source belongs to the longest root it lies under.
    """
    source = F.coalesce("source_file", F.lit(""))
    inside = F.lit(False)
    for root in roots:
        inside = inside | source.startswith(root.rstrip("/") + "/") | (source == root)
    own = records.join(live.select("source_file").distinct().withColumn("live", F.lit(True)), "source_file", "left")
    if ignored is not None:
        own = own.join(ignored.select("source_file").distinct().withColumn("ignored", F.lit(True)), "source_file", "left")
    else:
        own = own.withColumn("ignored", F.lit(None).cast("boolean"))
    bucket = (
        F.when(is_registry_row(), "kept")
        .when(~source.startswith("/"), "no_source")
        .when(~inside, "out_of_scope")
        .when(F.col("live").isNull(), "missing")
        .when(F.col("ignored"), "gitignored")
        .otherwise("kept")
    )
    return own.withColumn("bucket", bucket).drop("live", "ignored")


def root_of(source: Column, roots: list[str]) -> Column:
    """The longest root a source lies under, or null."""
    out = F.lit(None).cast("string")
    for root in sorted(roots, key=len):
        out = F.when(source.startswith(root.rstrip("/") + "/"), root).otherwise(out)
    return out


# ---- writes -----------------------------------------------------------------


def record_id(wing: Column, room: Column, content: Column) -> Column:
    """Id by place and content, so that filing the same again changes nothing."""
    return F.concat(F.lit("drawer_"), wing, F.lit("_"), room, F.lit("_"), F.substring(F.sha2(F.concat(wing, room, content), 256), 1, 24))


def filed(stored: DataFrame, added: DataFrame, size: int = 800) -> DataFrame:
    """Rows to add for `added` (wing, room, content, source_file, added_by, filed_at) that `stored` (id) lacks.

    Longer contents are cut into slices of `size` characters with the whole's
    id as parent. Filing twice gives no rows; blank contents are refused.
    """
    rows = added.filter(F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False))).withColumn("whole", record_id(F.col("wing"), F.col("room"), F.col("content")))
    many = F.char_length("content") > size
    starts = F.when(many, F.sequence(F.lit(0), F.char_length("content") - 1, F.lit(size))).otherwise(F.array(F.lit(0)))
    cut = rows.select("*", many.alias("many"), F.posexplode(starts).alias("chunk_index", "start"))
    ident = F.when(F.col("many"), F.concat(F.col("whole"), F.lit("_chunk_"), F.lpad(F.col("chunk_index").cast("string"), 6, "0"))).otherwise(F.col("whole"))
    out = cut.select(
        ident.alias("id"), F.when(F.col("many"), F.substring("content", F.col("start") + 1, F.lit(size))).otherwise(F.col("content")).alias("content"), "wing", "room", "source_file", "chunk_index", "added_by", "filed_at",
        F.when(F.col("many"), F.col("whole")).alias("parent_drawer_id"),
    )
    return out.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def upserted(stored: DataFrame, added: DataFrame, key: str = "id") -> DataFrame:
    """`stored` with rows of the same key replaced by those of `added`, one a key."""
    return stored.join(added.select(key), key, "left_anti").unionByName(added.dropDuplicates([key]), allowMissingColumns=True)


def updated(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """`stored` with non-null values of `changes` (key and some columns); other rows and columns stay."""
    own = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in own]).dropDuplicates([key])
    joined = stored.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in own else F.col(c) for c in stored.columns])


def without(stored: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(removed.select(key), key, "left_anti")


def with_epochs(records: DataFrame) -> DataFrame:
    """filed_at_ts filled from filed_at where it is missing; times without a zone are UTC."""
    iso = F.when(F.col("filed_at").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.col("filed_at")).otherwise(F.concat("filed_at", F.lit("Z")))
    return records.withColumn("filed_at_ts", F.coalesce("filed_at_ts", F.unix_micros(iso.try_cast("timestamp")) / 1e6))


def diary_rows(added: DataFrame, size: int = 800) -> DataFrame:
    """Rows of diary entries (agent, entry, topic, at): agent in lower case, ids by time, slices of `size` characters."""
    agent = F.lower(F.trim("agent"))
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("entry") - 1, F.lit(0)), F.lit(size))
    cut = added.filter(F.coalesce(F.col("entry").rlike(r"\S"), F.lit(False))).select(agent.alias("agent"), F.concat(F.lit("wing_"), agent).alias("wing"), F.coalesce("topic", F.lit("general")).alias("topic"), "at", "entry", F.posexplode(starts).alias("chunk_index", "start"))
    ident = F.concat(F.lit("diary_"), F.col("wing"), F.lit("_"), F.date_format("at", "yyyyMMdd_HHmmssSSSSSS"), F.lit("_"), F.substring(F.sha2("entry", 256), 1, 12), F.lit("_"), F.lpad(F.col("chunk_index").cast("string"), 6, "0"))
    return cut.select(ident.alias("id"), "agent", "wing", "topic", F.col("at").alias("filed_at"), "chunk_index", F.substring("entry", F.col("start") + 1, F.lit(size)).alias("content"))


def recency_groups(commits: DataFrame) -> DataFrame:
    """(name, email, person): authors joined by equal name or e-mail; person is the component's most frequent name.

    `commits` (name, email), a row a commit. Components by repeated least labels over both keys.
    """
    pairs = commits.groupBy("name", "email").agg(F.count("*").alias("n"))
    state = checkpointed(pairs.withColumn("c", F.min("name").over(W.partitionBy("email"))))
    while True:
        step = state.withColumn("m", F.min("c").over(W.partitionBy("name"))).withColumn("m", F.min("m").over(W.partitionBy("email")))
        new = checkpointed(step.select("name", "email", "n", F.col("m").alias("c")))
        if not new.join(state, ["name", "email", "c"], "left_anti").limit(1).collect():
            break
        state = new
    named = state.groupBy("c", "name").agg(F.sum("n").alias("n")).groupBy("c").agg(F.max_by("name", F.struct("n", "name")).alias("person"))
    return state.join(named, "c").select("name", "email", "person")


def project_stats(commits: DataFrame, mine: list[str]) -> DataFrame:
    """(project, commits, own, is_mine): mine if among the five busiest authors, or a tenth of the commits, or twenty."""
    by = commits.groupBy("project", "name").agg(F.count("*").alias("n")).withColumn("rank", F.rank().over(W.partitionBy("project").orderBy(F.desc("n"))))
    me = F.col("name").isin(mine)
    g = by.groupBy("project").agg(F.sum("n").alias("commits"), F.coalesce(F.sum(F.when(me, F.col("n"))), F.lit(0)).alias("own"), F.min(F.when(me, F.col("rank"))).alias("rank"))
    return g.select("project", "commits", "own", ((F.col("own") > 0) & ((F.coalesce("rank", F.lit(99)) <= 5) | (F.col("own") * 10 >= F.col("commits")) | (F.col("own") >= 20))).alias("is_mine"))


def themes(texts: DataFrame, stop: list[str], most: int = 3, text: str = "content") -> DataFrame:
    """(word, n): the most frequent words of four letters or more."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]{4,}"), F.lit(0))).alias("word"))
    return words.filter(~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def diverged(stored: int, indexed: int, sync: int = 50_000) -> bool:
    """Does an index lack more records than a late flush explains?"""
    return stored - indexed > max(2000, 2 * sync, stored // 10)
