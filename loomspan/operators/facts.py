"""Temporal facts: subject, predicate, object with an interval of validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions.classify import claims
from loomspan.functions.text import iso_temporal
from loomspan.operators.edits import near_names


class InvertedInterval(ValueError):
    """A fact that would end before it starts."""


def entity_id(name: Column) -> Column:
    """Lower case, blanks as _, apostrophes dropped."""
    return F.translate(F.lower(name), " '", "_")


def start_key(c: Column) -> Column:
    """Comparable text of a start: a date alone is its first second."""
    return F.when(c.rlike(r"^.{4}-.{2}-.{2}$"), F.concat(c, F.lit("T00:00:00Z"))).otherwise(c)


def end_key(c: Column) -> Column:
    """Comparable text of an end: a date alone is its last second."""
    return F.when(c.rlike(r"^.{4}-.{2}-.{2}$"), F.concat(c, F.lit("T23:59:59Z"))).otherwise(c)


def valid_at(as_of: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Does the fact hold at a time? Bounds count, null bounds are open; texts are compared as they are."""
    at = start_key(as_of)
    return (F.col(valid_from).isNull() | (start_key(F.col(valid_from)) <= at)) & (F.col(valid_to).isNull() | (end_key(F.col(valid_to)) >= at))


def unique_entities(entities: DataFrame) -> DataFrame:
    """The last version of each entity."""
    newest = F.max(F.struct("created_at", "name", "type")).alias("v")
    return entities.groupBy("id").agg(newest).select("id", "v.name", "v.type", "v.created_at")


def entity_facts(triples: DataFrame, entities: DataFrame, asked: DataFrame, direction: str = "both", as_of: str | None = None) -> DataFrame:
    """(asked, direction, subject, predicate, object, valid_from, valid_to, current) of the asked names.

    `asked` has a column name. A fact of an entity with itself comes in both
    directions. Facts whose other end is no entity are left out.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction must be outgoing, incoming or both, got {direction!r}")
    own = asked.select("name", entity_id(F.col("name")).alias("asked_id"))
    facts = triples if as_of is None else triples.filter(valid_at(F.lit(as_of)))
    facts = facts.select("id", "subject", "predicate", "object", "valid_from", "valid_to").dropDuplicates()
    named = unique_entities(entities).select(F.col("id").alias("entity"), F.col("name").alias("other"))
    parts = []
    for side, near, far in (("outgoing", "subject", "object"), ("incoming", "object", "subject")):
        if direction in (side, "both"):
            hit = facts.join(own, F.col(near) == F.col("asked_id")).join(named, F.col(far) == F.col("entity"))
            ends = {near: F.col("name"), far: F.col("other")}
            parts.append(hit.select(F.col("name").alias("asked"), F.lit(side).alias("direction"), ends["subject"].alias("subject"), "predicate", ends["object"].alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def relationship(triples: DataFrame, entities: DataFrame, predicate: str | None = None, as_of: str | None = None) -> DataFrame:
    """(subject, predicate, object, valid_from, valid_to, current) with both ends' names."""
    facts = triples.select("id", "subject", "predicate", "object", "valid_from", "valid_to").dropDuplicates()
    if predicate is not None:
        facts = facts.filter(F.col("predicate") == predicate.lower().replace(" ", "_"))
    if as_of is not None:
        facts = facts.filter(valid_at(F.lit(as_of)))
    named = unique_entities(entities)
    s = named.select(F.col("id").alias("subject"), F.col("name").alias("subject_name"))
    o = named.select(F.col("id").alias("object"), F.col("name").alias("object_name"))
    return facts.join(s, "subject").join(o, "object").select("id", F.col("subject_name").alias("subject"), "predicate", F.col("object_name").alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current"))


def timeline(triples: DataFrame, entities: DataFrame, name: str | None = None, most: int = 100) -> DataFrame:
    """Facts of an entity, or all, in the order of their starts, those without one last; `most` rows, ties by id."""
    facts = triples
    if name is not None:
        me = entity_id(F.lit(name))
        facts = facts.filter((F.col("subject") == me) | (F.col("object") == me))
    return relationship(facts, entities).orderBy(F.asc_nulls_last("valid_from"), "id").limit(most)


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row (entities, triples, current_facts, expired_facts, relationship_types)."""
    t = triples.select("id", "predicate", "valid_to").dropDuplicates()
    facts = t.agg(
        F.count("*").alias("triples"),
        F.count_if(F.col("valid_to").isNull()).alias("current_facts"),
        F.count_if(F.col("valid_to").isNotNull()).alias("expired_facts"),
        F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("relationship_types"),  # a vocabulary
    )
    return entities.agg(F.countDistinct("id").alias("entities")).join(F.broadcast(facts))


def new_triples(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Rows of `added` to store: canonical keys, no open twin stored or added before, no inverted interval.

    `added` (subject, predicate, object, valid_from, valid_to, extracted_at).
    Unreadable times give null ids and are left out; so are inverted intervals.
    Ids are reproducible: they are of the time of extraction.
    """
    times_ok = lambda c: F.col(c).isNull() | (F.col(c) == "") | iso_temporal(F.col(c)).isNotNull()
    rows = added.filter(times_ok("valid_from") & times_ok("valid_to")).select(
        entity_id(F.col("subject")).alias("subject"), F.translate(F.lower("predicate"), " ", "_").alias("predicate"), entity_id(F.col("object")).alias("object"),
        F.when(F.col("valid_from") != "", iso_temporal(F.col("valid_from"))).alias("valid_from"), F.when(F.col("valid_to") != "", iso_temporal(F.col("valid_to"))).alias("valid_to"), "extracted_at",
    )
    rows = rows.filter(F.col("valid_from").isNull() | F.col("valid_to").isNull() | (end_key(F.col("valid_to")) >= start_key(F.col("valid_from"))))
    keys = ["subject", "predicate", "object"]
    first = W.partitionBy(*keys, F.col("valid_to").isNull()).orderBy(F.asc_nulls_first("extracted_at"), F.asc_nulls_first("valid_from"))
    once = rows.withColumn("n", F.row_number().over(first)).filter((F.col("n") == 1) | F.col("valid_to").isNotNull()).drop("n")
    fresh = once.join(stored.filter("valid_to is null").select(*keys), keys, "left_anti")
    mark = F.substring(F.sha2(F.concat(F.coalesce("valid_from", F.lit("")), F.coalesce(F.col("extracted_at").cast("string"), F.lit(""))), 256), 1, 12)
    return fresh.withColumn("id", F.concat_ws("_", F.lit("t"), *keys, mark))


def endpoints(stored: DataFrame, triples: DataFrame) -> DataFrame:
    """(id, name) of the ends of facts that no stored entity has."""
    each = triples.select(F.explode(F.array("subject", "object")).alias("id")).filter("id is not null").distinct()
    return each.join(stored.select("id"), "id", "left_anti").select("id", F.col("id").alias("name"))


def invalidated(triples: DataFrame, subject: str, predicate: str, obj: str, ended: str) -> DataFrame:
    """`triples` with every open fact of the three closed at `ended`; raises if that is before a start."""
    match = (F.col("subject") == entity_id(F.lit(subject))) & (F.col("predicate") == predicate.lower().replace(" ", "_")) & (F.col("object") == entity_id(F.lit(obj))) & F.col("valid_to").isNull()
    if triples.filter(match & (end_key(F.lit(ended)) < start_key(F.col("valid_from")))).limit(1).collect():
        raise InvertedInterval(f"{ended} is before the start of an open fact")
    return triples.withColumn("valid_to", F.when(match, F.lit(ended)).otherwise(F.col("valid_to")))


def all_closed(triples: DataFrame, closing: DataFrame) -> DataFrame:
    """`triples` with open facts closed by `closing` (subject, predicate, object, ended), a row a fact; never inverted."""
    keys = ["subject", "predicate", "object"]
    one = closing.groupBy(*keys).agg(F.min("ended").alias("ended"))
    joined = triples.join(one, keys, "left")
    closes = F.col("valid_to").isNull() & F.col("ended").isNotNull() & (F.col("valid_from").isNull() | (end_key(F.col("ended")) >= start_key(F.col("valid_from"))))
    return joined.withColumn("valid_to", F.when(closes, F.col("ended")).otherwise(F.col("valid_to"))).drop("ended")


def contradictions(said: DataFrame, triples: DataFrame, entities: DataFrame, today: str) -> DataFrame:
    """(text_id, type, subject, claimed, recorded, object, valid_to) of claims that facts speak against.

    `said` (text_id, text). relationship_mismatch: an open fact of the same two
    with another predicate; stale_fact: the same fact, closed before `today`.
    """
    claim = said.select("text_id", F.explode(claims(F.coalesce("text", F.lit("")))).alias("c")).select("text_id", "c.subject", "c.predicate", "c.object")
    return claim_conflicts(claim, triples, entities, today)


def claim_conflicts(claim: DataFrame, triples: DataFrame, entities: DataFrame, today: str) -> DataFrame:
    """The same for claims (text_id, subject, predicate, object) given as rows."""
    facts = triples.select("subject", "predicate", "object", "valid_to").dropDuplicates()
    named = unique_entities(entities).select(F.col("id").alias("object"), F.lower(F.trim("name")).alias("object_name"))
    known = facts.join(named, "object").select(F.col("subject").alias("s"), F.lower("predicate").alias("recorded"), "object_name", "valid_to")
    met = claim.join(known, (entity_id(F.col("subject")) == F.col("s")) & (F.lower(F.trim("object")) == F.col("object_name")))
    kind = F.when(F.col("valid_to").isNull() & (F.col("recorded") != F.col("predicate")), "relationship_mismatch").when((F.col("recorded") == F.col("predicate")) & (F.col("valid_to") != "") & (F.col("valid_to") < today), "stale_fact")
    return met.select("text_id", kind.alias("type"), "subject", F.col("predicate").alias("claimed"), "recorded", "object", "valid_to").filter("type is not null").dropDuplicates()


def similar_names(mentioned: DataFrame, registry: DataFrame, most: int = 2, also_mentioned: bool = False) -> DataFrame:
    """(name, other, distance): registered names at 1 to `most` edits of a mentioned one that aren't mentioned, or `also_mentioned`.

    Names are compared whatever their case. What is compared grows with the
    beginnings that are near, not with the parts that names share.
    """
    a = mentioned.select("name").filter("name <> ''").distinct()
    registered = registry.select("name").filter("name <> ''").distinct()
    b = registered if also_mentioned else registered.join(a, "name", "left_anti")
    return near_names(a, b, most)


def seeded(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) from rows (name, type, relation, other, since): nested seeds, exploded by the caller."""
    entities = facts.select(entity_id(F.col("name")).alias("id"), "name", F.coalesce("type", F.lit("person")).alias("type")).dropDuplicates(["id"])
    triples = facts.filter("relation is not null and other is not null").select(entity_id(F.col("name")).alias("subject"), F.col("relation").alias("predicate"), entity_id(F.col("other")).alias("object"), F.col("since").alias("valid_from")).dropDuplicates()
    return entities, triples
