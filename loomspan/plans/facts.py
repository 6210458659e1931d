"""Queries over temporal facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import facts as K
from loomspan.tables import load

AS_OF = "2020-06-15"


def _te(spark, sf):
    return load(spark, sf, "triples"), load(spark, sf, "entities")


def facts_about_people(spark, sf):
    t, e = _te(spark, sf)
    asked = e.filter("type = 'person'").select("name").distinct()
    return K.entity_facts(t, e, asked, "both").groupBy("asked", "direction", "current").agg(F.count("*").alias("n"), F.min("valid_from").alias("first"))


def facts_as_of(spark, sf):
    t, e = _te(spark, sf)
    return K.relationship(t, e, None, AS_OF).select("id", "subject", "predicate", "object")


def facts_by_predicate(spark, sf):
    t, e = _te(spark, sf)
    return K.relationship(t, e, "works at").select("id", "subject", "object", "valid_from", "valid_to", "current")


def fact_timeline(spark, sf):
    t, e = _te(spark, sf)
    return K.timeline(t, e).select("id", "subject", "predicate", "object", "valid_from")


def fact_stats(spark, sf):
    return K.stats(*_te(spark, sf))


def fact_inserts(spark, sf):
    """Facts of the adapter calendar filed again against those of all others."""
    t = load(spark, sf, "triples")
    added = t.filter("adapter_name = 'calendar'").select("subject", "predicate", "object", "valid_from", "valid_to", "extracted_at").dropDuplicates()
    new = K.new_triples(t.filter("adapter_name is null or adapter_name <> 'calendar'"), added.filter("subject is not null and object is not null"))
    return new.select("subject", "predicate", "object", "valid_from", "valid_to")


def fact_invalidation(spark, sf):
    t = load(spark, sf, "triples").select("id", "subject", "predicate", "object", "valid_from", "valid_to").dropDuplicates()
    closing = t.filter("predicate = 'uses' and subject is not null and object is not null").select("subject", "predicate", "object", F.lit("2026-01-01").alias("ended"))
    return K.all_closed(t, closing).select("id", "predicate", "valid_to")


def contradictions(spark, sf):
    """Claims: each fact of 2025's extractions said again as leads."""
    t, e = _te(spark, sf)
    named = K.unique_entities(e).select(F.col("id").alias("object"), F.col("name").alias("object_name"))
    claim = t.filter("predicate in ('leads', 'reviews') and year(extracted_at) = 2025").join(named, "object").select(F.col("id").alias("text_id"), "subject", F.lit("leads").alias("predicate"), F.col("object_name").alias("object"))
    return K.claim_conflicts(claim, t, e, "2026-01-01")


def similar_names(spark, sf):
    """People that are subject or object of any fact, by id or spelled name, against all registered people."""
    t, e = _te(spark, sf)
    people = K.unique_entities(e).filter("type = 'person'").select("id", "name")
    keys = t.select(F.explode(F.array("subject", "object")).alias("name")).select(K.entity_id(F.col("name")).alias("key")).distinct()
    mentioned = people.withColumn("key", F.explode(F.array(K.entity_id(F.col("id")), K.entity_id(F.col("name"))))).join(keys, "key", "left_semi").select("name")
    return K.similar_names(mentioned, people.select("name"), also_mentioned=True)


def similar_suppliers(spark, sf):
    """Supplier names one or two edits apart, each against all."""
    names = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_name").alias("name"))
    return K.similar_names(names, names, also_mentioned=True)


QUERIES = {f.__name__: f for f in (facts_about_people, facts_as_of, facts_by_predicate, fact_timeline, fact_stats, fact_inserts, fact_invalidation, contradictions, similar_names, similar_suppliers)}

_E = "e AS (SELECT id, name, type FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, name DESC NULLS LAST, type DESC NULLS LAST) = 1)"
_T = "t AS (SELECT DISTINCT id, subject, predicate, object, valid_from, valid_to FROM triples)"


#: The key of an entity's name in SQL.
_ID = "translate(lower({0}), ' ''', '_')"


def _key(c: str, end: bool = False) -> str:
    return f"CASE WHEN regexp_full_match({c}, '.{{4}}-.{{2}}-.{{2}}') THEN {c} || 'T{'23:59:59' if end else '00:00:00'}Z' ELSE {c} END"


_ISO = "regexp_full_match({c}, '\\s*\\d{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])(T([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d(Z|\\+00:00))?\\s*') AND TRY_CAST(substr(regexp_replace({c}, '^\\s+', ''), 1, 10) AS DATE) IS NOT NULL"
_ISO_TEXT = "regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\+00:00$', 'Z')"
_OK = "({c} IS NULL OR {c} = '' OR (" + _ISO + "))"

ORACLES = {
    "facts_about_people": f"""WITH {_E}, {_T}, a AS (SELECT DISTINCT name, translate(lower(name), ' ''', '_') AS id FROM entities WHERE type = 'person'),
        f AS (SELECT a.name AS asked, 'outgoing' AS direction, valid_from, valid_to FROM t JOIN a ON t.subject = a.id JOIN e ON e.id = t.object
          UNION ALL SELECT a.name, 'incoming', valid_from, valid_to FROM t JOIN a ON t.object = a.id JOIN e ON e.id = t.subject)
        SELECT asked, direction, valid_to IS NULL AS current, count(*) AS n, min(valid_from) AS first FROM f GROUP BY 1, 2, 3""",
    "facts_as_of": f"""WITH {_E}, {_T} SELECT t.id, s.name AS subject, predicate, o.name AS object FROM t JOIN e s ON s.id = t.subject JOIN e o ON o.id = t.object
        WHERE (valid_from IS NULL OR {_key('valid_from')} <= '{AS_OF}T00:00:00Z') AND (valid_to IS NULL OR {_key('valid_to', True)} >= '{AS_OF}T00:00:00Z')""",
    "facts_by_predicate": f"""WITH {_E}, {_T} SELECT t.id, s.name AS subject, o.name AS object, valid_from, valid_to, valid_to IS NULL AS current
        FROM t JOIN e s ON s.id = t.subject JOIN e o ON o.id = t.object WHERE predicate = 'works_at'""",
    "fact_timeline": f"""WITH {_E}, {_T} SELECT t.id, s.name AS subject, predicate, o.name AS object, valid_from
        FROM t JOIN e s ON s.id = t.subject JOIN e o ON o.id = t.object ORDER BY valid_from ASC NULLS LAST, t.id LIMIT 100""",
    "fact_stats": """SELECT (SELECT count(DISTINCT id) FROM entities) AS entities, count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS current_facts, count(*) FILTER (valid_to IS NOT NULL) AS expired_facts,
        array_to_string(list_sort(list(DISTINCT predicate)), ',') AS relationship_types FROM (SELECT DISTINCT id, predicate, valid_to FROM triples)""",
    "fact_inserts": f"""WITH r AS (SELECT translate(lower(subject), ' ''', '_') AS subject, replace(lower(predicate), ' ', '_') AS predicate, translate(lower(object), ' ''', '_') AS object,
          CASE WHEN valid_from <> '' THEN {_ISO_TEXT.format(c='valid_from')} END AS valid_from, CASE WHEN valid_to <> '' THEN {_ISO_TEXT.format(c='valid_to')} END AS valid_to, extracted_at
          FROM (SELECT DISTINCT subject, predicate, object, valid_from, valid_to, extracted_at FROM triples WHERE adapter_name = 'calendar' AND subject IS NOT NULL AND object IS NOT NULL)
          WHERE {_OK.format(c='valid_from')} AND {_OK.format(c='valid_to')}),
        k AS (SELECT * FROM r WHERE valid_from IS NULL OR valid_to IS NULL OR {_key('valid_to', True)} >= {_key('valid_from')}),
        n AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object, valid_to IS NULL ORDER BY extracted_at NULLS FIRST, valid_from NULLS FIRST) AS n FROM k)
        SELECT subject, predicate, object, valid_from, valid_to FROM n WHERE (n = 1 OR valid_to IS NOT NULL) AND NOT EXISTS (
          SELECT 1 FROM triples t WHERE (adapter_name IS NULL OR adapter_name <> 'calendar') AND t.valid_to IS NULL AND t.subject = n.subject AND t.predicate = n.predicate AND t.object = n.object)""",
    "fact_invalidation": f"""WITH {_T} SELECT id, predicate, CASE WHEN predicate = 'uses' AND subject IS NOT NULL AND object IS NOT NULL AND valid_to IS NULL AND (valid_from IS NULL OR '2026-01-01T23:59:59Z' >= {_key('valid_from')})
        THEN '2026-01-01' ELSE valid_to END AS valid_to FROM t""",
    "contradictions": f"""WITH {_E}, c AS (SELECT t.id AS text_id, t.subject, e.name AS object, e.id AS oid FROM triples t JOIN e ON e.id = t.object WHERE predicate IN ('leads', 'reviews') AND year(timezone('UTC', extracted_at)) = 2025),
        k AS (SELECT DISTINCT subject AS s, predicate AS recorded, lower(trim(name)) AS oname, valid_to FROM triples t JOIN e ON e.id = t.object)
        SELECT DISTINCT text_id, CASE WHEN valid_to IS NULL THEN 'relationship_mismatch' ELSE 'stale_fact' END AS type, subject, 'leads' AS claimed, recorded, object, valid_to
        FROM c JOIN k ON translate(lower(c.subject), ' ''', '_') = k.s AND lower(trim(c.object)) = k.oname
        WHERE (valid_to IS NULL AND recorded <> 'leads') OR (recorded = 'leads' AND valid_to <> '' AND valid_to < '2026-01-01')""",
    "similar_names": f"""WITH {_E}, {_T}, p AS (SELECT id, name FROM e WHERE type = 'person'), k AS (SELECT DISTINCT {_ID.format("v")} AS key FROM (SELECT unnest([subject, object]) AS v FROM t) WHERE v IS NOT NULL),
        a AS (SELECT DISTINCT name FROM p WHERE name <> '' AND ({_ID.format("id")} IN (SELECT key FROM k) OR {_ID.format("name")} IN (SELECT key FROM k)))
        SELECT a.name, b.name AS other, CAST(levenshtein(lower(a.name), lower(b.name)) AS INTEGER) AS distance FROM a JOIN (SELECT DISTINCT name FROM p WHERE name <> '') b ON levenshtein(lower(a.name), lower(b.name)) BETWEEN 1 AND 2""",
    "similar_suppliers": """SELECT a.name, b.name AS other, CAST(levenshtein(lower(a.name), lower(b.name)) AS INTEGER) AS distance
        FROM (SELECT DISTINCT s_name AS name FROM supplier) a JOIN (SELECT DISTINCT s_name AS name FROM supplier) b ON levenshtein(lower(a.name), lower(b.name)) BETWEEN 1 AND 2""",
}
