"""Queries over text functions and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import classify as C
from loomspan.functions import text as T
from loomspan.operators import evaluation as E
from loomspan.plans.records import _D, meta
from loomspan.tables import load


def _docs(spark, sf):
    return load(spark, sf, "documents")


def tokenize_df(spark, sf):
    # engines differ in the lower case of a final sigma
    words = _docs(spark, sf).select("doc_id", F.explode(F.array_distinct(T.tokens(F.translate("text", "Σς", "σσ")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("df"))


def line_numbers(spark, sf):
    return _docs(spark, sf).select("doc_id", T.numbered_lines(F.col("text")).alias("grid"))


def line_range(spark, sf):
    return _docs(spark, sf).select("doc_id", T.line_range(F.col("text"), 2, 4).alias("part"))


def text_transforms(spark, sf):
    t = T.newline_normalize(F.coalesce("text", F.lit("")))
    return _docs(spark, sf).select("doc_id", F.char_length(t).alias("normal"), F.char_length(T.whitespace_collapse(t)).alias("collapsed"), F.char_length(T.blank_line_drop(t)).alias("dropped"))


def noise_flags(spark, sf):
    return _docs(spark, sf).select("doc_id", T.is_noise(F.col("text")).alias("noise"))


def stripped_noise(spark, sf):
    return load(spark, sf, "drawers").select("id", F.md5(T.strip_noise(F.coalesce("content", F.lit("")))).alias("md5")).dropDuplicates()


def hall_class(spark, sf):
    return load(spark, sf, "drawers").select("id", C.hall(F.col("content")).alias("hall")).dropDuplicates()


def topic_class(spark, sf):
    return load(spark, sf, "messages").select("uuid", C.topic(F.col("content")).alias("topic")).dropDuplicates()


ROOMS = [{"name": "backend", "keywords": ["server", "database"]}, {"name": "diary", "keywords": ["journal"]}, {"name": "travel", "keywords": ["journey", "bridge"]}]


def room_class(spark, sf):
    return load(spark, sf, "drawers").select("id", C.room(F.col("source_file"), F.col("content"), ROOMS).alias("room")).dropDuplicates()


def token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def slugs(spark, sf):
    return load(spark, sf, "entities").select("name").distinct().select("name", T.slug(F.col("name")).alias("slug"))


def entity_list(spark, sf):
    return meta(spark, sf).select("id", F.posexplode(T.listed(F.col("entities"))).alias("place", "entity"))


def valid_names(spark, sf):
    return load(spark, sf, "entities").select("name").distinct().select("name", T.valid_name(F.coalesce("name", F.lit(""))).alias("valid"))


def iso_temporals(spark, sf):
    return load(spark, sf, "triples").select("id", "valid_from").dropDuplicates().select("id", T.iso_temporal(F.col("valid_from")).alias("at")).filter("at is not null")


def entity_words(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(C.entity_words(F.col("text")), ";").alias("words"))


def memory_types(spark, sf):
    own = load(spark, sf, "drawers").select("id", F.posexplode(C.segments(F.coalesce("content", F.lit("")))).alias("place", "segment")).filter(F.char_length(T.strip(F.col("segment"))) >= 20)
    # chosen inside an array: a filter would be pushed down and work the scores out again
    sure = F.filter(F.array(F.struct("memory_type", F.round("confidence", 6).alias("confidence"))), lambda m: m["confidence"] >= 0.3)
    return C.with_memory(own, "segment").select("id", "place", F.inline(sure)).dropDuplicates()


def origin_density(spark, sf):
    n = C.origin_counts(F.coalesce("text", F.lit("")))
    sums = _docs(spark, sf).select(*[v.alias(k) for k, v in n.items()]).agg(*[F.sum(k).alias(k) for k in n])
    likely, confidence = C.origin_verdict(*[F.col(k) for k in ("clear", "unclear", "turns", "chars")])
    return sums.select("clear", "unclear", "turns", "chars", likely.alias("likely"), F.round(confidence, 6).alias("confidence"))


def closets(spark, sf):
    """Index lines of each record, packed into texts of 1,500 characters."""
    own = load(spark, sf, "drawers")
    lines = C.closet_lines(F.col("content"), F.col("id"), F.col("wing"), F.col("room"), F.col("source_file"))
    return own.select("id", F.posexplode(C.pack(lines)).alias("part", "closet")).dropDuplicates()


def closet_pointers(spark, sf):
    """Records that the index lines inside documents point to."""
    return _docs(spark, sf).filter("text is not null").select("doc_id", F.posexplode(C.pointers(F.col("text"))).alias("place", "drawer_id"))


def question_keywords(spark, sf):
    q = load(spark, sf, "eval_items")
    return q.select("item_id", F.array_join(E.keywords(F.col("text")), " ").alias("keywords"), F.array_join(F.array_sort(E.names(F.col("text"))), " ").alias("names"), E.question_hall(F.col("text")).alias("hall"))


def text_claims(spark, sf):
    """Claims of the form X is Y's Z, made of facts and read back."""
    t = load(spark, sf, "triples").filter("subject is not null and object is not null and predicate is not null").select("id", "subject", "predicate", "object").dropDuplicates()
    said = t.select("id", F.concat(F.initcap(F.element_at(F.split("subject", "_"), 1)), F.lit(" is "), F.initcap(F.element_at(F.split("object", "_"), 1)), F.lit("'s "), F.element_at(F.split("predicate", "_"), 1), F.lit(".")).alias("text"))
    return said.select("id", F.explode(C.claims(F.col("text"))).alias("c")).select("id", "c.subject", "c.predicate", "c.object")


QUERIES = {f.__name__: f for f in (tokenize_df, line_numbers, line_range, text_transforms, noise_flags, stripped_noise, hall_class, topic_class, room_class, token_estimate, slugs, entity_list, valid_names, iso_temporals, entity_words, memory_types, origin_density, closets, closet_pointers, question_keywords, text_claims)}

_NO = ", ".join(f"'{w}'" for w in C.NO_ENTITIES)
_STOP = ", ".join(f"'{w}'" for w in E.STOP_WORDS)
_NOTN = ", ".join(f"'{w}'" for w in E.NOT_NAMES)
_Q = lambda words: "(" + " OR ".join(f"contains(l, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"
_count = lambda terms: " + ".join("len(regexp_extract_all(t, '(?i)" + C._term(x).replace("'", "''") + "'))" for x in terms)
_patterns = lambda ps: " + ".join("len(regexp_extract_all(t, '(?i)" + p.replace("'", "''") + "'))" for p in ps)

#: What isn't white space in any script, for RE2.
_SOLID = r"[^\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]"

_ROOM_WORDS = {r["name"]: [r["name"], *r["keywords"]] for r in ROOMS}
_often = lambda words: "(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) + ")"
_most = "greatest(" + ", ".join(map(_often, _ROOM_WORDS.values())) + ")"
_initcap = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_SAID = [p.replace("'", "''") for p in (C._CLAIM_A, C._CLAIM_B)]
_claim = lambda a, b: f"CASE WHEN a IS NOT NULL THEN regexp_extract(a, '{_SAID[0]}', {a}) ELSE regexp_extract(b, '{_SAID[1]}', {b}) END"

ORACLES = {
    "room_class": r"""WITH d AS (SELECT DISTINCT id, lower(coalesce(source_file, '')) AS p, lower(substr(coalesce(content, ''), 1, 2000)) AS t FROM drawers),
        f AS (SELECT *, regexp_split_to_array(p, '[/\\]') AS parts FROM d), g AS (SELECT *, parts[:-2] AS folders, parts[-1] AS file FROM f)
        SELECT DISTINCT id, CASE """
    + " ".join(f"WHEN list_has_any(folders, {words}) THEN '{k}'" for k, words in _ROOM_WORDS.items())
    + " "
    + " ".join(f"WHEN contains(file, '{k}') THEN '{k}'" for k in _ROOM_WORDS)
    + f" WHEN {_most} = 0 THEN 'general' "
    + " ".join(f"WHEN {_often(words)} = {_most} THEN '{k}'" for k, words in _ROOM_WORDS.items())
    + " END AS room FROM g",
    "text_claims": rf"""WITH t AS (SELECT DISTINCT id, subject, predicate, object FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL AND predicate IS NOT NULL),
        x AS (SELECT id, {_initcap.format("split_part(subject, '_', 1)")} || ' is ' || {_initcap.format("split_part(object, '_', 1)")} || '''s ' || split_part(predicate, '_', 1) || '.' AS v FROM t),
        y AS (SELECT id, unnest(regexp_extract_all(v, '{_SAID[0]}')) AS a, NULL AS b FROM x UNION ALL SELECT id, NULL, unnest(regexp_extract_all(v, '{_SAID[1]}')) FROM x)
        SELECT id, {_claim(1, 3)} AS subject, lower({_claim(3, 2)}) AS predicate, {_claim(2, 1)} AS object FROM y""",
    "token_estimate": f"SELECT doc_id, CAST(greatest(1, floor(len(regexp_extract_all(coalesce(text, ''), '{_SOLID}+')) * 1.3)) AS INTEGER) AS tokens FROM documents",
    "valid_names": r"SELECT DISTINCT name, coalesce(trim(name) <> '' AND length(trim(name)) <= 128 AND NOT regexp_matches(name, '\.\.|/|\\') AND regexp_full_match(trim(name), '[\p{L}\p{N}_][\p{L}\p{N}_ .''-]*'), FALSE) AS valid FROM entities",
    "text_transforms": rf"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents)
        SELECT doc_id, CAST(length(t) AS INTEGER) AS normal, CAST(length(regexp_replace(t, '\n(?:[ \t]*\n){{3,}}', repeat(chr(10), 3), 'g')) AS INTEGER) AS collapsed,
          CAST(length(array_to_string(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SOLID}')), chr(10))) AS INTEGER) AS dropped FROM d""",
    "tokenize_df": r"SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(translate(text, 'Σς', 'σσ')), '[\p{L}\p{N}_]{2,}'))) AS word FROM documents) GROUP BY 1",
    "line_numbers": r"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE array_to_string(list_transform(string_split(text, chr(10)),
        lambda x, i: CASE WHEN regexp_matches(x, '^\[\d+\]') THEN x ELSE '[' || i || '] ' || x END), chr(10)) END AS grid FROM documents""",
    "line_range": r"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR len(string_split(text, chr(10))) < 2 THEN '' ELSE array_to_string(list_transform(string_split(text, chr(10))[2:4],
        lambda x, i: CASE WHEN regexp_matches(x, '^\[\d+\]') THEN x ELSE '[' || (i + 1) || '] ' || x END), chr(10)) END AS part FROM documents""",
    "noise_flags": r"""WITH d AS (SELECT doc_id, text AS t, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]')) AS l FROM documents),
        c AS (SELECT *, len(l) AS n, len(regexp_extract_all(t, ',"[0-9A-Za-z_]+":')) AS pairs FROM d)
        SELECT doc_id, CASE WHEN t IS NULL OR n = 0 THEN TRUE ELSE
          len(list_filter(l, lambda x: regexp_matches(x, '^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|(INFO|WARNING|ERROR|DEBUG|CRITICAL):|\[(vestige|chromadb|httpx|urllib3|asyncio)\.)'))) >= 0.7 * n
          OR len(list_filter(l, lambda x: regexp_matches(x, '^\s*[a-z][\w-]{2,}\s+\d+\s+\d+\.\d+\s+\d+\.\d+\s'))) >= 0.5 * n
          OR len(list_filter(l, lambda x: regexp_matches(x, '^\s*\d+[+\-:]\s'))) >= 0.7 * n
          OR len(list_filter(l, lambda x: regexp_matches(x, '^\s*→\s'))) >= 0.6 * n
          OR ((contains(t, 'Output too large') OR contains(t, '[truncated,')) AND length(trim(regexp_replace(t, '\[truncated[^\]]*\]|Output too large[^\n]*', '', 'g'))) < 100)
          OR (n <= 3 AND (length(t) - length(replace(t, ' → ', ''))) / 3 > 5)
          OR len(list_filter(l, lambda x: regexp_matches(x, '^\s*\{"\w+":'))) >= 0.5 * n
          OR (pairs > 0 AND regexp_matches(t, '"(uuid|sessionId|requestId|messageId|parentUuid)"\s*:|"timestamp"\s*:\s*"\d{4}-\d{2}-\d{2}') AND pairs * 200 >= length(t)) END AS noise FROM c""",
    "hall_class": f"SELECT DISTINCT id, {C.keyword_sql('content', C.HALL_KEYWORDS)} AS hall FROM drawers",
    "topic_class": f"SELECT DISTINCT uuid, {C.keyword_sql('content', C.TOPIC_KEYWORDS)} AS topic FROM messages",
    "slugs": "SELECT DISTINCT name, translate(lower(name), ' -', '__') AS slug FROM entities",
    "entity_list": f"""WITH f AS (SELECT id, list_filter(list_transform(string_split(entities, ';'), lambda v: trim(v)), lambda v: v <> '') AS e FROM ({_D}) WHERE entities IS NOT NULL),
        u AS (SELECT id, unnest(e) AS entity, unnest(generate_series(1, len(e))) AS i FROM f), m AS (SELECT id, entity, min(i) AS i FROM u GROUP BY 1, 2)
        SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS place, entity FROM m""",
    "iso_temporals": r"""SELECT id, regexp_replace(regexp_replace(valid_from, '^\s+|\s+$', '', 'g'), '\+00:00$', 'Z') AS at FROM (SELECT DISTINCT id, valid_from FROM triples)
        WHERE regexp_full_match(valid_from, '\s*\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(Z|\+00:00))?\s*') AND TRY_CAST(substr(regexp_replace(valid_from, '^\s+', ''), 1, 10) AS DATE) IS NOT NULL""",
    "entity_words": rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(substr(coalesce(text, ''), 1, 5000), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+([A-Z][a-z]+|[A-Z]{{2,}})+|[A-Z][a-z]{{1,19}}') AND x NOT IN ({_NO}) AND length(x) > 2) AS f FROM documents)
        SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(f), lambda x: len(list_filter(f, lambda y: y = x)) >= 2))[1:25], ';') AS words FROM w""",
    "origin_density": f"""WITH d AS (SELECT coalesce(text, '') AS t FROM documents), s AS (SELECT CAST(sum({_count(C.CLEAR_TERMS)}) AS BIGINT) AS clear, CAST(sum({_count(C.UNCLEAR_TERMS)}) AS BIGINT) AS unclear, CAST(sum({_patterns(C.TURN_MARKERS)}) AS BIGINT) AS turns, CAST(sum(length(t)) AS BIGINT) AS chars FROM d),
        b AS (SELECT *, (clear + CASE WHEN clear > 0 OR turns > 0 THEN unclear ELSE 0 END) * 1000.0 / greatest(chars, 1) AS brand, turns * 1000.0 / greatest(chars, 1) AS turn FROM s)
        SELECT clear, unclear, turns, chars, brand >= 0.5 OR turn >= 2 OR NOT (brand = 0 AND turns = 0 AND chars >= 150) AS likely,
          round(CASE WHEN brand >= 0.5 OR turn >= 2 THEN least(0.95, 0.6 + 0.1 * (brand + turn)) WHEN brand = 0 AND turns = 0 AND chars >= 150 THEN 0.9 ELSE 0.4 END, 6) AS confidence FROM b""",
    "closet_pointers": r"""WITH p AS (SELECT doc_id, list_filter(string_split(array_to_string(regexp_extract_all(text, '→([0-9A-Za-z_,]+)', 1), ','), ','), lambda x: x <> '') AS f FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, unnest(f) AS drawer_id, unnest(generate_series(1, len(f))) AS i FROM p), m AS (SELECT doc_id, drawer_id, min(i) AS i FROM u GROUP BY 1, 2)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, drawer_id FROM m""",
    "question_keywords": rf"""WITH q AS (SELECT item_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM eval_items)
        SELECT item_id, array_to_string(list_filter(regexp_extract_all(l, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({_STOP})), ' ') AS keywords,
          array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,15}}') AND w NOT IN ({_NOTN})))), ' ') AS names,
          CASE """ + " ".join(f"WHEN {_Q(words)} THEN '{hall}'" for hall, words in E.QUESTION_HALLS) + " ELSE 'hall_general' END AS hall FROM q",
}
