"""Re-ranking features and measures of retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that are no keywords of a question.
STOP_WORDS = ["what", "when", "where", "who", "how", "which", "did", "do", "was", "were", "have", "has", "had", "is", "are", "the", "a", "an", "my", "me", "i", "you", "your", "their", "it", "its", "in", "on", "at", "to", "for", "of", "with", "by", "from", "ago", "last", "that", "this", "there", "about", "get", "got", "give", "gave", "buy", "bought", "made", "make"]
NOT_NAMES = ["What", "When", "Where", "Who", "How", "Which", "Did", "Do", "Was", "Were", "Have", "Has", "Had", "Is", "Are", "The", "My", "Our", "Their", "Can", "Could", "Would", "Should", "Will", "Shall", "May", "Might", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December", "In", "On", "At", "For", "To", "Of", "With", "By", "From", "And", "But", "I", "It", "Its", "This", "That", "These", "Those", "Previously", "Recently", "Also", "Just", "Very", "More"]


def keywords(question: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def contained_share(parts: Column, text: Column) -> Column:
    """Share of the strings that the text contains, whatever the case; 0 of none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(parts) > 0, F.size(F.filter(parts, lambda p: low.contains(F.lower(p)))) / F.size(parts)).otherwise(0.0)


def quoted(question: Column) -> Column:
    """Phrases of 3 to 60 characters in single or double quotes."""
    each = lambda p: F.regexp_extract_all(question, F.lit(p), F.lit(1))
    return F.filter(F.transform(F.concat(each(r"'([^']{3,60})'"), each(r'"([^"]{3,60})"')), F.trim), lambda p: F.char_length(p) >= 3)


def names(question: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(question, F.lit(r"\b[A-Z][a-z]{2,15}\b"), F.lit(0)), lambda w: ~w.isin(NOT_NAMES)))


def keyword_fusion(distance: Column, question: Column, text: Column, weight: float = 0.30) -> Column:
    """Distance less `weight` of the share of keywords contained."""
    return distance * (1 - weight * contained_share(keywords(question), text))


def full_fusion(distance: Column, question: Column, text: Column, keyword: float = 0.50, phrase: float = 0.60, name: float = 0.20) -> Column:
    """Keywords other than names, quoted phrases and names each take their part off the distance."""
    own = names(question)
    plain = F.filter(keywords(question), lambda w: ~F.array_contains(F.transform(own, F.lower), w))
    return distance * (1 - keyword * contained_share(plain, text)) * (1 - phrase * contained_share(quoted(question), text)) * (1 - name * contained_share(own, text))


def temporal_fusion(fused: Column, days_off: Column, tolerance: Column, most: float = 0.40) -> Column:
    """Up to 40 % off for records near the asked date: all within the tolerance, none beyond three times it."""
    off = F.abs(days_off)
    share = F.when(off <= tolerance, 1.0).when(off <= 3 * tolerance, 1 - (off - tolerance) / (2 * tolerance)).otherwise(0.0)
    return F.when(days_off.isNull() | tolerance.isNull(), fused).otherwise(fused * (1 - most * share))


def room_fusion(distance: Column, same: Column, factor: float = 0.8) -> Column:
    return F.when(same, distance * factor).otherwise(distance)


# Phrases that tell the kind of a session or a question, in their order; some need two.
SESSION_HALLS = [
    ("hall_preferences", "user", 1, ["i prefer", "i usually", "i've been having trouble", "i've been feeling", "i've been struggling", "i want to", "i'm worried", "i've been thinking", "i've been considering", "lately i", "recently i", "i tend to"]),
    ("hall_assistant", "assistant", 2, ["i suggest", "i recommend", "here are", "you might want to", "option 1", "option 2", "1.", "2.", "3.", "first,", "second,", "you could try", "i would recommend", "my recommendation"]),
    ("hall_events", "both", 1, ["milestone", "graduation", "promotion", "anniversary", "birthday", "moved", "started", "finished", "completed", "launched", "opened", "achieved", "won", "accepted", "hired", "married", "born"]),
    ("hall_facts", "both", 2, ["degree", "major", "university", "college", "job", "position", "role", "company", "city", "country", "street", "born in", "grew up", "studied", "works at", "lives in", "years old", "salary", "budget"]),
]
QUESTION_HALLS = [
    ("hall_assistant", ["you suggested", "you told me", "you mentioned", "you said", "you recommended", "you provided", "you listed", "you gave", "remind me what you", "you came up with", "you explained"]),
    ("hall_preferences", ["i've been having trouble", "i've been feeling", "i prefer", "i usually", "battery", "nostalgic", "reunion", "lately", "recently been", "struggling with"]),
    ("hall_events", ["milestone", "when did", "what happened", "achievement", "ago", "last week", "last month", "last year", "four weeks", "three months"]),
    ("hall_facts", ["degree", "study", "graduate", "major", "job", "work", "live", "born", "city", "country", "company", "school"]),
]


def session_hall(user: Column, assistant: Column) -> Column:
    texts = {"user": F.lower(F.coalesce(user, F.lit(""))), "assistant": F.lower(F.coalesce(assistant, F.lit("")))}
    texts["both"] = F.concat(texts["user"], texts["assistant"])
    out = F.lit("hall_general")
    for hall, side, least, phrases in reversed(SESSION_HALLS):
        hits = sum((texts[side].contains(p).cast("int") for p in phrases), F.lit(0))
        out = F.when(hits >= least, hall).otherwise(out)
    return out


def question_hall(question: Column) -> Column:
    low = F.lower(F.coalesce(question, F.lit("")))
    out = F.lit("hall_general")
    for hall, phrases in reversed(QUESTION_HALLS):
        found = F.lit(False)
        for p in phrases:
            found = found | low.contains(p)
        out = F.when(found, hall).otherwise(out)
    return out


# Phrases of a question about the assistant's own words, and forms of what a user says of themselves.
ASSISTANT_PHRASES = ["you suggested", "you told me", "you mentioned", "you said", "you recommended", "remind me what you", "you provided", "you listed", "you gave me", "you described", "what did you", "you came up with", "you helped me", "you explained", "can you remind me", "you identified"]
PREFERENCES = [
    r"i(?:'ve been| have been) having (?:trouble|issues?|problems?) with ([^,\.!?]{5,80})", r"i(?:'ve been| have been) feeling ([^,\.!?]{5,60})", r"i(?:'ve been| have been) (?:struggling|dealing) with ([^,\.!?]{5,80})", r"i(?:'ve been| have been) (?:worried|concerned) about ([^,\.!?]{5,80})",
    r"i(?:'m| am) (?:worried|concerned) about ([^,\.!?]{5,80})", r"i prefer ([^,\.!?]{5,60})", r"i usually ([^,\.!?]{5,60})", r"i(?:'ve been| have been) (?:trying|attempting) to ([^,\.!?]{5,80})", r"i(?:'ve been| have been) (?:considering|thinking about) ([^,\.!?]{5,80})",
    r"lately[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})", r"recently[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})", r"i(?:'ve been| have been) (?:working on|focused on|interested in) ([^,\.!?]{5,80})", r"i want to ([^,\.!?]{5,60})",
    r"i(?:'m| am) looking (?:to|for) ([^,\.!?]{5,60})", r"i(?:'m| am) thinking (?:about|of) ([^,\.!?]{5,60})", r"i(?:'ve been| have been) (?:noticing|experiencing) ([^,\.!?]{5,80})",
]


def asks_assistant(question: Column) -> Column:
    """Is the question about what the assistant said before?"""
    low, out = F.lower(F.coalesce(question, F.lit(""))), F.lit(False)
    for p in ASSISTANT_PHRASES:
        out = out | low.contains(p)
    return out


def preferences(text: Column, most: int = 10) -> Column:
    """What a user says of their likes and troubles: the first distinct phrases of 5 to 80 characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in PREFERENCES])
    clean = F.transform(found, lambda t: F.regexp_replace(F.trim(t), r"[.,;!? ]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: F.char_length(t).between(5, 80))), 1, most)


def preference_documents(turns: DataFrame, most: int = 10) -> DataFrame:
    """(session_id, text) of sessions whose user turns (session_id, turn, role, content) tell preferences; one document each.

    Phrases are found a turn at a time; a session gathers its first phrases only.
    """
    own = turns.filter("role = 'user'").select("session_id", "turn", F.posexplode(preferences(F.col("content"), most)).alias("i", "phrase"))
    first = own.groupBy("session_id", "phrase").agg(F.min(F.struct("turn", "i")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy("at"))).filter(F.col("n") <= most)
    return ranked.groupBy("session_id").agg(F.concat(F.lit("User has mentioned: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "phrase"))), lambda p: p["phrase"]), "; ")).alias("text"))


def best_per_session(scored: DataFrame, score: str = "fused", key: str = "vec_id") -> DataFrame:
    """The best row of each query and session, ranked; ties to the lesser key."""
    one = scored.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "session_id").orderBy(score, key))).filter("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(score, key)))


def hall_fusion(distance: Column, record_hall: Column, question_halls: Column, found_first: Column | None = None) -> Column:
    """Less for records of the question's first hall (x 0.75) or another of its halls (x 0.90), and for those a first pass found (x 0.85)."""
    out = F.when(record_hall == question_halls[0], distance * 0.75).when(F.array_contains(question_halls, record_hall), distance * 0.90).otherwise(distance)
    return out if found_first is None else F.when(found_first, out * 0.85).otherwise(out)


def hit_at(ranked: DataFrame, targets: DataFrame, k: int, key: str) -> DataFrame:
    """(query_id, hit): is any target among the first k?"""
    first = ranked.filter(F.col("rank") <= k).join(targets.select("query_id", key).distinct(), ["query_id", key], "left_semi").select("query_id").distinct().withColumn("h", F.lit(True))
    return targets.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce("h", F.lit(False)).alias("hit"))


def session_texts(turns: DataFrame, all_roles: bool = False) -> DataFrame:
    """(session_id, text): a session's user turns, or all, in order, joined by line feeds; for sessions of a bounded length."""
    own = turns if all_roles else turns.filter("role = 'user'")
    return own.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda t: t["content"]), "\n").alias("text"))


def ranking_measures(ranked: DataFrame, relevant: DataFrame, k: int, key: str) -> DataFrame:
    """(query_id, recall_any, recall_all, ndcg) at k of `ranked` (query_id, key, rank) against `relevant` (query_id, key).

    The ideal gain is that of the retrieved list, best first. Queries without
    relevant records have recall_any 0 and recall_all 1.
    """
    wanted = relevant.select("query_id", key).distinct().withColumn("rel", F.lit(1.0))
    total = wanted.groupBy("query_id").agg(F.count("*").alias("total"))
    got = ranked.filter(F.col("rank") <= k).join(wanted, ["query_id", key], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    ideal = W.partitionBy("query_id").orderBy(F.desc("rel"), "rank")
    gain = got.withColumn("best", F.row_number().over(ideal))
    # gains are summed as whole numbers, so that the order of rows can't change them
    part = lambda at: F.round(F.col("rel") / F.log2(F.col(at) + 1) * 1e12).cast("bigint")
    per = gain.groupBy("query_id").agg(F.sum(part("rank")).alias("dcg"), F.sum(part("best")).alias("ideal"), F.sum("rel").alias("hits"))
    m = per.join(total, "query_id", "left")
    return m.select(
        "query_id",
        (F.col("hits") > 0).cast("double").alias("recall_any"),
        (F.col("hits") >= F.coalesce("total", F.lit(0))).cast("double").alias("recall_all"),
        F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"),
    )


def answer_words(c: Column) -> Column:
    """Normalised words of an answer: no commas, articles, conjunction or punctuation; lower case."""
    t = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("")), r"\b(a|an|the|and)\b", " ")
    t = F.lower(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\p{Punct}", ""))
    return F.filter(F.split(F.trim(t), " "), lambda w: w != "")


def token_f1(prediction: Column, truth: Column) -> Column:
    """Token F1 of two answers, words counted as often as they occur; both empty give 1."""
    a, b = answer_words(prediction), answer_words(truth)
    often = lambda x, w: F.size(F.filter(x, lambda v: v == w))
    same = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(often(a, w), often(b, w)))
    p, r = same / F.size(a), same / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).when(same == 0, 0.0).otherwise(2 * p * r / (p + r))


def nearest_rank(values: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, value): the value at rank round(p (n - 1)), halves to even."""
    order = W.partitionBy(group).orderBy(value)
    ranked = values.filter(F.col(value).isNotNull()).select(group, value, (F.row_number().over(order) - 1).alias("i"), F.count("*").over(W.partitionBy(group)).alias("n"))
    return ranked.filter(F.col("i") == F.bround(F.lit(p) * (F.col("n") - 1)).cast("int")).select(group, F.col(value).alias("value"))
