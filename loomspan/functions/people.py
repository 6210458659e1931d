"""Names in texts: candidates, scores as person or project, and attributed sayings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SINGLE = r"\b(?:[A-Z][a-z]+(?:[A-Z][a-z]+|[A-Z]{2,})+|[A-Z][a-z]{1,19})\b"
_PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"


def candidates(texts: DataFrame, stop: list[str], least: int = 3, text: str = "text") -> DataFrame:
    """(name, n): capitalised words and phrases that occur `least` times or more, without stop words."""
    found = F.concat(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SINGLE), F.lit(0)), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PHRASE), F.lit(0)))
    each = texts.select(F.explode(found).alias("name"))
    free = ~F.exists(F.split(F.lower("name"), r"\s+"), lambda w: w.isin(stop))
    return each.filter(free).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


# Forms around a name that speak for a person or a project, with their weights.
PERSON_VERBS = ["said", "asked", "told", "replied", "laughed", "smiled", "cried", "felt", "thinks?", "wants?", "loves?", "hates?", "knows?", "decided", "pushed", "wrote"]
GREETINGS = ["hey", "thanks?", "hi", "dear"]
PROJECT_VERBS = ["building", "built", "ship(?:ping|ped)?", "launch(?:ing|ed)?", "deploy(?:ing|ed)?", "install(?:ing|ed)?", "import", r"pip\s+install"]
PROJECT_NOUNS = ["architecture", "pipeline", "system", "repo"]
PRONOUNS = r"(?i)\b(?:she|her|hers|he|him|his|they|them|their)\b"


def _literal(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))


def _count(text: Column, *parts: Column | str) -> Column:
    pattern = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.regexp_count(text, pattern)


def scored(names: DataFrame, texts: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(name, n, person, project, dialogue, action, pronoun, addressed): weighted signals over all texts with the name.

    Texts are joined to the words they have, so a name meets only its own texts.
    """
    n = _literal(F.col(name))
    word = F.element_at(F.split(F.lower(name), r"\s+"), 1)
    lines = texts.withColumn("_words", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    met = names.withColumn("_word", word).join(lines.select(text, F.explode("_words").alias("_word")), "_word")
    t = F.col(text)
    dialogue = _count(t, r"(?mi)^>\s*", n, r"[:\s]") + _count(t, r"(?mi)^\[", n, r"\]") + _count(t, r'(?i)"', n, r"\s+said")
    colon = _count(t, "(?mi)^", n, r":\s")
    action = _count(t, r"(?i)\b", n, rf"\s+(?:{'|'.join(PERSON_VERBS)})\b") + _count(t, rf"(?i)\b(?:{'|'.join(GREETINGS)})\s+", n, r"\b")
    addressed = _count(t, r"(?i)\b(?:hey|thanks?|hi)\s+", n, r"\b")
    every = F.split(t, "\n", -1)
    near = F.size(F.filter(F.transform(every, lambda x, i: F.struct(F.lower(x).contains(F.lower(F.col(name))).alias("has"), F.array_join(F.slice(every, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)) + 3), " ").alias("around"))), lambda s: s["has"] & s["around"].rlike(PRONOUNS)))
    verbs = _count(t, rf"(?i)\b(?:{'|'.join(PROJECT_VERBS)})\s+", n, r"\b") + _count(t, r"(?i)\bthe\s+", n, rf"\s+(?:{'|'.join(PROJECT_NOUNS)})\b") + _count(t, r"(?i)\b", n, r"(?:\s+v\d+|\.py|-core|-local)\b")
    versions = _count(t, r"(?i)\b", n, r"[-_]v?\d+(?:\.\d+)*\b")
    code = _count(t, r"(?i)\b", n, r"\.(?:py|js|ts|yaml|yml|json|sh)\b")
    part = met.select(name, dialogue.alias("d"), colon.alias("c"), action.alias("a"), addressed.alias("h"), near.alias("p"), (2 * verbs + 3 * versions + 3 * code).alias("project"))
    g = part.groupBy(name).agg(*[F.sum(c).alias(c) for c in ("d", "c", "a", "h", "p", "project")])
    said = F.col("d") + F.when(F.col("c") >= 2, F.col("c")).otherwise(0)
    out = g.select(name, (3 * said + 2 * F.col("a") + 2 * F.col("p") + 4 * F.col("h")).alias("person"), "project", said.alias("dialogue"), F.col("a").alias("action"), F.col("p").alias("pronoun"), F.col("h").alias("addressed"))
    return names.join(out, name, "left").fillna(0)


def classified(scores: DataFrame) -> DataFrame:
    """`scores` with type (person, project, uncertain) and confidence."""
    total = F.col("person") + F.col("project")
    ratio = F.col("person") / F.nullif(total, F.lit(0))
    kinds = sum(((F.col(c) > 0).cast("int") for c in ("dialogue", "action", "pronoun", "addressed")), F.lit(0))
    strong = (F.col("pronoun") >= 5) & (F.col("pronoun") >= 0.2 * F.col("n"))
    sure = ((kinds >= 2) & (F.col("person") >= 5)) | strong
    kind = F.when(total == 0, "uncertain").when((ratio >= 0.7) & sure, "person").when(ratio >= 0.7, "uncertain").when(ratio <= 0.3, "project").otherwise("uncertain")
    confidence = (
        F.when(total == 0, F.least(F.lit(0.4), F.col("n") / 50))
        .when((ratio >= 0.7) & sure, F.least(F.lit(0.99), 0.5 + ratio * 0.5))
        .when(ratio >= 0.7, 0.4)
        .when(ratio <= 0.3, F.least(F.lit(0.99), 0.5 + (1 - ratio) * 0.5))
        .otherwise(0.5)
    )
    return scores.withColumn("type", kind).withColumn("confidence", F.bround(confidence, 2))


# Relations, and verbs that attribute a saying.
RELATIONS = ["father", "mother", "wife", "husband", "partner", "brother", "sister", "son", "daughter", "grandfather", "grandmother", "grandpa", "grandma", "dad", "mom", "teacher", "roshi"]
NAMED_RELATIONS = ["Dad", "Mom", "Father", "Mother", "Mama", "Papa", "Grandma", "Grandpa", "Grandmother", "Grandfather", "Roshi", "Teacher"]
ATTRIBUTION = r"(?:said|told\s+(?:me|us)|told|used\s+to\s+say|always\s+said|would\s+say|liked\s+to\s+say|taught\s+(?:me|us)|taught|wrote|noted|observed|put\s+it|repeated)"
_OWNER = r"(?:my|her|his|their|our|(?:[A-Z]\w+(?:'s|s'|'|s)))"
_SAYING = r"\s*[:,]?\s*[\"'‘“](.+?)[\"'’”]"
_QUOTED = re.compile(rf"\b{_OWNER}\s+({'|'.join(RELATIONS)})\b(?:\s+(?:often\s+|always\s+)?{ATTRIBUTION})?{_SAYING}", re.I | re.S)
_ALONE = re.compile(rf"\b{_OWNER}\s+({'|'.join(RELATIONS)})\b", re.I)
_NAMED = re.compile(rf"\b({'|'.join(NAMED_RELATIONS)})\b\s+(?:always\s+|often\s+)?{ATTRIBUTION}{_SAYING}", re.S)
#: Confidence of a relation with a saying and alone, and characters within which a second match is the same one.
WITH_QUOTE, RELATION_ONLY, SAME_PLACE = 0.75, 0.40, 20


def sayings(text: str) -> list[tuple[int, str, str | None, float, str]]:
    """(place, relation, saying, confidence, matched text) in order of place; weaker forms near stronger ones are dropped."""
    out: list[tuple[int, str, str | None, float, str]] = []
    for pattern, confidence in ((_QUOTED, WITH_QUOTE), (_ALONE, RELATION_ONLY), (_NAMED, WITH_QUOTE)):
        before = [o[0] for o in out] if pattern is not _QUOTED else []
        for m in pattern.finditer(text):
            if not any(abs(m.start() - p) < SAME_PLACE for p in before):
                quote = m[2].strip() if pattern is not _ALONE else None
                out.append((m.start(), m[1].lower(), quote, confidence, m[0]))
    return sorted(out, key=lambda o: o[0])


def attributed(df: DataFrame, keys: list[str], text: str, classifier: Callable[[str], float] | None = None, threshold: float = 0.7, around: int = 200) -> DataFrame:
    """(keys, place, relation, saying, confidence, context, id) of sayings whose confidence meets the threshold.

    `classifier` gives a confidence for a saying's surroundings; without one
    the form's own counts. Needs match places, so it runs in Arrow batches.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[keys].itertuples(index=False, name=None), pdf[text]):
                for at, relation, quote, floor, _ in sayings(t):
                    context = t[max(0, at - around) : at + around]
                    confidence = classifier(context) if classifier else floor
                    if confidence >= threshold:
                        rows.append((*k, at, relation, quote, confidence, context))
            yield pd.DataFrame(rows, columns=[*keys, "place", "relation", "saying", "confidence", "context"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", place int, relation string, saying string, confidence double, context string"
    out = df.filter(F.col(text).isNotNull()).select(*keys, text).mapInPandas(run, schema)
    ident = F.concat(F.lit("drawer_wing_lineage_"), F.col("relation"), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", "relation", F.coalesce("saying", F.lit("")), F.col(keys[0]).cast("string")), 256), 1, 24))
    return out.withColumn("id", ident)
