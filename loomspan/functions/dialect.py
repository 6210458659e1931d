"""Keyword summaries of texts: entities | topics | key sentence | emotions | flags."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomspan.functions.text import strip

# Words that signal an emotion or a flag, in order, and codes of named emotions.
EMOTION_SIGNALS = {"decided": "determ", "prefer": "convict", "worried": "anx", "excited": "excite", "frustrated": "frust", "confused": "confuse", "love": "love", "hate": "rage", "hope": "hope", "fear": "fear", "trust": "trust", "happy": "joy", "sad": "grief", "surprised": "surprise", "grateful": "grat", "curious": "curious", "wonder": "wonder", "anxious": "anx", "relieved": "relief", "satisf": "satis", "disappoint": "grief", "concern": "anx"}
FLAG_SIGNALS = {"decided": "DECISION", "chose": "DECISION", "switched": "DECISION", "migrated": "DECISION", "replaced": "DECISION", "instead of": "DECISION", "because": "DECISION", "founded": "ORIGIN", "created": "ORIGIN", "started": "ORIGIN", "born": "ORIGIN", "launched": "ORIGIN", "first time": "ORIGIN", "core": "CORE", "fundamental": "CORE", "essential": "CORE", "principle": "CORE", "belief": "CORE", "always": "CORE", "never forget": "CORE", "turning point": "PIVOT", "changed everything": "PIVOT", "realized": "PIVOT", "breakthrough": "PIVOT", "epiphany": "PIVOT", "api": "TECHNICAL", "database": "TECHNICAL", "architecture": "TECHNICAL", "deploy": "TECHNICAL", "infrastructure": "TECHNICAL", "algorithm": "TECHNICAL", "framework": "TECHNICAL", "server": "TECHNICAL", "config": "TECHNICAL"}
EMOTION_CODES = {"vulnerability": "vul", "vulnerable": "vul", "joy": "joy", "joyful": "joy", "fear": "fear", "mild_fear": "fear", "trust": "trust", "trust_building": "trust", "grief": "grief", "raw_grief": "grief", "wonder": "wonder", "philosophical_wonder": "wonder", "rage": "rage", "anger": "rage", "love": "love", "devotion": "love", "hope": "hope", "despair": "despair", "hopelessness": "despair", "peace": "peace", "relief": "relief", "humor": "humor", "dark_humor": "humor", "tenderness": "tender", "raw_honesty": "raw", "brutal_honesty": "raw", "self_doubt": "doubt", "anxiety": "anx", "exhaustion": "exhaust", "conviction": "convict", "quiet_passion": "passion", "warmth": "warmth", "curiosity": "curious", "gratitude": "grat", "frustration": "frust", "confusion": "confuse", "satisfaction": "satis", "excitement": "excite", "determination": "determ", "surprise": "surprise"}
# Words that name nothing.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "about", "between", "through",
    "during", "before", "after", "above", "below", "up", "down", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "just", "don", "now", "and", "but", "or", "if", "while", "that", "this", "these", "those", "it", "its", "i",
    "we", "you", "he", "she", "they", "me", "him", "her", "us", "them", "my", "your", "his", "our", "their", "what", "which", "who", "whom", "also",
    "much", "many", "like", "because", "since", "get", "got", "use", "used", "using", "make", "made", "thing", "things", "way", "well", "really",
    "want", "need",
]
_WORD, _STOP = re.compile(r"[a-zA-Z][a-zA-Z_-]{2,}"), frozenset(STOP_WORDS)
KEY_WORDS = ["decided", "because", "instead", "prefer", "switched", "chose", "realized", "important", "key", "critical", "discovered", "learned", "conclusion", "solution", "reason", "why", "breakthrough", "insight"]


def _signals(low: Column, signals: dict[str, str], most: int = 3) -> Column:
    hits = F.array(*[F.when(low.contains(k), v) for k, v in signals.items()])
    return F.slice(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())), 1, most)


def emotions(c: Column) -> Column:
    return _signals(F.lower(c), EMOTION_SIGNALS)


def flags(c: Column) -> Column:
    return _signals(F.lower(c), FLAG_SIGNALS)


def top_words(text: str | None, most: int = 3) -> list[str]:
    """Words of three letters or more by frequency, names and compounds counting two more each time; first seen on ties."""
    score: dict[str, int] = {}
    for w in _WORD.findall(text or ""):
        low = w.lower()
        if low not in _STOP:
            score[low] = score.get(low, 0) + 1 + 2 * w[0].isupper() + 2 * ("_" in w or "-" in w or any(c.isupper() for c in w[1:]))
    return sorted(score, key=lambda w: -score[w])[:most]


@F.pandas_udf(ArrayType(StringType()))
def topics(texts: pd.Series) -> pd.Series:
    """top_words of each text; counting words within a row is quadratic with built-in functions."""
    return texts.map(top_words)


def key_sentence(c: Column) -> Column:
    """The sentence with most key words, short ones preferred, the first of equals; 55 characters at most."""
    parts = F.filter(F.transform(F.split(c, r"[.!?\n]+"), strip), lambda s: F.char_length(s) > 10)

    def score(s: Column) -> Column:
        n, low = F.char_length(s), F.lower(s)
        words = sum((F.when(low.contains(w), 2).otherwise(0) for w in KEY_WORDS), F.lit(0))
        return words + F.when(n < 80, 1).otherwise(0) + F.when(n < 40, 1).otherwise(0) - F.when(n > 150, 2).otherwise(0)

    best = F.array_sort(F.transform(parts, lambda s, i: F.struct((-score(s)).alias("s"), i.alias("i"), s.alias("t"))))
    text = F.try_element_at(best, F.lit(1))["t"]
    return F.coalesce(F.when(F.char_length(text) > 55, F.concat(F.substring(text, 1, 52), F.lit("..."))).otherwise(text), F.lit(""))


def entity_codes(c: Column, known: dict[str, str] | None = None, most: int = 3) -> Column:
    """Codes of known names that occur, else the first letters of capitalised words after the first."""
    low = F.lower(c)
    own = F.array_distinct(F.filter(F.array(*[F.when(low.contains(n.lower()), code) for n, code in (known or {}).items()], F.lit(None).cast("string")), lambda x: x.isNotNull()))
    words = F.slice(F.filter(F.split(c, r"\s+"), lambda w: w != ""), F.lit(2), F.lit(1_000_000))
    clean = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-zA-Z]", "")), lambda w: w.rlike(r"^[A-Z][a-z]+$") & ~F.lower(w).isin(STOP_WORDS))
    auto = F.slice(F.array_distinct(F.transform(clean, lambda w: F.upper(F.substring(w, 1, 3)))), 1, most)
    return F.when(F.size(own) > 0, own).otherwise(auto)


def with_summary(df: DataFrame, text: str, wing: str | None = None, room: str | None = None, source: str | None = None, known: dict[str, str] | None = None) -> DataFrame:
    """`df` with `summary`: codes | topics | key sentence | emotions | flags, after a line of its place if there is one.

    Null texts count as empty. The parts are columns of their own, so that
    each is worked out once.
    """
    t = F.coalesce(text, F.lit(""))
    own = df.select("*", F.slice(entity_codes(t, known), 1, 3).alias("_codes"), topics(t).alias("_topics"), key_sentence(t).alias("_sentence"), emotions(t).alias("_emotions"), flags(t).alias("_flags"))
    listed = lambda c, sep: F.when(F.size(c) > 0, F.array_join(c, sep))
    body = F.concat_ws(
        "|",
        F.concat(F.lit("0:"), F.coalesce(listed("_codes", "+"), F.lit("???"))),
        F.coalesce(listed("_topics", "_"), F.lit("misc")),
        F.when(F.col("_sentence") != "", F.concat(F.lit('"'), "_sentence", F.lit('"'))),
        listed("_emotions", "+"),
        listed("_flags", "+"),
    )
    some = lambda c: F.lit("?") if c is None else F.when(F.coalesce(c, F.lit("")) != "", F.col(c)).otherwise("?")
    stem = F.lit("?") if source is None else F.when(some(source) != "?", F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"(?<=.)\.[^.]*$", "")).otherwise("?")
    place = F.concat(F.concat_ws("|", some(wing), some(room), F.lit("?"), stem), F.lit("\n"))
    has = (some(wing) != "?") | (some(source) != "?")
    return own.select(*df.columns, F.when(has, F.concat(place, body)).otherwise(body).alias("summary"))


def encode_emotions(names: Column) -> Column:
    """Codes of named emotions, three at most, joined by +; unknown ones by their first four letters."""
    codes = F.create_map(*[F.lit(x) for pair in EMOTION_CODES.items() for x in pair])
    return F.array_join(F.slice(F.array_distinct(F.transform(names, lambda n: F.coalesce(codes[n], F.substring(n, 1, 4)))), 1, 3), "+")


# ---- structured notes ---------------------------------------------------------

# Words that make a quote weightier.
FELT = ["love", "fear", "remember", "soul", "feel", "stupid", "scared", "beautiful", "destroy", "respect", "trust", "consciousness", "alive", "forget", "waiting", "peace", "matter", "real", "guilt", "escape", "rest", "hope", "dream", "lost", "found"]


def entity_code(name: str, codes: dict[str, str], skipped: tuple[str, ...] = ()) -> str | None:
    """A person's code: given, by a part of the name, or its first three letters; none for skipped names."""
    low = name.lower()
    if any(s.lower() in low for s in skipped):
        return None
    exact = {k.lower(): v for k, v in codes.items()}
    return exact.get(low) or next((v for k, v in exact.items() if k in low), name[:3].upper())


def key_quote(note: dict) -> str:
    """The weightiest quotation in a note, else what follows a dash in its title."""
    text = " ".join(str(note.get(k) or "") for k in ("content", "origin_label", "notes"))
    found = re.findall(r'"([^"]{8,55})"', text) + [m[1] for m in re.finditer(r"(?:^|[\s(])'([^']{8,55})'(?:[\s.,;:!?)]|$)", text)]
    found += re.findall(r"(?i)(?:says?|said|articulates?|reveals?|admits?|confesses?|asks?):\s*[\"']?([^.!?]{10,55})[.!?]", text)
    quotes = [q for q in dict.fromkeys(q.strip() for q in found) if len(q) >= 8]

    def weight(q: str) -> int:
        return 2 * q[0].isupper() + 2 * sum(w in q.lower() for w in FELT) + (len(q) > 20) - 2 * q.startswith(("The ", "This ", "She "))

    if quotes:
        return max(quotes, key=weight)
    _, dash, rest = str(note.get("title") or "").partition(" - ")
    return rest[:45] if dash else ""


def note_flags(note: dict) -> str:
    notes, origin = str(note.get("notes") or "").lower(), str(note.get("origin_label") or "").lower()
    rules = [("ORIGIN", bool(note.get("origin_moment"))), ("SENSITIVE", str(note.get("sensitivity") or "").upper().startswith("MAXIMUM")), ("CORE", "core" in notes or "foundational pillar" in notes), ("GENESIS", "genesis" in notes or "genesis" in origin), ("PIVOT", "pivot" in notes)]
    return "+".join(k for k, on in rules if on)


def note_line(note: dict, codes: dict[str, str] | None = None, skipped: tuple[str, ...] = ()) -> str:
    """id:people|topics|"quote"|weight|emotions|flags of one note; parts it lacks are left out."""
    people = sorted({c for p in note.get("people") or [] if (c := entity_code(p, codes or {}, skipped))})
    felt = list(dict.fromkeys(EMOTION_CODES.get(e, e[:4]) for e in note.get("emotional_tone") or []))[:3]
    quote = key_quote(note)
    parts = [f"{str(note['id']).rpartition('-')[2]}:{'+'.join(people) or '???'}", "_".join((note.get("topics") or [])[:2]) or "misc", f'"{quote}"' if quote else "", str(note.get("emotional_weight", 0.5)), "+".join(felt), note_flags(note)]
    return "|".join(p for p in parts if p)


def link_line(link: dict) -> str:
    label = str(link.get("label") or "")
    return f"T:{link['from'].rpartition('-')[2]}<->{link['to'].rpartition('-')[2]}|{label.partition(':')[0] if ':' in label else label[:30]}"


def encode_notes(document: dict, codes: dict[str, str] | None = None) -> str:
    """A file of notes: a heading, the arc, a line a note and a line a link."""
    source = str(document.get("source_file") or "unknown")
    number, dash, rest = source.partition("-")
    notes = document.get("zettels") or []
    people = sorted({c for n in notes for p in n.get("people") or [] if (c := entity_code(p, codes or {}))})[:3]
    when = notes[0].get("date_context", "unknown") if notes else "unknown"
    head = f"{number if dash else '000'}|{'+'.join(people) or '???'}|{when}|{rest.replace('.txt', '').strip() if dash else source}"
    arc = [f"ARC:{document['emotional_arc']}"] if document.get("emotional_arc") else []
    return "\n".join([head, *arc, *(note_line(n, codes) for n in notes), *(link_line(t) for t in document.get("tunnels") or [])])


def decode_notes(text: str) -> dict:
    """The parts of an encoded file: heading, arc, notes and links."""
    out: dict = {"header": {}, "arc": "", "notes": [], "links": []}
    for line in filter(None, text.split("\n")):
        if line.startswith("ARC:"):
            out["arc"] = line[4:]
        elif line.startswith("T:"):
            out["links"].append(line)
        elif ":" in line.partition("|")[0]:
            out["notes"].append(line)
        else:
            out["header"] = dict(zip(("file", "entities", "date", "title"), line.split("|")))
    return out


def encoded_notes(files: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """(path, summary) of JSON files of notes; files that aren't are left out."""
    import json
    from collections.abc import Iterator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                try:
                    rows.append((k, encode_notes(json.loads(t or ""))))
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "summary"])

    return files.select(key, text).mapInPandas(run, f"{key} string, summary string")


def size_ratio(original: Column, summary: Column) -> Column:
    """Estimated tokens of a text by those of its summary."""
    from loomspan.functions.text import token_estimate

    return F.round(token_estimate(original) / F.greatest(token_estimate(summary), F.lit(1)), 1)
