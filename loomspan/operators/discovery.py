"""What a folder of files and sessions is about: rooms, projects, known names, corrections, model-made index lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words of folder and file names, by the room they speak for.
ROOM_WORDS = {
    "frontend": ["frontend", "front-end", "front_end", "client", "ui", "views", "components", "pages"],
    "backend": ["backend", "back-end", "back_end", "server", "api", "routes", "services", "controllers", "models", "database", "db"],
    "documentation": ["docs", "doc", "documentation", "wiki", "readme", "notes"],
    "design": ["design", "designs", "mockups", "wireframes", "assets", "storyboard"],
    "costs": ["costs", "cost", "budget", "finance", "financial", "pricing", "invoices", "accounting"],
    "meetings": ["meetings", "meeting", "calls", "meeting_notes", "standup", "minutes"],
    "team": ["team", "staff", "hr", "hiring", "employees", "people"],
    "research": ["research", "references", "reading", "papers"],
    "planning": ["planning", "roadmap", "strategy", "specs", "requirements"],
    "testing": ["tests", "test", "testing", "qa"],
    "scripts": ["scripts", "tools", "utils"],
    "configuration": ["config", "configs", "settings", "infrastructure", "infra", "deploy"],
}
SKIPPED = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage"]


def _room(folder: Column) -> Column:
    out = F.lit(None).cast("string")
    for room, words in ROOM_WORDS.items():
        out = F.when(folder.isin(words), room).otherwise(out)
    return out


def rooms_from_folders(files: DataFrame, relative: str = "relative") -> DataFrame:
    """(room, folder) of folders at the first two levels, and always general.

    Known names give their room; other folders of the first level, with a
    letter first and three characters at least, are rooms of their own.
    """
    parts = F.split(F.col(relative), "/")
    depth = lambda i: F.when(F.size(parts) > i, parts[i - 1])
    each = files.select(F.explode(F.array(F.struct(F.lit(1).alias("level"), depth(1).alias("folder")), F.struct(F.lit(2).alias("level"), depth(2).alias("folder")))).alias("d"), depth(1).alias("top"))
    found = each.select("d.level", "d.folder", "top").filter("folder is not null").filter(~F.col("folder").isin(SKIPPED) & ~F.col("top").isin(SKIPPED)).dropDuplicates(["level", "folder"])
    name = F.translate(F.lower("folder"), "- ", "__")
    own = F.when((F.col("level") == 1) & F.col("folder").rlike(r"(?U)^\p{L}..") , name)
    rooms = found.select(F.coalesce(_room(name), own).alias("room"), "level", "folder").filter("room is not null")
    first = rooms.groupBy("room").agg(F.min(F.struct("level", "folder")).alias("f")).select("room", "f.folder")
    return first.unionByName(first.sparkSession.createDataFrame([("general", None)], "room string, folder string").join(first.filter("room = 'general'").select("room"), "room", "left_anti"))


def rooms_from_files(files: DataFrame, relative: str = "relative", most: int = 6) -> DataFrame:
    """(room, n): rooms that two file names or more speak for, the six most frequent; a name counts once a word it has."""
    name = F.translate(F.lower(F.element_at(F.split(F.col(relative), "/"), -1)), "- ", "__")
    hits = F.array(*[F.struct(F.lit(room).alias("room"), name.contains(w).alias("hit")) for room, words in ROOM_WORDS.items() for w in words])
    each = files.filter(~F.exists(F.split(F.col(relative), "/"), lambda p: p.isin(SKIPPED))).select(F.explode(F.filter(hits, lambda h: h["hit"])).alias("h"))
    return each.groupBy(F.col("h.room").alias("room")).agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "room").limit(most)


def session_projects(files: DataFrame, path: str = "path", modified: str = "modified") -> DataFrame:
    """(project, sessions): the best filled of the session folders of one name, most sessions first.

    Folders begin with a hyphen and hold .jsonl files; the project is the last part of the folder's name.
    """
    own = files.filter(F.col(path).endswith(".jsonl")).select(F.element_at(F.split(F.col(path), "/"), -2).alias("folder")).filter(F.col("folder").startswith("-"))
    per = own.groupBy("folder").agg(F.count("*").alias("sessions"))
    return per.groupBy(F.element_at(F.split("folder", "-"), -1).alias("project")).agg(F.max("sessions").alias("sessions")).orderBy(F.desc("sessions"), "project")


def merged_candidates(first: DataFrame, second: DataFrame, drop_uncertain: bool = False) -> DataFrame:
    """`first` and those of `second` (name, type, confidence, n) whose name, whatever the case, isn't there."""
    other = second.filter("type <> 'uncertain'") if drop_uncertain else second
    one = other.withColumn("_k", F.lower("name")).withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy(F.desc("confidence"), "name"))).filter("_n = 1").drop("_n")
    return first.unionByName(one.join(first.select(F.lower("name").alias("_k")).distinct(), "_k", "left_anti").drop("_k"))


#: Candidates listed of each type.
LISTED = {"person": 15, "project": 10, "uncertain": 8}


def listed_candidates(found: DataFrame) -> DataFrame:
    """The surest candidates of each type, as many as LISTED has."""
    order = W.partitionBy("type").orderBy(F.desc("confidence"), F.desc("n"), "name")
    most = F.create_map(*[F.lit(x) for pair in LISTED.items() for x in pair])[F.col("type")]
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


# Surroundings that speak for a name, and those that speak for an ordinary word.
NAME_CONTEXTS = [r"\b{n}\s+(?:said|told|asked|laughed|smiled|was|is|called|texted)\b", r"\b(?:with|saw|called|took)\s+{n}\b", r"\bpicked\s+up\s+{n}\b", r"\bdrop(?:ped)?\s+(?:off\s+)?{n}\b", r"\b{n}(?:'s|s')", r"\bhey\s+{n}\b", r"\bthanks?\s+{n}\b", r"^{n}[:\s]"]
WORD_CONTEXTS = [r"\bhave\s+you\s+{n}\b", r"\bif\s+you\s+{n}\b", r"\b{n}\s+since\b", r"\b{n}\s+again\b", r"\bnot\s+{n}\b", r"\b{n}\s+more\b", r"\b(?:would|could|will)\s+{n}\b", r"\b{n}\s+(?:of|in|at|for|to)\b"]


def looked_up(words: DataFrame, registry: DataFrame) -> DataFrame:
    """`words` (word, context) with type, confidence and name from `registry` (name, alias, type, confidence, ambiguous).

    Words match names and aliases whatever the case. An ambiguous name is
    taken as one only if its context speaks more for a name than for a word,
    as a concept if it is the other way round; otherwise as registered.
    """
    known = registry.select("name", "type", "confidence", "ambiguous", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(F.coalesce("alias", "name"))))).alias("_w")).dropDuplicates(["_w"])
    joined = words.withColumn("_w", F.lower("word")).join(known, "_w", "left")
    n = F.concat(F.lit(r"\Q"), F.col("_w"), F.lit(r"\E"))
    low = F.lower(F.coalesce("context", F.lit("")))

    def votes(forms: list[str]) -> Column:
        parts = [f.split("{n}") for f in forms]
        return sum((F.when(F.regexp_count(low, F.concat(F.lit(a), n, F.lit(b))) > 0, 1).otherwise(0) for a, b in parts), F.lit(0))

    person, concept = votes(NAME_CONTEXTS), votes(WORD_CONTEXTS)
    open_ = F.coalesce("ambiguous", F.lit(False)) & (low != "")
    kind = F.when(F.col("type").isNull(), "unknown").when(open_ & (person > concept), "person").when(open_ & (concept > person), "concept").otherwise(F.col("type"))
    sure = F.when(F.col("type").isNull(), 0.0).when(open_ & (person > concept), F.least(F.lit(0.95), 0.7 + 0.1 * person)).when(open_ & (concept > person), F.least(F.lit(0.9), 0.7 + 0.1 * concept)).otherwise(F.col("confidence"))
    return joined.select("word", "context", kind.alias("type"), F.round(sure, 6).alias("confidence"), F.coalesce("name", "word").alias("name"))


_KEEP = re.compile(r"\d|[A-Z][a-z]+[A-Z]|^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$|[-_]|https?://|www\.|/Users/|~/|\.[a-z]{2,4}$|[`*#{}\[\]\\]")


def corrected(text: str, speller: Callable[[str], str], names: frozenset[str] = frozenset(), words: frozenset[str] = frozenset()) -> str:
    """A text with misspelt lower-case words replaced, all white space kept.

    Short words, names, known words, code and addresses stay; so does a word
    whose correction is further than two edits, or three from eight letters on.
    """

    def fix(m: re.Match) -> str:
        token = m[0]
        bare = token.rstrip(".,!?;:'\")")
        if len(bare) < 4 or _KEEP.search(bare) or bare[0].isupper() or bare.lower() in names or bare.lower() in words:
            return token
        new = speller(bare)
        return new + token[len(bare) :] if _edits(bare, new) <= (3 if len(bare) >= 8 else 2) else token

    return re.sub(r"\S+", fix, text)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


#: Chunks of a source that one call of a model sees.
MODEL_CHUNKS = 50


def closets_by_model(records: DataFrame, model: Callable[[str], dict]) -> DataFrame:
    """(source_file, block, lines): index lines from a model's topics, quotes and summary of a source's texts.

    `model` maps a text to {topics, quotes, summary}. A source is seen in
    blocks of MODEL_CHUNKS chunks, so a large one is many calls, not one.
    """
    place = W.partitionBy("source_file", "block").orderBy("chunk_index", "id")
    own = records.select(F.coalesce("source_file", F.lit("unknown")).alias("source_file"), "id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("entities", F.lit("")).alias("entities"))
    own = own.withColumn("block", F.floor(F.col("chunk_index") / MODEL_CHUNKS)).withColumn("n", F.row_number().over(place)).withColumn("block", F.concat_ws(".", "block", F.floor((F.col("n") - 1) / MODEL_CHUNKS).cast("string")))
    g = own.groupBy("source_file", "block").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content"))).alias("c"), F.max("entities").alias("entities"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, block, chunks, entities in zip(pdf["source_file"], pdf["block"], pdf["c"], pdf["entities"]):
                found = model("\n\n".join(x["content"] for x in chunks)) or {}
                tail = f"|{entities}|→{','.join(x['id'] for x in chunks[:3])}"
                said = [*found.get("topics", [])[:15], *found.get("quotes", [])[:5], *([found["summary"][:200]] if found.get("summary") else [])]
                rows.append((source, block, [s + tail for s in said]))
            yield pd.DataFrame(rows, columns=["source_file", "block", "lines"])

    return g.mapInPandas(run, "source_file string, block string, lines array<string>")
