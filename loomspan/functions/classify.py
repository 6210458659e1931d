"""Keyword and pattern classifiers, as Catalyst columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import solid_lines, strip

# Keywords of halls and of conversation topics, in their order of precedence.
HALL_KEYWORDS = {
    "emotions": ["scared", "afraid", "worried", "happy", "sad", "love", "hate", "feel", "cry", "tears"],
    "consciousness": ["consciousness", "conscious", "aware", "real", "genuine", "soul", "exist", "alive"],
    "memory": ["memory", "remember", "forget", "recall", "archive", "palace", "store"],
    "technical": ["code", "python", "script", "bug", "error", "function", "api", "database", "server"],
    "identity": ["identity", "name", "who am i", "persona", "self"],
    "family": ["family", "kids", "children", "daughter", "son", "parent", "mother", "father"],
    "creative": ["game", "gameplay", "player", "app", "design", "art", "music", "story"],
}
TOPIC_KEYWORDS = {
    "technical": ["code", "python", "function", "bug", "error", "api", "database", "server", "deploy", "git", "test", "debug", "refactor"],
    "architecture": ["architecture", "design", "pattern", "structure", "schema", "interface", "module", "component", "service", "layer"],
    "planning": ["plan", "roadmap", "milestone", "deadline", "priority", "sprint", "backlog", "scope", "requirement", "spec"],
    "decisions": ["decided", "chose", "picked", "switched", "migrated", "replaced", "trade-off", "alternative", "option", "approach"],
    "problems": ["problem", "issue", "broken", "failed", "crash", "stuck", "workaround", "fix", "solved", "resolved"],
}
#: Characters of a text that keyword routing looks at; a rule of the routing itself.
ROUTED = 3000


def first_greatest(scores: dict[str, Column], default: str) -> Column:
    """Name of the greatest score above 0, the first of equals."""
    names = F.array(*[F.lit(k) for k in scores])
    return bound(F.array(*scores.values()), lambda s: F.when(F.array_max(s) > 0, F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))).otherwise(default))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with `value` worked out once, however often f has it."""
    return F.transform(F.array(value), f)[0]


def by_keywords(c: Column, keywords: dict[str, list[str]], window: int = ROUTED) -> Column:
    """The class with the most keywords contained; general without any. Null texts are general."""
    low = F.lower(F.substring(F.coalesce(c, F.lit("")), 1, window))
    lists = F.array(*[F.array(*[F.lit(w) for w in words]) for words in keywords.values()])
    names = F.array(*[F.lit(k) for k in keywords])
    counts = bound(low, lambda t: F.transform(lists, lambda words: F.size(F.filter(words, lambda w: t.contains(w)))))
    return bound(counts, lambda n: F.when(F.array_max(n) > 0, F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))).otherwise("general"))


def hall(c: Column) -> Column:
    return by_keywords(c, HALL_KEYWORDS)


def topic(c: Column) -> Column:
    return by_keywords(c, TOPIC_KEYWORDS)


def keyword_sql(column: str, keywords: dict[str, list[str]], window: int = ROUTED) -> str:
    """The same classification as SQL text."""
    low = f"lower(substr(coalesce({column}, ''), 1, {window}))"
    score = {k: " + ".join(f"CAST(contains({low}, '{w}') AS INTEGER)" for w in words) for k, words in keywords.items()}
    best = f"greatest({', '.join(score.values())})"
    return f"CASE WHEN {best} = 0 THEN 'general' " + " ".join(f"WHEN ({s}) = {best} THEN '{k}'" for k, s in score.items()) + " END"


def room(path: Column, content: Column, rooms: list[dict]) -> Column:
    """Room of a file: by folder name, then by file name, then by keyword counts in its first 2,000 characters.

    `rooms` are {name, keywords}; the first that fits wins, general without any.
    """
    low = F.lower(F.coalesce(path, F.lit("")))
    folders = F.slice(F.split(low, r"[/\\]"), 1, F.greatest(F.size(F.split(low, r"[/\\]")) - 1, F.lit(0)))
    file = F.element_at(F.split(low, r"[/\\]"), -1)
    names = {r["name"]: [r["name"].lower(), *[k.lower() for k in r.get("keywords", [])]] for r in rooms}
    count = lambda text, w: ((F.char_length(text) - F.char_length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("int")
    low_text = F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 2000))
    scored = bound(low_text, lambda text: first_greatest({k: sum((count(text, w) for w in words), F.lit(0)) for k, words in names.items()}, "general"))
    out = scored
    for k, words in reversed(list(names.items())):
        out = F.when(file.contains(words[0]), k).otherwise(out)
    for k, words in reversed(list(names.items())):
        out = F.when(F.exists(folders, lambda f: F.lit(False) if not words else f.isin(words)), k).otherwise(out)  # noqa: B023
    return out


# Marker patterns of five kinds of memories, and words of sentiment and resolution.
MEMORY_MARKERS = {
    "decision": [
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b", r"\bwe (should|decided|chose|went with|picked|settled on)\b", r"\bi'?m going (to|with)\b", r"\bbetter (to|than|approach|option|choice)\b",
        r"\binstead of\b", r"\brather than\b", r"\bthe reason (is|was|being)\b", r"\bbecause\b", r"\btrade-?off\b", r"\bpros and cons\b", r"\bover\b.*\bbecause\b", r"\barchitecture\b", r"\bapproach\b",
        r"\bstrategy\b", r"\bpattern\b", r"\bstack\b", r"\bframework\b", r"\binfrastructure\b", r"\bset (it |this )?to\b", r"\bconfigure\b", r"\bdefault\b",
    ],
    "preference": [
        r"\bi prefer\b", r"\balways use\b", r"\bnever use\b", r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b", r"\bi like (to|when|how)\b", r"\bi hate (when|how|it when)\b", r"\bplease (always|never|don'?t)\b",
        r"\bmy (rule|preference|style|convention) is\b", r"\bwe (always|never)\b", r"\bfunctional\b.*\bstyle\b", r"\bimperative\b", r"\bsnake_?case\b", r"\bcamel_?case\b", r"\btabs\b.*\bspaces\b", r"\bspaces\b.*\btabs\b", r"\buse\b.*\binstead of\b",
    ],
    "milestone": [
        r"\bit works\b", r"\bit worked\b", r"\bgot it working\b", r"\bfixed\b", r"\bsolved\b", r"\bbreakthrough\b", r"\bfigured (it )?out\b", r"\bnailed it\b", r"\bcracked (it|the)\b", r"\bfinally\b", r"\bfirst time\b", r"\bfirst ever\b",
        r"\bnever (done|been|had) before\b", r"\bdiscovered\b", r"\brealized\b", r"\bfound (out|that)\b", r"\bturns out\b", r"\bthe key (is|was|insight)\b", r"\bthe trick (is|was)\b", r"\bnow i (understand|see|get it)\b", r"\bbuilt\b", r"\bcreated\b",
        r"\bimplemented\b", r"\bshipped\b", r"\blaunched\b", r"\bdeployed\b", r"\breleased\b", r"\bprototype\b", r"\bproof of concept\b", r"\bdemo\b", r"\bversion \d", r"\bv\d+\.\d+",
        r"\d+x (compression|faster|slower|better|improvement|reduction)", r"\d+% (reduction|improvement|faster|better|smaller)",
    ],
    "problem": [
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b", r"\bdoesn'?t work\b", r"\bnot working\b", r"\bwon'?t\b.*\bwork\b", r"\bkeeps? (failing|crashing|breaking|erroring)\b", r"\broot cause\b", r"\bthe (problem|issue|bug) (is|was)\b",
        r"\bturns out\b.*\b(was|because|due to)\b", r"\bthe fix (is|was)\b", r"\bworkaround\b", r"\bthat'?s why\b", r"\bthe reason it\b", r"\bfixed (it |the |by )\b", r"\bsolution (is|was)\b", r"\bresolved\b", r"\bpatched\b", r"\bthe answer (is|was)\b", r"\b(had|need) to\b.*\binstead\b",
    ],
    "emotional": [
        r"\blove\b", r"\bscared\b", r"\bafraid\b", r"\bproud\b", r"\bhurt\b", r"\bhappy\b", r"\bsad\b", r"\bcry\b", r"\bcrying\b", r"\bmiss\b", r"\bsorry\b", r"\bgrateful\b", r"\bangry\b", r"\bworried\b", r"\blonely\b", r"\bbeautiful\b", r"\bamazing\b", r"\bwonderful\b",
        r"i feel", r"i'm scared", r"i love you", r"i'm sorry", r"i can't", r"i wish", r"i miss", r"i need", r"never told anyone", r"nobody knows", r"\*[^*]+\*",
    ],
}
POSITIVE = ["pride", "proud", "joy", "happy", "love", "loving", "beautiful", "amazing", "wonderful", "incredible", "fantastic", "brilliant", "perfect", "excited", "thrilled", "grateful", "warm", "breakthrough", "success", "works", "working", "solved", "fixed", "nailed", "heart", "hug", "precious", "adore"]
NEGATIVE = ["bug", "error", "crash", "crashing", "crashed", "fail", "failed", "failing", "failure", "broken", "broke", "breaking", "breaks", "issue", "problem", "wrong", "stuck", "blocked", "unable", "impossible", "missing", "terrible", "horrible", "awful", "worse", "worst", "panic", "disaster", "mess"]
RESOLVED = r"\b(fixed|solved|resolved|patched|got it working|it works|nailed it|figured (it )?out|the (fix|answer|solution))\b"
# Beginnings of lines that are code or commands.
CODE_LINES = [
    r"^[\$#]\s", r"^(cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s", r"^```", r"^(import|from|def|class|function|const|let|var|return)\s", r"^[A-Z_]{2,}=", r"^\|", r"^-{2,}",
    r"^[{}\[\]]\s*$", r"^((if|for|while|try|except|elif)\b|else:)", r"^\w+\.\w+\(", r"^\w+ = \w+\.\w+",
]


def is_code_line(line: Column) -> Column:
    """A line that begins as code or a command, or of more than 10 characters less than two in five are letters."""
    s = strip(line)
    letters = F.char_length(F.regexp_replace(s, r"\P{L}", ""))
    return (s != "") & (s.rlike("|".join(f"(?:{p})" for p in CODE_LINES)) | ((letters < 0.4 * F.char_length(s)) & (F.char_length(s) > 10)))


def prose(c: Column) -> Column:
    """Lines outside code fences that aren't code; the whole text where none is left."""
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, line: Column) -> Column:
        fence = strip(line).startswith("```")
        keep = ~fence & ~a["fenced"] & ~is_code_line(line)
        return F.struct((a["fenced"] != fence).alias("fenced"), F.when(keep, F.array_append(a["kept"], line)).otherwise(a["kept"]).alias("kept"))

    kept = strip(F.array_join(F.aggregate(F.split(c, "\n", -1), start, step, lambda a: a["kept"]), "\n"))
    return F.when(kept != "", kept).otherwise(c)


_TURN = r"(?i)^(>\s|(human|user|q|assistant|ai|a|claude|chatgpt)\s*:)"


def segments(c: Column) -> Column:
    """Speaker turns where three lines or more begin one, else paragraphs, else groups of 25 lines."""
    every = F.split(c, "\n", -1)
    turn = lambda x: strip(x).rlike(_TURN)
    grouped = F.aggregate(
        every,
        F.array().cast("array<string>"),
        lambda a, x: F.when((F.size(a) == 0) | turn(x), F.array_append(a, x)).otherwise(F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.element_at(a, -1), F.lit("\n"), x)))),
    )
    paragraphs = F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda x: x != "")
    groups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(25)), lambda i: strip(F.array_join(F.slice(every, i, F.lit(25)), "\n")))
    return (
        F.when(F.size(F.filter(every, turn)) >= 3, grouped)
        .when((F.size(paragraphs) <= 1) & (F.size(every) > 20), F.filter(groups, lambda x: x != ""))
        .otherwise(paragraphs)
    )


def required_literal(pattern: str) -> str:
    """The longest plain text that every match of a pattern has; '' if there is none."""
    best = run = ""
    for op, arg in re._parser.parse(pattern):
        run = run + chr(arg) if str(op) == "LITERAL" else ""
        best = max(best, run, key=len)
    return best


def occurrences(text: Column, pattern: str) -> Column:
    """Matches of a pattern; the text is searched only where it has the pattern's plain part."""
    count, literal = F.regexp_count(text, F.lit(pattern)), required_literal(pattern)
    return F.when(text.contains(literal), count).otherwise(0) if literal else count


def with_memory(df: DataFrame, segment: str) -> DataFrame:
    """`df` with memory_type and confidence of its segments; null where no marker fits.

    Prose, scores and the best kind are columns of their own, so that each is
    worked out once.
    """
    kinds = list(MEMORY_MARKERS)
    text = F.col("_prose")
    out = df.withColumn("_prose", F.lower(prose(F.col(segment))))
    out = out.select("*", *[sum((occurrences(text, p) for p in MEMORY_MARKERS[k]), F.lit(0)).alias(f"_{k}") for k in kinds], F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))).alias("_words"))
    score = {k: F.col(f"_{k}") for k in kinds}
    amount = lambda known: F.size(F.array_intersect("_words", F.array(*[F.lit(x) for x in known])))
    out = out.withColumn("_best", first_greatest(score, "none")).withColumn("_positive", amount(POSITIVE) > amount(NEGATIVE)).withColumn("_solved", text.rlike(RESOLVED))
    size = F.char_length(segment)
    bonus = F.when(size > 500, 2).when(size > 200, 1).otherwise(0)
    trouble, positive = F.col("_best") == "problem", F.col("_positive")
    kind = (
        F.when(trouble & F.col("_solved") & positive & (score["emotional"] > 0), "emotional")
        .when(trouble & F.col("_solved"), "milestone")
        .when(trouble & positive & (score["milestone"] > 0), "milestone")
        .when(trouble & positive & (score["emotional"] > 0), "emotional")
        .otherwise(F.col("_best"))
    )
    found = F.col("_best") != "none"
    confidence = F.least(F.lit(1.0), (F.greatest(*score.values()) + bonus) / 5.0)
    return out.select(*df.columns, F.when(found, kind).alias("memory_type"), F.when(found, confidence).alias("confidence"))


# Terms that tell a corpus of assistant dialogues.
CLEAR_TERMS = ["Anthropic", "Claude Code", "Claude 3", "Claude 4", "claude mcp", "CLAUDE.md", ".claude/", "ChatGPT", "GPT-4", "GPT-3", "GPT-5", "OpenAI", "gpt-4o", "gpt-4-turbo", "o1-preview", "o3", "gemini-pro", "gemini-1.5", "Google AI", "Mixtral", "Cohere", "MCP", "LLM", "RAG", "fine-tune", "context window", "embedding"]
UNCLEAR_TERMS = ["Claude", "Opus", "Sonnet", "Haiku", "Gemini", "Bard", "Llama", "Mistral"]
TURN_MARKERS = [r"\buser\s*:\s*", r"\bassistant\s*:\s*", r"\bhuman\s*:\s*", r"\bai\s*:\s*", r"\b>>>\s*User\b", r"\b>>>\s*Assistant\b"]


def _term(term: str) -> str:
    a = r"\b" if term[0].isalnum() else ""
    b = r"\b" if term[-1].isalnum() else ""
    return a + re.escape(term) + b


def origin_counts(c: Column) -> dict[str, Column]:
    """Hits of clear terms, unclear terms and turn markers, and characters, of one text; sums tell the corpus."""
    count = lambda patterns: sum((F.regexp_count(c, F.lit("(?i)" + p)) for p in patterns), F.lit(0))
    return {"clear": count([_term(t) for t in CLEAR_TERMS]), "unclear": count([_term(t) for t in UNCLEAR_TERMS]), "turns": count(TURN_MARKERS), "chars": F.char_length(c)}


def origin_verdict(clear: Column, unclear: Column, turns: Column, chars: Column) -> tuple[Column, Column]:
    """(likely an assistant dialogue, confidence) from a corpus' sums."""
    brands = clear + F.when((clear > 0) | (turns > 0), unclear).otherwise(0)
    size = F.greatest(chars, F.lit(1))
    brand, turn = brands * 1000.0 / size, turns * 1000.0 / size
    dense = (brand >= 0.5) | (turn >= 2.0)
    plain = (brands == 0) & (turns == 0) & (chars >= 150)
    return dense | ~plain, F.when(dense, F.least(F.lit(0.95), 0.6 + 0.1 * (brand + turn))).when(plain, 0.9).otherwise(0.4)


# Capitalised words that are no names.
NO_ENTITIES = ["The", "This", "That", "These", "Those", "When", "Where", "What", "Why", "Who", "Which", "How", "After", "Before", "Then", "Now", "Here", "There", "And", "But", "Or", "Yet", "So", "If", "Else", "Yes", "No", "Maybe", "Okay", "User", "Assistant", "System", "Tool", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_CANDIDATE = r"\b(?:[A-Z][a-z]+(?:[A-Z][a-z]+|[A-Z]{2,})+|[A-Z][a-z]{1,19})\b"


def entity_words(c: Column, window: int = 5000, most: int = 25) -> Column:
    """Capitalised words that occur twice or more in the first 5,000 characters, sorted, 25 at most."""
    found = F.filter(F.regexp_extract_all(F.substring(F.coalesce(c, F.lit("")), 1, window), F.lit(_CANDIDATE), F.lit(0)), lambda w: ~w.isin(NO_ENTITIES) & (F.char_length(w) > 2))
    twice = F.filter(F.array_distinct(found), lambda w: F.size(F.filter(found, lambda x: x == w)) >= 2)
    return F.slice(F.array_sort(twice), 1, most)


_ACTION = r"(?i)(?:built|fixed|wrote|added|pushed|tested|created|decided|migrated|reviewed|deployed|configured|removed|updated)\s+[\w\s]{3,40}"


def closet_lines(c: Column, drawer: Column, wing: Column, room_: Column, source: Column) -> Column:
    """Index lines topic|entities|→drawer of a text: action phrases, headings and quotes, else one line of its place."""
    window = F.substring(F.coalesce(c, F.lit("")), 1, 5000)
    found = F.filter(F.regexp_extract_all(window, F.lit(_CANDIDATE), F.lit(0)), lambda w: ~w.isin(NO_ENTITIES))
    often = F.filter(F.transform(F.array_distinct(found), lambda w: F.struct((-F.size(F.filter(found, lambda x: x == w))).alias("n"), F.array_position(found, w).alias("at"), w.alias("w"))), lambda s: s["n"] <= -2)
    names = F.array_join(F.transform(F.slice(F.array_sort(often), 1, 5), lambda s: s["w"]), ";")
    headings = F.regexp_extract_all(window, F.lit(r"(?m)^#{1,3}\s+(.{5,60})$"), F.lit(1))
    topics = F.slice(F.array_distinct(F.transform(F.concat(F.regexp_extract_all(window, F.lit(_ACTION), F.lit(0)), headings), lambda t: F.lower(strip(t)))), 1, 12)
    quotes = F.slice(F.regexp_extract_all(window, F.lit(r'"([^"]{15,150})"'), F.lit(1)), 1, 3)
    tail = F.concat(F.lit("|"), names, F.lit("|→"), drawer)
    stem = F.substring(F.regexp_replace(F.element_at(F.split(F.coalesce(source, F.lit("")), "/"), -1), r"(?<=.)\.[^.]*$", ""), 1, 40)
    own = F.concat(F.transform(topics, lambda t: F.concat(t, tail)), F.transform(quotes, lambda q: F.concat(F.lit('"'), q, F.lit('"'), tail)))
    place = F.concat(F.coalesce(wing, F.lit("")), F.lit("/"), F.coalesce(room_, F.lit("")), F.lit("/"), stem, tail)
    return F.when(F.size(own) > 0, own).otherwise(F.array(place))


def pointers(closet: Column) -> Column:
    """Record ids that a closet's lines point to, in order, once each."""
    found = F.regexp_extract_all(closet, F.lit(r"→([\w,]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(found, lambda x: F.split(x, ","))), lambda x: x != ""))


def pack(items: Column, most: int = 1500) -> Column:
    """Lines packed in order into texts of at most `most` characters, a longer line alone; never split."""
    start = F.array().cast("array<string>")
    fits = lambda a, x: (F.size(a) > 0) & (F.char_length(F.element_at(a, -1)) + 1 + F.char_length(x) + 1 <= most)
    return F.aggregate(items, start, lambda a, x: F.when(fits(a, x), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.element_at(a, -1), F.lit("\n"), x)))).otherwise(F.array_append(a, x)))


_CLAIM_A = r"\b([A-Z][\w-]+)\s+is\s+([A-Z][\w-]+)'s\s+([a-z]{3,20})\b"
_CLAIM_B = r"\b([A-Z][\w-]+)'s\s+([a-z]{3,20})\s+is\s+([A-Z][\w-]+)\b"


def claims(c: Column) -> Column:
    """array<struct<subject, predicate, object>> of "X is Y's Z" and "X's Z is Y"."""
    part = lambda pattern, i: F.regexp_extract_all(c, F.lit(pattern), F.lit(i))
    zipped = lambda s, p, o: F.transform(F.arrays_zip(s.alias("s"), p.alias("p"), o.alias("o")), lambda x: F.struct(x["s"].alias("subject"), F.lower(x["p"]).alias("predicate"), x["o"].alias("object")))
    return F.concat(zipped(part(_CLAIM_A, 1), part(_CLAIM_A, 3), part(_CLAIM_A, 2)), zipped(part(_CLAIM_B, 3), part(_CLAIM_B, 2), part(_CLAIM_B, 1)))


def solid_count(c: Column) -> Column:
    return F.size(solid_lines(c))
