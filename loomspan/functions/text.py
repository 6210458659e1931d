"""Scalar functions over text, as Catalyst columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at a text's ends, in every script.
_EDGE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def solid_lines(c: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(lines(c), lambda x: x.rlike(r"(?U)\S"))


def tokens(c: Column) -> Column:
    """Lower-case runs of two or more word characters, in order; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def numbered_lines(c: Column, start: int = 1) -> Column:
    """[N] before each line; lines that have such a number stay, and are counted. Null and empty give ''."""
    each = F.transform(lines(c), lambda x, i: F.when(x.rlike(r"^\[\d+\]"), x).otherwise(F.concat(F.lit("["), (i + start).cast("string"), F.lit("] "), x)))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.array_join(each, "\n"))


def line_range(c: Column, first: int, last: int) -> Column:
    """The numbered lines first..last, clamped; '' where there are none."""
    a = max(1, first)
    if last < a:
        return F.lit("")
    part = F.slice(lines(c), a, last - a + 1)
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(F.size(part) < 1, "").otherwise(numbered_lines(F.array_join(part, "\n"), a))


def newline_normalize(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def line_trim(c: Column) -> Column:
    return F.array_join(F.transform(lines(c), strip), "\n")


def whitespace_collapse(c: Column) -> Column:
    """At most two blank lines in a row."""
    return F.regexp_replace(c, r"\n(?:[ \t]*\n){3,}", "\n\n\n")


def blank_line_drop(c: Column) -> Column:
    return F.array_join(solid_lines(c), "\n")


def line_join_spaces(c: Column) -> Column:
    return F.array_join(F.transform(solid_lines(c), strip), " ")


def utf8_replace_invalid(b: Column) -> Column:
    """Text of bytes, each invalid sequence as U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


# Tags, line beginnings and hook lines that tools add to transcripts.
NOISE_TAGS = ["system-reminder", "command-message", "command-name", "task-notification", "user-prompt-submit-hook", "hook_output"]
NOISE_LINES = [
    "CURRENT TIME:", "VERIFIED FACTS (do not contradict)", "AGENT SPECIALIZATION:", "Checking verified facts...", "Injecting timestamp...", "Starting background pipeline...",
    "Checking emotional weights...", "Auto-save reminder...", "Checking pipeline...",
]
HOOKS = ["Stop", "PreCompact", "PreToolUse", "PostToolUse", "UserPromptSubmit", "Notification", "SessionStart", "SessionEnd"]


def strip_noise(c: Column) -> Column:
    """Without tool tags, status lines and display remnants that start a line.

    A tag's body never crosses a blank line, so an unclosed tag takes nothing.
    """
    out = c
    for tag in NOISE_TAGS:
        out = F.regexp_replace(out, rf"(?m)^(?:> )?<{tag}(?:\s[^>]*)?>(?:(?!\n\s*\n)[\s\S])*?</{tag}>[ \t]*\n?", "")
    starts = "|".join(re.escape(x) for x in NOISE_LINES)
    out = F.regexp_replace(out, rf"(?m)^(?:> )?(?:{starts}).*\n?", "")
    out = F.regexp_replace(out, rf"(?m)^(?:> )?Ran \d+ (?:{'|'.join(HOOKS)}) hooks?.*\n?", "")
    out = F.regexp_replace(out, r"(?m)^(?:> )?…\s*\+\d+ lines.*\n?", "")
    out = F.regexp_replace(out, r"\s*\[\d+\s+tokens?\]\s*\(ctrl\+o to expand\)", "")
    return strip(F.regexp_replace(out, r"\n{4,}", "\n\n\n"))


# Forms of the lines that mark tool output.
_LOG = r"^(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|(?:INFO|WARNING|ERROR|DEBUG|CRITICAL):|\[(?:vestige|chromadb|httpx|urllib3|asyncio)\.)"
_PS = r"^\s*[a-z][\w-]{2,}\s+\d+\s+\d+\.\d+\s+\d+\.\d+\s"
_DIFF = r"^\s*\d+[+\-:]\s"
_ARROW = r"^\s*→\s"
_JSON_LINE = r'^\s*\{"\w+":'
_JSON_PAIR = r',"\w+":'
_LOG_MARK = r'"(?:uuid|sessionId|requestId|messageId|parentUuid)"\s*:|"timestamp"\s*:\s*"\d{4}-\d{2}-\d{2}'


def is_noise(c: Column) -> Column:
    """Is the text mostly tool output: logs, process lists, numbered diffs, arrows, JSON rows or a stub?

    Null and blank texts are.
    """
    own = solid_lines(c)
    n = F.size(own)
    of = lambda pattern: F.size(F.filter(own, lambda x: x.rlike(pattern)))
    stub = F.char_length(strip(F.regexp_replace(c, r"\[truncated[^\]]*\]|Output too large[^\n]*", ""))) < 100
    arrows = (F.char_length(c) - F.char_length(F.replace(c, F.lit(" → "), F.lit("")))) / 3
    pairs = F.size(F.regexp_extract_all(c, F.lit(_JSON_PAIR), F.lit(0)))
    noisy = (
        (of(_LOG) >= 0.7 * n) | (of(_PS) >= 0.5 * n) | (of(_DIFF) >= 0.7 * n) | (of(_ARROW) >= 0.6 * n)
        | ((c.contains("Output too large") | c.contains("[truncated,")) & stub)
        | ((n <= 3) & (arrows > 5))
        | (of(_JSON_LINE) >= 0.5 * n)
        | ((pairs > 0) & c.rlike(_LOG_MARK) & (pairs * 200 >= F.char_length(c)))
    )
    return F.when(F.coalesce(c.rlike(r"(?U)\S"), F.lit(False)), noisy).otherwise(True)


def slug(c: Column) -> Column:
    """Wing slug: lower case, blanks and hyphens as _."""
    return F.translate(F.lower(c), " -", "__")


def listed(c: Column, separator: str = ";") -> Column:
    """Trimmed distinct items of a joined string, in order; null gives none."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(separator)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def token_estimate(c: Column) -> Column:
    """1.3 tokens a word, one at least."""
    words = F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0)))
    return F.greatest(F.lit(1), F.floor(words * 1.3).cast("int"))


def iso_temporal(c: Column) -> Column:
    """A date or UTC time in canonical form, +00:00 as Z; null for anything else."""
    t = strip(c)
    shape = t.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(Z|\+00:00))?$")
    real = F.try_make_timestamp_ntz(F.substring(t, 1, 4).try_cast("int"), F.substring(t, 6, 2).try_cast("int"), F.substring(t, 9, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).isNotNull()
    return F.when(shape & real, F.regexp_replace(t, r"\+00:00$", "Z"))


def valid_name(c: Column, most: int = 128) -> Column:
    """Usable as a wing, room or entity name: not blank, at most 128 characters, no path parts, no NUL, ordinary characters."""
    t = strip(c)
    return F.coalesce((t != "") & (F.char_length(t) <= most) & ~t.rlike(r"\.\.|/|\\|\x00") & t.rlike(r"(?U)^[\w][\w .'-]*$"), F.lit(False))


#: Longest query that is taken as it is; bounds of one that is cut out.
SAFE_QUERY, LEAST_QUERY, MOST_QUERY = 200, 10, 250


def sanitize_query(raw: str | None) -> tuple[str, str]:
    """(query, method): the question hidden in a text that a caller put much before.

    Short queries pass; else the last line that ends as a question, the last
    sentence with a question mark, the last line of some length, or the end.
    """
    if not raw or not raw.strip():
        return raw or "", "passthrough"
    text = raw.strip()
    if len(text) <= SAFE_QUERY:
        return text, "passthrough"
    sentence = re.compile(r"[.!?。！？\n]+")
    segments = [s.strip() for s in text.split("\n") if s.strip()]
    asked = [s for s in reversed(segments) if re.search(r"[?？]\s*[\"']?\s*$", s)]
    if not asked:
        asked = [s for s in (p.strip() for p in reversed(sentence.split(text))) if s and ("?" in s or "？" in s)]
    if asked and len(asked[0]) >= LEAST_QUERY:
        return (_cut(asked[0], sentence) if len(asked[0]) > MOST_QUERY else asked[0]), "question_extraction"
    for s in reversed(segments):
        if len(s) >= LEAST_QUERY and len(cut := _cut(s, sentence)) >= LEAST_QUERY:
            return cut, "tail_sentence"
    return text[-MOST_QUERY:].strip(), "tail_truncation"


def _unquoted(s: str) -> str:
    s = s.strip()
    while len(s) >= 2 and s[0] in "'\"" and s[0] == s[-1]:
        s = s[1:-1].strip()
    if s[:1] in ("'", '"'):
        s = s[1:].strip()
    return s[:-1].strip() if s[-1:] in ("'", '"') else s


def _cut(s: str, sentence: re.Pattern) -> str:
    s = _unquoted(s)
    if len(s) <= MOST_QUERY:
        return s
    fitting = [p for p in map(_unquoted, filter(str.strip, sentence.split(s))) if LEAST_QUERY <= len(p) <= MOST_QUERY]
    return fitting[-1] if fitting else s[-MOST_QUERY:].strip()


def _same(c: Column) -> Column:
    return c


#: Named transformations that a source may declare; the last six are the source's own, and change nothing here.
TRANSFORMATIONS = {
    "utf8_replace_invalid": utf8_replace_invalid,
    "newline_normalize": newline_normalize,
    "whitespace_trim": strip,
    "whitespace_collapse_internal": whitespace_collapse,
    "line_trim": line_trim,
    "line_join_spaces": line_join_spaces,
    "blank_line_drop": blank_line_drop,
    "strip_tool_chrome": _same,
    "tool_result_truncate": _same,
    "tool_result_omitted": _same,
    "spellcheck_user": _same,
    "synthesized_marker": _same,
    "speaker_role_assignment": _same,
}


def transformed(c: Column, names: list[str]) -> Column:
    """The named transformations one after the other; unknown names raise."""
    for n in names:
        if n not in TRANSFORMATIONS:
            raise ValueError(f"no transformation {n!r}")
        c = TRANSFORMATIONS[n](c)
    return c
