"""Readers of chat exports: six formats to (role, text) turns and to marked transcripts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
_USER, _ASSISTANT = {"user", "human"}, {"assistant", "ai"}
#: Lines and matches of a tool's output that are kept, and characters of other outputs and inputs.
BASH_LINES, MATCHES, OUTPUT, INPUT = 20, 20, 2048, 200


def _rows(text: str) -> Iterator[dict]:
    """The objects of a JSON lines file; broken lines are skipped."""
    for line in text.splitlines():
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict):
            yield row


def tool_call(block: dict) -> str:
    """One line for a tool call."""
    name, given = block.get("name", "Unknown"), block.get("input") or {}
    short = lambda s: s if len(s) <= INPUT else s[:INPUT] + "..."
    if name == "Bash":
        return f"[Bash] {short(given.get('command', ''))}"
    if name == "Read":
        where = given.get("file_path", "?")
        first, count = given.get("offset"), given.get("limit")
        if first is None or count is None:
            return f"[Read {where}]"
        return f"[Read {where}:{first}-{int(first) + int(count)}]" if str(first).isdigit() and str(count).isdigit() else f"[Read {where}:{first}+{count}]"
    if name == "Grep":
        return f"[Grep] {given.get('pattern', '')} in {given.get('path') or given.get('glob') or ''}"
    if name == "Glob":
        return f"[Glob] {given.get('pattern', '')}"
    if name in ("Edit", "Write"):
        return f"[{name} {given.get('file_path', '?')}]"
    return f"[{name}] {short(json.dumps(given, separators=(',', ':')))}"


def tool_output(content: object, name: str) -> str:
    """A tool's output, each line after →: files read or written are left out, long outputs cut in their middle or at their end."""
    if isinstance(content, list):
        content = "\n".join(c if isinstance(c, str) else c.get("text", "") for c in content if isinstance(c, str) or (isinstance(c, dict) and c.get("type") == "text"))
    text = str(content or "").strip()
    if not text or name in ("Read", "Edit", "Write"):
        return ""
    lines = text.split("\n")
    if name == "Bash" and len(lines) > 2 * BASH_LINES:
        lines = [*lines[:BASH_LINES], f"... [{len(lines) - 2 * BASH_LINES} lines omitted] ...", *lines[-BASH_LINES:]]
    elif name in ("Grep", "Glob") and len(lines) > MATCHES:
        lines = [*lines[:MATCHES], f"... [{len(lines) - MATCHES} more matches]"]
    elif name not in ("Bash", "Grep", "Glob"):
        return "→ " + (text if len(text) <= OUTPUT else f"{text[:OUTPUT]}... [truncated, {len(text)} chars]")
    return "\n".join("→ " + line for line in lines)


def block_text(content: object, tools: dict[str, str] | None = None) -> str:
    """Text of a message's content: a string, a list of blocks, or one block."""
    if isinstance(content, str):
        return content.strip()
    if isinstance(content, dict):
        return str(content.get("text", "")).strip()
    parts = []
    for block in content if isinstance(content, list) else []:
        if isinstance(block, str):
            parts.append(block)
        elif isinstance(block, dict):
            match block.get("type"):
                case "text":
                    parts.append(block.get("text", ""))
                case "tool_use":
                    parts.append(tool_call(block))
                case "tool_result":
                    parts.append(tool_output(block.get("content"), (tools or {}).get(block.get("tool_use_id", ""), "Unknown")))
    return "\n".join(p for p in parts if p).strip()


def verbatim(content: object) -> str:
    """The same without cuts: every block's text in full."""
    if isinstance(content, str):
        return content
    out = []
    for block in content if isinstance(content, list) else []:
        if isinstance(block, dict):
            kind = block.get("type")
            body = block.get("text") if kind == "text" else json.dumps(block.get("input", {}), ensure_ascii=False) if kind == "tool_use" else block.get("content") if kind == "tool_result" else None
            if isinstance(body, list):
                body = verbatim(body)
            if body:
                out.append(f"[{block.get('name', 'tool')}] {body}" if kind == "tool_use" else str(body))
    return "\n".join(out)


def assistant_sessions(text: str) -> list[Turn] | None:
    """Rows {type, message: {content}}: tool outputs belong to the assistant, whose neighbouring turns are joined."""
    rows = [(str(r.get("type", "")), r["message"].get("content", "")) for r in _rows(text) if isinstance(r.get("message"), dict)]
    tools = {b["id"]: b.get("name", "Unknown") for kind, c in rows if kind == "assistant" and isinstance(c, list) for b in c if isinstance(b, dict) and b.get("type") == "tool_use" and b.get("id")}
    turns: list[Turn] = []
    for kind, content in rows:
        if kind not in ("human", "user", "assistant"):
            continue
        said = strip_noise(block_text(content, tools))
        only_tools = kind != "assistant" and isinstance(content, list) and all(isinstance(b, dict) and b.get("type") == "tool_result" for b in content)
        if not said:
            continue
        if kind == "assistant" or only_tools:
            if turns and turns[-1][0] == "assistant":
                turns[-1] = ("assistant", turns[-1][1] + "\n" + said)
            elif not only_tools:
                turns.append(("assistant", said))
        else:
            turns.append(("user", said))
    return turns if len(turns) >= 2 else None


def event_sessions(text: str) -> list[Turn] | None:
    """Rows {type: event_msg, payload: {type, message}} of a file with a session_meta row."""
    rows = list(_rows(text))
    if not any(r.get("type") == "session_meta" for r in rows):
        return None
    role = {"user_message": "user", "agent_message": "assistant"}
    said = [(role.get(p.get("type")), p.get("message")) for r in rows if r.get("type") == "event_msg" and isinstance(p := r.get("payload"), dict)]
    turns = [(k, m.strip()) for k, m in said if k and isinstance(m, str) and m.strip()]
    return turns if len(turns) >= 2 else None


def block_sessions(text: str) -> list[Turn] | None:
    """Rows {type: user | gemini, content: [{text}]} after a session_metadata row."""
    started, turns = False, []
    for r in _rows(text):
        if r.get("type") == "session_metadata":
            started = True
        elif started and r.get("type") in ("user", "gemini") and isinstance(r.get("content"), list):
            said = "\n".join(b["text"] for b in r["content"] if isinstance(b, dict) and isinstance(b.get("text"), str) and b["text"].strip())
            if said:
                turns.append(("user" if r["type"] == "user" else "assistant", said))
    return turns if len(turns) >= 2 else None


def _messages(items: object) -> list[Turn]:
    turns = []
    for m in items if isinstance(items, list) else []:
        if isinstance(m, dict):
            role = m.get("role") or m.get("sender") or ""
            said = block_text(m.get("content", "")) or str(m.get("text") or "").strip()
            if said and role in _USER | _ASSISTANT:
                turns.append(("user" if role in _USER else "assistant", said))
    return turns


def message_exports(data: object) -> list[list[Turn]] | None:
    """A list of messages, or of conversations with messages."""
    if isinstance(data, dict):
        data = data.get("messages", data.get("chat_messages", []))
    if not isinstance(data, list) or not data:
        return None
    if isinstance(data[0], dict) and ("messages" in data[0] or "chat_messages" in data[0]):
        found = [_messages(c.get("chat_messages") or c.get("messages")) for c in data if isinstance(c, dict)]
    else:
        found = [_messages(data)]
    found = [t for t in found if len(t) >= 2]
    return found or None


def mapping_exports(data: object) -> list[Turn] | None:
    """A tree {mapping: {id: {parent, children, message}}}, along first children from the root, one without a message if there is."""
    if not isinstance(data, dict) or not isinstance(data.get("mapping"), dict):
        return None
    nodes = data["mapping"]
    roots = [i for i, n in nodes.items() if n.get("parent") is None]
    here = next((i for i in roots if nodes[i].get("message") is None), roots[0] if roots else None)
    turns, seen = [], set()
    while here in nodes and here not in seen:
        seen.add(here)
        message = nodes[here].get("message") or {}
        role = (message.get("author") or {}).get("role")
        parts = (message.get("content") or {}).get("parts", []) if isinstance(message.get("content"), dict) else []
        said = " ".join(p for p in parts if isinstance(p, str) and p).strip()
        if said and role in ("user", "assistant"):
            turns.append((role, said))
        here = next(iter(nodes[here].get("children") or []), None)
    return turns if len(turns) >= 2 else None


def channel_exports(data: object) -> list[Turn] | None:
    """Messages of several people: speakers get alternating roles as they first speak, and stay named in brackets."""
    if not isinstance(data, list):
        return None
    roles: dict[str, str] = {}
    turns: list[Turn] = []
    for m in data:
        if not isinstance(m, dict) or m.get("type") != "message":
            continue
        who = re.sub(r"[\[\]\x00-\x1f]", "_", str(m.get("user", m.get("username", "")))).strip()
        said = str(m.get("text", "")).strip()
        if who and said:
            roles.setdefault(who, "assistant" if turns and turns[-1][0] == "user" else "user")
            turns.append((roles[who], f"[{who}] {said}"))
    return turns if len(turns) >= 2 else None


def transcript(turns: list[Turn]) -> str:
    """User turns after >, each followed by the answer, a blank line after every exchange."""
    out: list[str] = []
    for i, (role, said) in enumerate(turns):
        answered = role == "user" and i + 1 < len(turns) and turns[i + 1][0] == "assistant"
        out.append(f"> {said}" if role == "user" else said)
        if not answered:
            out.append("")
    return "\n".join(out)


_NOISE: list[re.Pattern] = []


def strip_noise(text: str) -> str:
    """As functions.text.strip_noise, for one text."""
    from loomspan.functions.text import HOOKS, NOISE_LINES, NOISE_TAGS

    if not _NOISE:
        _NOISE.extend(re.compile(rf"(?m)^(?:> )?<{t}(?:\s[^>]*)?>(?:(?!\n\s*\n)[\s\S])*?</{t}>[ \t]*\n?") for t in NOISE_TAGS)
        _NOISE.append(re.compile(rf"(?m)^(?:> )?(?:{'|'.join(map(re.escape, NOISE_LINES))}).*\n?"))
        _NOISE.append(re.compile(rf"(?m)^(?:> )?Ran \d+ (?:{'|'.join(HOOKS)}) hooks?.*\n?"))
        _NOISE.append(re.compile(r"(?m)^(?:> )?…\s*\+\d+ lines.*\n?"))
        _NOISE.append(re.compile(r"\s*\[\d+\s+tokens?\]\s*\(ctrl\+o to expand\)"))
    for p in _NOISE:
        text = p.sub("", text)
    return re.sub(r"\n{4,}", "\n\n\n", text).strip()


LINE_FORMATS: list[tuple[str, Callable[[str], list[Turn] | None]]] = [("assistant_sessions", assistant_sessions), ("event_sessions", event_sessions), ("block_sessions", block_sessions)]
TREE_FORMATS: list[tuple[str, Callable[[object], object]]] = [("message_exports", message_exports), ("mapping_exports", mapping_exports), ("channel_exports", channel_exports)]


def normalise(text: str, path: str = "") -> tuple[str, str]:
    """(format, transcript): chat exports as transcripts, anything else as it is.

    Texts with three > lines or more are transcripts already.
    """
    if not text or not text.strip():
        return "blank", text or ""
    if sum(line.strip().startswith(">") for line in text.split("\n")) >= 3:
        return "transcript", text
    if not (path.lower().endswith((".json", ".jsonl")) or text.strip()[0] in "{["):
        return "text", text
    for name, read in LINE_FORMATS:
        if turns := read(text):
            return name, transcript(turns)
    try:
        data = json.loads(text)
    except ValueError:
        return "text", text
    for name, read_tree in TREE_FORMATS:
        found = read_tree(data)
        if found:
            many = found if isinstance(found[0], list) else [found]
            return name, "\n\n".join(transcript(t) for t in many)
    return "text", text


def normalised(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, format, transcript) of each file; a file is one row, so nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [normalise(t or "", p or "") for p, t in zip(pdf[path], pdf[text])]
            yield pd.DataFrame({"path": pdf[path], "format": [f for f, _ in found], "transcript": [t for _, t in found]})

    return files.select(path, text).mapInPandas(run, "path string, format string, transcript string")


def exported_digests(messages: DataFrame, partitions: int) -> DataFrame:
    """(path, format, md5) of the export of each path's messages, as of `normalised`, whatever their number.

    `messages` (path, place, sender, text, item): item is the message as JSON.
    Rows are read in the order of their place, and only hashes are kept.
    """

    class Export:
        def __init__(self, path: str):
            self.path, self.turns, self.before, self.items = path, 0, "", 0
            self.said, self.raw = hashlib.md5(), hashlib.md5(b"[")

        def add(self, sender: str, text: str, item: str) -> None:
            self.raw.update((("," if self.items else "") + item).encode())
            self.items += 1
            for role, said in _messages([{"sender": sender, "text": text}]):
                if self.turns:
                    self.said.update(b"\n" if (self.before, role) == ("user", "assistant") else b"\n\n")
                self.said.update((f"> {said}" if role == "user" else said).encode())
                self.turns, self.before = self.turns + 1, role

        def row(self) -> tuple[str, str, str]:
            if self.turns >= 2:
                self.said.update(b"\n")
                return self.path, "message_exports", self.said.hexdigest()
            self.raw.update(b"]")
            return self.path, "text", self.raw.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here: Export | None = None
        for pdf in batches:
            out = []
            for path, sender, text, item in zip(pdf["path"], pdf["sender"], pdf["text"], pdf["item"]):
                if here is None or here.path != path:
                    out += [here.row()] if here else []
                    here = Export(path)
                here.add(sender, text, item)
            yield pd.DataFrame(out, columns=["path", "format", "md5"])
        if here:
            yield pd.DataFrame([here.row()], columns=["path", "format", "md5"])

    placed = messages.repartition(partitions, "path").sortWithinPartitions("path", "place")
    return placed.select("path", "sender", "text", "item").mapInPandas(run, "path string, format string, md5 string")


def session_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """(session_id, uuid, timestamp, role, content) of session rows as JSON text, batch or streaming.

    Left out are broken rows, other types than user and assistant, rows without
    a session, uuid or time, and blank contents.
    """
    row = "type string, uuid string, sessionId string, timestamp string, message struct<role:string, content:string>"
    j = lines.select(F.from_json(value, row, {"mode": "PERMISSIVE"}).alias("j"), value)
    blocks = F.from_json("j.message.content", "array<struct<type:string, text:string>>")
    said = F.coalesce(F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), "\n"), F.col("j.message.content"))
    role = F.coalesce("j.message.role", "j.type")
    out = j.select(F.col("j.sessionId").alias("session_id"), F.col("j.uuid").alias("uuid"), F.col("j.timestamp").alias("timestamp"), role.alias("role"), said.alias("content"), F.col("j.type").alias("type"))
    return out.filter("type in ('user', 'assistant') and session_id <> '' and uuid <> '' and timestamp <> ''").filter(F.coalesce(F.col("content").rlike(r"\S"), F.lit(False))).drop("type")


# ---- files that hold several sessions ---------------------------------------

SESSION_HEADER = "Claude Code v"
_STAMP = re.compile(r"⏺\s+(\d{1,2}:\d{2}\s+[AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})")
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_COMMAND = re.compile(r"^(\./|cd |ls |python|bash|git |cat |source |export |claude)")


def sessions(text: str, people: list[str] | None = None, least: int = 10) -> list[tuple[int, str, str]]:
    """(number, name, text) of the sessions in a file of two or more; fragments under `least` lines are dropped.

    A header starts a session unless one of the six lines from it on says that
    earlier messages are shown again. The name has time, people and subject.
    """
    lines = text.splitlines(keepends=True)
    again = lambda i: any("Ctrl+E" in x or "previous messages" in x for x in lines[i : i + 6])
    starts = [i for i, x in enumerate(lines) if SESSION_HEADER in x and not again(i)]
    if len(starts) < 2:
        return []
    out = []
    for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)]), 1):
        part = lines[a:b]
        if len(part) < least:
            continue
        stamp = next((m for x in part[:50] if (m := _STAMP.search(x))), None)
        when = f"part{n:02d}"
        if stamp:
            month = _MONTHS.index(stamp[2]) + 1 if stamp[2] in _MONTHS else 0
            when = f"{stamp[4]}-{month:02d}-{int(stamp[3]):02d}_{stamp[1].replace(':', '').replace(' ', '')}"
        head = "".join(part[:100])
        who = sorted(p for p in people or [] if re.search(rf"\b{re.escape(p)}\b", head, re.I))
        asked = next((s for x in part if x.startswith("> ") and len(s := x[2:].strip()) > 5 and not _COMMAND.match(s)), None)
        subject = re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", asked).strip())[:60] if asked else "session"
        out.append((n, f"{when}_{'-'.join(who[:3]) or 'unknown'}_{subject}", "".join(part)))
    return out


def split_sessions(files: DataFrame, path: str = "path", text: str = "text", people: list[str] | None = None) -> DataFrame:
    """(path, number, name, session) of each session of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *s) for p, t in zip(pdf[path], pdf[text]) for s in sessions(t or "", people)]
            yield pd.DataFrame(rows, columns=["path", "number", "name", "session"])

    return files.select(path, text).mapInPandas(run, "path string, number int, name string, session string")


def diary_entries(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, entry_index, header, body) of each `## ` entry."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"(?m)\n(?=## )", -1)
    entries = F.filter(parts, lambda p: p.startswith("## "))
    one = files.select(path, F.posexplode(entries).alias("entry_index", "entry"))
    return one.select(F.col(path).alias("path"), "entry_index", F.trim(F.regexp_extract("entry", r"^(## [^\n]*)", 1)).alias("header"), F.regexp_replace(F.regexp_replace("entry", r"^## [^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))
