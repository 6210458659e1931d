"""Splitting of files and transcripts into records, in Arrow batches.

Each cut depends on the one before it, so this is the one part of filing that
built-in functions can't express. Texts are split row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import is_noise

FENCE = "```"
# Boundaries in order of preference, with the characters that stay with the piece before.
BOUNDARIES = [("\n\n", 0), (". ", 1), ("! ", 1), ("? ", 1), (".\n", 1), ("!\n", 1), ("?\n", 1), ("\n", 0), (" ", 0)]
TARGET, CEILING, LEAST, LEAST_TURN = 800, 1200, 50, 30
LINE_GROUP, MANY_LINES = 25, 20


def smart_split(text: str, target: int = TARGET, ceiling: int = CEILING) -> list[str]:
    """Pieces of up to `ceiling` characters that end at the best kind of boundary beyond `target`.

    Fenced code is never cut: a piece that would end inside goes on to the
    closing fence, whatever its size. Pieces have no white space at their ends.
    """
    if target <= 0 or ceiling < target:
        raise ValueError(f"0 < target <= ceiling is needed, got {target} and {ceiling}")
    rest = text.strip()
    out: list[str] = []
    while len(rest) > ceiling:
        end = follow = -1
        if rest.count(FENCE, 0, ceiling) % 2 and (close := rest.find(FENCE, ceiling)) >= 0:
            end = follow = close + len(FENCE)
        else:
            for mark, kept in BOUNDARIES:
                at = rest.rfind(mark, target, ceiling)
                if at >= 0:
                    end, follow = at + kept, at + len(mark)
                    break
            else:
                end = follow = ceiling
        if piece := rest[:end].strip():
            out.append(piece)
        rest = rest[follow:]
    if rest.strip():
        out.append(rest.strip())
    return out


def exchanges(text: str) -> list[str]:
    """Each line that begins with > with the lines after it, up to the next such line or a rule (---)."""
    out: list[str] = []
    turn: str | None = None
    answer: list[str] = []

    def close() -> None:
        if turn is not None:
            reply = "\n".join(answer).strip()
            out.append(f"{turn}\n\n{reply}" if reply else turn)

    for line in text.split("\n"):
        s = line.strip()
        if s.startswith(">"):
            close()
            turn, answer = s, []
        elif s.startswith("---"):
            close()
            turn, answer = None, []
        elif turn is not None:
            answer.append(line)
    close()
    return out


def paragraphs(text: str, size: int = TARGET, least: int = LEAST_TURN) -> list[str]:
    """Paragraphs, or groups of 25 lines of a long single one, in slices of `size`; short ones are dropped."""
    parts = [p.strip() for p in text.split("\n\n") if p.strip()]
    rows = text.split("\n")
    if len(parts) <= 1 and len(rows) - 1 > MANY_LINES:
        parts = ["\n".join(rows[i : i + LINE_GROUP]).strip() for i in range(0, len(rows), LINE_GROUP)]
    return [p[i : i + size] for p in parts if len(p) > least for i in range(0, len(p), size)]


def split_column(df: DataFrame, keys: list[str], text: str, split: Callable[[str], list[str]], least: int = 0) -> DataFrame:
    """(keys, chunk_index, content): the pieces of each row's text, without noise and those shorter than `least`.

    Indexes are dense after dropping. Null and blank texts have no rows.
    """
    kinds = dict(df.dtypes)
    own = df.select(*keys, F.col(text).alias("_text")).filter(F.col("_text").rlike(r"\S"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, p) for k, t in zip(pdf[keys].itertuples(index=False, name=None), pdf["_text"]) if (p := [x for x in split(t) if len(x) >= least])]
            yield pd.DataFrame(rows, columns=[*keys, "pieces"])

    pieces = own.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pieces array<string>")
    kept = F.filter("pieces", lambda p: ~is_noise(p))
    return pieces.select(*keys, F.posexplode(kept).alias("chunk_index", "content"))


def chunk_files(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Project files: noise is left out, the rest split at boundaries."""
    return split_column(df.filter(~is_noise(F.col(text))), keys, text, smart_split, LEAST)


def _conversation(text: str) -> list[str]:
    if sum(line.strip().startswith(">") for line in text.split("\n")) >= 3:
        return [p for e in exchanges(text) for p in smart_split(e) if len(p) >= LEAST_TURN]
    return paragraphs(text)


def chunk_conversations(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Transcripts: by exchange where three lines or more begin with >, else by paragraph."""
    return split_column(df, keys, text, _conversation)
