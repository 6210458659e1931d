"""Files as rows: listing with ignore rules, decoding, and a readable data source."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of project files, conversations and documents, folders left out, and the greatest size.
PROJECT = [".txt", ".md", ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".html", ".css", ".java", ".go", ".rs", ".rb", ".sh", ".csv", ".sql", ".toml"]
CONVERSATIONS = [".txt", ".md", ".json", ".jsonl"]
DOCUMENTS = [".pdf", ".docx", ".pptx", ".xlsx", ".rtf", ".epub"]
SKIPPED = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage", ".cache", ".tox", ".mypy_cache", ".pytest_cache", "target"]
MOST_BYTES = 500 * 1024 * 1024


def scan(spark: SparkSession, folder: str, extensions: list[str], skipped: list[str] | None = None, rules: list[str] | None = None, most: int = MOST_BYTES, include: list[str] | None = None) -> DataFrame:
    """(path, relative, length, modified, content) of files with one of the extensions.

    Left out: files in skipped folders, of more than `most` bytes, ignored by
    `rules` (lines of an ignore file at the folder), `.meta.json` files, and
    files without a byte, which the file source itself skips. include: relative
    paths of files, or of folders with all under them, that no rule and no
    skipped folder leaves out.
    """
    glob = "*{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*{extensions[0]}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    root = re.sub(r"^file:/*", "/", folder).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(root) + "/", "")
    own = files.select("path", relative.alias("relative"), "length", F.col("modificationTime").alias("modified"), "content").filter(F.col("length") <= most)
    folders = F.split("relative", "/")
    left_out = F.exists(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0))), lambda f: f.isin(skipped if skipped is not None else SKIPPED))
    forced = F.lit(False)
    for p in include or []:
        forced = forced | (F.col("relative") == p.strip("/")) | F.col("relative").startswith(p.strip("/") + "/")
    own = own.filter(~F.col("relative").endswith(".meta.json")).filter(forced | ~left_out)
    return own.filter(forced | ~ignored(F.col("relative"), rules)) if rules else own


def rule_patterns(lines: list[str]) -> list[tuple[bool, bool, re.Pattern]]:
    """(negated, for folders only, pattern) of each rule, in order."""
    out = []
    for raw in lines:
        line = raw.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated or line.startswith("\\") else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        parts = []
        for piece in line.strip("/").split("/"):
            parts.append("**" if piece == "**" else fnmatch.translate(piece).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*"))
        body = "/".join(parts).replace("**/", "(?:.*/)?").replace("/**", "/.*").replace("**", ".*")
        out.append((negated, folder, re.compile(("" if anchored else "(?:.*/)?") + body)))
    return out


def is_ignored(path: str, rules: list[tuple[bool, bool, re.Pattern]]) -> bool:
    """The last rule that fits a path or one of its folders decides; a file in an ignored folder stays ignored."""
    steps = path.split("/")
    for depth in range(1, len(steps) + 1):
        part, is_folder = "/".join(steps[:depth]), depth < len(steps)
        state = False
        for negated, folder, pattern in rules:
            if (is_folder or not folder) and pattern.fullmatch(part):
                state = not negated
        if state:
            return True
    return False


def ignored(path, rules: list[str]):
    """Boolean column: is a relative path ignored by the rules, a list of fixed size?"""
    patterns = rule_patterns(rules)

    @F.pandas_udf("boolean")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: x is not None and is_ignored(x, patterns))

    return run(path)


def decode(content: bytes | None) -> str | None:
    """UTF-8, else the Western code page, else UTF-8 with replacements."""
    if content is None:
        return None
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def extract(path: str, content: bytes | None, most: int = MOST_BYTES) -> tuple[str, str]:
    """(text, status) of a document; needs of a format that isn't installed give a status, never an error."""
    if content is None:
        return "", "unreadable"
    if len(content) > most:
        return "", "too_large"
    if not content:
        return "", "empty"
    kind = path.lower().rpartition(".")[2]
    if kind in ("docx", "pptx", "xlsx", "epub"):
        import io
        import zipfile

        inner = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", "epub": r".*\.x?html?"}[kind]
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = sorted((n for n in z.namelist() if re.fullmatch(inner, n)), key=lambda n: (len(n), n))
                raw = "\n\n".join(z.read(n).decode("utf-8", "replace") for n in names)
        except (zipfile.BadZipFile, KeyError, RuntimeError):
            return "", "corrupt"
        text = re.sub(r"</(?:w:p|a:p|p|h\d|li|div|si|row)>", "\n", raw)
        import html

        text = html.unescape(re.sub(r"<[^>]+>", "", text))
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in text.split("\n"))).strip()
        return (text, "ok") if text else ("", "no_text")
    if kind == "rtf":
        text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), decode(content) or "")
        text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
        text = re.sub(r"\\par[d]?\b ?", "\n", text)
        text = re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text).strip()
        return (text, "ok") if text else ("", "no_text")
    if kind == "pdf":
        try:
            import pypdf
            import pypdf.errors
        except ImportError:
            return "", "missing_dependency"
        import io

        try:
            text = "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages).strip()
        except (pypdf.errors.PyPdfError, ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, OSError):  # what its parser raises on broken files
            return "", "corrupt"
        return (text, "ok") if text else ("", "no_text")
    text = decode(content) or ""
    return (text, "ok") if text.strip() else ("", "no_text")


def texts(files: DataFrame) -> DataFrame:
    """(path, text, status) of scanned files, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [extract(p, c) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in found], "status": [s for _, s in found]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, status string")
