"""Chunkers: documents and source files to sections. Markdown is native; source files are scanned in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, FILE_HEAD, JS_LINES, BRACE_SPAN = 3000, 2000, 50, 5000
#: Chunks of that many characters or fewer, without the space around them, are left out.
TRIVIAL = 20
#: Words before a parenthesis that are no methods.
NOT_METHODS = ("if", "for", "while", "switch", "catch", "new", "return", "throw")
CHUNK_SCHEMA = "seq long, pos int, chunk_type string, heading string, content string"


def markdown_sections(df: DataFrame) -> DataFrame:
    """(seq, section, heading, content): a section starts at each line with #; text before the first is `preamble`.

    A row's text is cut where a newline stands before a #, so the work is linear in it and needs no shuffle.
    """
    cut = df.select("seq", F.posexplode(F.split("content", r"\n(?=#)")).alias("section", "text"))
    head = F.regexp_extract("text", r"^(#[^\n]*)", 1)
    heading = F.when(F.startswith("text", F.lit("#")), F.trim(F.regexp_replace(head, "^#+", ""))).otherwise("preamble")
    return cut.select("seq", "section", heading.alias("heading"), F.btrim("text", F.lit(" \n\t\r")).alias("content")).where("content <> ''")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Numbers of file chunks and of definitions (functions and classes only, as the ingest report counts them)."""
    return chunks.agg(F.count_if(F.col("chunk_type") == "file").alias("files"), F.count_if(F.col("chunk_type").isin("function", "class")).alias("definitions"))


def named(path: str, name: str) -> str:
    return f"{path}:{name}"


def python_chunks(text: str, path: str) -> list[tuple[str, str, str]]:
    """The file's head, then definitions; one opens a chunk only at or left of the open one's indent."""
    out, lines, open_at, indent, name, kind = [("file", path, text[:FILE_HEAD])], text.split("\n"), None, 0, "", ""

    def close(end: int) -> None:
        body = "\n".join(lines[open_at:end])
        if len(body.strip()) > TRIVIAL:
            out.append((kind, named(path, name), body))

    for i, line in enumerate(lines):
        m = re.match(r"(\s*)(?:(class) |(?:async )?def )([^(:]*)(?::|\(|$)?", line)
        if m and (open_at is None or len(m[1]) <= indent):
            if open_at is not None:
                close(i)
            open_at, indent, kind = i, len(m[1]), "class" if m[2] else "function"
            name = f"{m[2] or 'def'} {m[3]}"
    if open_at is not None:
        close(len(lines))
    return out


# fixed values: what starts a definition
JS_START = re.compile(r"^(?:export\s+)?(?:async\s+)?(?:function\s+(?P<func>\w+)|class\s+(?P<type>\w+)|const\s+(?P<arrow>\w+)\s*=\s*(?:async\s+)?\()", re.M)


def js_chunks(text: str, path: str) -> list[tuple[str, str, str]]:
    """From each definition at a line's start as many whole lines as JS_LINES; they may overlap."""
    out = [("file", path, text[:FILE_HEAD])]
    for m in JS_START.finditer(text):
        end = m.start()
        for _ in range(JS_LINES):
            if (newline := text.find("\n", end)) < 0:
                break
            end = newline + 1
        body = text[m.start() : end]
        if len(body.strip()) > TRIVIAL:
            out.append(("class" if m["type"] else "function", named(path, m["func"] or m["type"] or m["arrow"]), body))
    return out


def braced(text: str, start: int) -> str:
    """From start to the brace that closes the first one; to the end of the file where none does in reach."""
    depth, seen = 0, False
    for i in range(start, min(len(text), start + BRACE_SPAN)):
        depth += (text[i] == "{") - (text[i] == "}")
        seen |= text[i] == "{"
        if seen and depth == 0:
            return text[start : i + 1]
    return text[start:]


def brace_chunks(text: str, path: str, start: re.Pattern, kinds: tuple[str, str], shortest: int = 1) -> list[tuple[str, str, str]]:
    """The file's head, then each type or function with its braces."""
    out = [("file", path, text[:FILE_HEAD])]
    for m in start.finditer(text):
        name, kind = (m["type"], kinds[0]) if m["type"] else (m["func"], kinds[1])
        if len(name) >= shortest and name not in NOT_METHODS and len((body := braced(text, m.start())).strip()) > TRIVIAL:
            out.append((kind, named(path, name), body))
    return out


# fixed values: what starts a type, method or function
JAVA_START = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*(?:(?:class|interface|enum|record)\s+(?P<type>\w+)|[\w<>\[\],\s]+?\s+(?P<func>\w+)\s*\()", re.M)
GO_START = re.compile(r"^(?:func\s+(?:\([^)]+\)\s+)?(?P<func>\w+)\s*\(|type\s+(?P<type>\w+)\s+(?:struct|interface)\b)", re.M)


def java_chunks(text: str, path: str) -> list[tuple[str, str, str]]:
    return brace_chunks(text, path, JAVA_START, ("class", "method"), shortest=2)


def go_chunks(text: str, path: str) -> list[tuple[str, str, str]]:
    return brace_chunks(text, path, GO_START, ("type", "function"))


def json_chunks(text: str, path: str) -> list[tuple[str, str, str]]:
    if len(text) <= MOST:
        return [("file", path, text)]
    try:
        data = json.loads(text)
    except ValueError:
        return [("file", path, text[:MOST])]
    if isinstance(data, dict):
        head = "Keys: " + ", ".join(list(data)[:50]) + (f"\n{text[:MOST]}" if len(data) <= 3 else "")
        return [("file", path, head), *(("key", named(path, k), json.dumps(v, indent=2)[:MOST]) for k, v in data.items())]
    if isinstance(data, list):
        return [("file", path, f"Array of {len(data)} items\n" + json.dumps(data[:3], indent=2)[:MOST])]
    return [("file", path, text[:MOST])]


def generic_chunks(text: str, path: str) -> list[tuple[str, str, str]]:
    return [("file", path, text[:MOST])]


CHUNKERS = {".py": python_chunks, ".js": js_chunks, ".ts": js_chunks, ".jsx": js_chunks, ".tsx": js_chunks, ".java": java_chunks, ".go": go_chunks, ".json": json_chunks}


def source_chunks(df: DataFrame) -> DataFrame:
    """(seq, path, content) to the chunks of each file, by its lower-cased suffix."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for seq, path, text in zip(part["seq"], part["path"], part["content"], strict=True):
                suffix = re.search(r"(\.\w+)?$", path.lower())[0]
                chunks = CHUNKERS.get(suffix, generic_chunks)(text or "", path)
                rows += [(seq, i, *c) for i, c in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=["seq", "pos", "chunk_type", "heading", "content"])

    return df.select("seq", "path", "content").mapInPandas(run, CHUNK_SCHEMA)
