"""Text of message blocks. A block is struct<type, text, name, input: map<string, string>, content>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<type: string, text: string, name: string, input: map<string, string>, content: string>>"


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def block_text(blocks: Column) -> Column:
    """Text blocks as they are and tool calls in short; thinking and tool results are left out."""

    def one(b: Column) -> Column:
        name, given = F.coalesce(b["name"], F.lit("?")), b["input"]
        path = F.coalesce(given["file_path"], F.lit("?"))
        target = F.coalesce(_filled(given["file_path"]), _filled(given["pattern"]), given["path"], F.lit(""))
        call = (
            F.when(name.isin("Read", "Glob", "Grep"), F.concat(F.lit("["), name, F.lit(": "), target, F.lit("]")))
            .when(name.isin("Edit", "Write"), F.concat(F.lit("["), name, F.lit(": "), path, F.lit("]")))
            .when(name == "Bash", F.concat(F.lit("[Bash: "), F.substring(F.coalesce(given["command"], F.lit("")), 1, 100), F.lit("]")))
            .otherwise(F.concat(F.lit("["), name, F.lit("]")))
        )
        return F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "tool_use", call)

    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x.isNotNull()), "\n")


def transcript_text(blocks: Column) -> Column:
    """As block_text, but a call shows the first 100 characters of its input and a result its first 200."""

    def one(b: Column) -> Column:
        call = F.concat(F.lit("["), F.coalesce(b["name"], F.lit("?")), F.lit(": "), F.substring(F.to_json(b["input"]), 1, 100), F.lit("]"))
        result = F.concat(F.lit("[result: "), F.substring(b["content"], 1, 200), F.lit("]"))
        return F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "tool_use", call).when((b["type"] == "tool_result") & b["content"].isNotNull(), result)

    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x.isNotNull()), "\n")


def json_turns(text: Column) -> Column:
    """Turns of a model's answer: the whole as a JSON list, else the widest bracketed part; null if neither is one."""
    kind = "array<struct<role: string, content: string>>"
    turns = F.coalesce(F.from_json(text, kind), F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), kind))
    return F.when((F.size(turns) > 0) & F.forall(turns, lambda t: t["role"].isNotNull()), turns)


def unfenced(text: Column) -> Column:
    """The body of a fenced JSON block, or the text."""
    body = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(body != "", body).otherwise(text)


def project_of(path: Column) -> Column:
    """A session file's project by its folder: what follows `projects-`, dashes as slashes; home if nothing does."""
    folder = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    rest = F.regexp_extract(folder, r"^-home-[a-z]+-projects?-?(.*)$", 1)
    known = folder.rlike(r"^-home-[a-z]+-projects?")
    other = F.regexp_extract(folder, r"^-home-[a-z]+---?(.*)$", 1)
    named = F.when(other != "", F.replace(other, F.lit("-"), F.lit("/"))).otherwise("unknown")
    return F.when(known & (rest == ""), "home").when(known, F.replace(rest, F.lit("-"), F.lit("/"))).otherwise(named)
