"""Identifiers: extraction from text, the distinct index, and resolution of approximate names against it."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what counts as an identifier
FILE_PATH = r"(?U)(?:~/|/home/|/tmp/|\./)[\w./-]+\.\w{1,5}"
RELATIVE_PATH = r"(?U)(?<![a-zA-Z])[a-zA-Z][\w-]*(?:/[\w.-]+)+\.\w{1,5}"
BARE_FILE = r"(?U)\b[\w-]+\.(?:py|js|ts|md|json|yaml|yml|sh|html|css|toml|cfg)\b"
FUNCTION = r"(?U)(?:def |self\.|\.)\b([a-z_]\w{2,})\b"
CLASS = r"(?U)class\s+([A-Z]\w{2,})"
SNAKE = r"(?<![a-zA-Z])([a-z_][a-z0-9]*(?:_[a-z0-9]+){1,})(?![a-zA-Z])"


def noise(s: Column) -> Column:
    base = F.regexp_extract(s, r"([^/]*)$", 1)
    return (
        s.rlike(r"[0-9a-f]{8}-[0-9a-f]{4}") | s.rlike(r"\d{4}-\d{2}-\d{2}T\d{2}") | base.rlike(r"^[0-9a-f]{10,}\.") | F.startswith(s, F.lit("./.."))
        | F.contains(s, F.lit("/tmp/")) | F.contains(s, F.lit("/screenshots/")) | (F.length(s) > 120)
    )


def extracted(df: DataFrame) -> DataFrame:
    """(seq, identifier), distinct within an entry; the six patterns run natively on each row."""
    find = lambda p, g: F.regexp_extract_all("content", F.lit(p), F.lit(g))
    paths = F.filter(F.concat(find(FILE_PATH, 0), find(RELATIVE_PATH, 0), F.transform(find(BARE_FILE, 0), lambda x: F.regexp_replace(x, "^[^a-zA-Z_]+", ""))), lambda x: (x != "") & ~noise(x))
    names = F.concat(find(FUNCTION, 1), find(CLASS, 1), F.filter(find(SNAKE, 1), lambda x: F.length(x) >= 6))
    clean = F.transform(F.concat(paths, names), lambda x: F.regexp_replace(x, r"^[^a-zA-Z_~/.]+", ""))
    return df.select("seq", F.explode(F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 3))).alias("identifier"))


def added_names(resolved: DataFrame) -> DataFrame:
    """Names that resolution gave beside those asked for."""
    return resolved.select("known").distinct().join(resolved.select(F.col("raw").alias("known")).distinct(), "known", "left_anti")


def index(df: DataFrame) -> DataFrame:
    return extracted(df).select("identifier").distinct()


def token_set(s: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(s, r"[_./\-]"), lambda t: t != "")))


def resolved_native(raw: DataFrame, known: DataFrame) -> DataFrame:
    """(raw, known, score) of the tiers that need no edit script: exact, equal token sets, containment either way.

    raw holds a query's few names, so the pairs are those few against the index, once.
    """
    r, k = F.lower("raw"), F.lower("known")
    inner, outer = F.length(r) / F.length(k), F.length(k) / F.length(r)
    score = (
        F.when(r == k, 1.0)
        .when((F.size(token_set(r)) > 0) & (token_set(r) == token_set(k)), 0.95)
        .when(F.contains(k, r) & (inner >= 0.6), 0.5 + inner * 0.4)
        .when(F.contains(r, k) & (outer >= 0.6), 0.4 + outer * 0.3)
    )
    return known.join(F.broadcast(raw), on=F.lit(True)).select("raw", "known", F.round(score, 6).alias("score")).where("score >= 0.55")


def resolved(raw: list[str], known: DataFrame) -> DataFrame:
    """(raw, known, score): up to three best matches of each name; a name the index knows stays as it is."""

    def score(name: str, other: str) -> float:
        a, b = name.lower().strip(), other.lower()
        if a == b:
            return 2.0
        ta, tb = ({x for x in re.split(r"[_./\-]", s) if x} for s in (a, b))
        if ta and ta == tb:
            return 0.95
        if a in b and len(a) / len(b) >= 0.6:
            return 0.5 + len(a) / len(b) * 0.4
        if b in a and len(b) / len(a) >= 0.6:
            return 0.4 + len(b) / len(a) * 0.3
        ratio = min(len(a), len(b)) / max(len(a), len(b))
        if ratio < 0.5 or (same := difflib.SequenceMatcher(None, a, b).ratio()) < 0.7:
            return 0.0
        return same * ratio

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r, k, s) for k in part["known"] for r in raw if r.strip() and (s := score(r, k)) >= 0.55]
            yield pd.DataFrame(rows, columns=["raw", "known", "score"])

    found = known.select("known").mapInPandas(run, "raw string, known string, score double")
    order = Window.partitionBy("raw").orderBy(F.desc("score"), "known")
    top = found.withColumns({"r": F.row_number().over(order), "exact": F.max(F.col("score") == 2.0).over(Window.partitionBy("raw"))}).where("r <= 3 and (not exact or r = 1)")
    return top.select("raw", F.when(F.col("exact"), F.col("raw")).otherwise(F.col("known")).alias("known"), F.round(F.least("score", F.lit(1.0)), 6).alias("score"))
