"""Ranked retrieval: search axes, fusion, decay, rank, token budget.

An axis is a DataFrame (seq, score). Axes are limited to their top k by score and then seq, which plans as a
top-k per partition and a merge, and are fused by a union and one aggregate.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.functions import vector as V


@dataclass(frozen=True)
class Axis:
    axis: str = "semantic"
    weight: float = 0.5
    filter: str = ""


@dataclass(frozen=True)
class Decomposition:
    """A query's plan; the default is one semantic axis of weight 1."""

    query: str
    axes: tuple[Axis, ...] = (Axis("semantic", 1.0, ""),)
    keywords: tuple[str, ...] = ()
    identifiers: tuple[str, ...] = field(default_factory=tuple)

#: Ranges of seq whose tokens are summed apart for a running sum.
RANGES = 1000


def top(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("score"), "seq").limit(k)


def keyword(corpus: DataFrame, query: str, k: int = 30) -> DataFrame:
    """Share of the query's terms that the content holds as substrings."""
    terms = X.query_terms(query)
    if not terms:
        return corpus.where("false").select("seq", F.lit(0.0).alias("score"))
    low = corpus.select("seq", F.lower("content").alias("c"))
    hits = reduce(lambda a, b: a + b, [F.contains("c", F.lit(t)).cast("int") for t in terms])
    return top(low.select("seq", (hits / len(terms)).alias("score")).where("score > 0"), k)


def entity(corpus: DataFrame, name: str, k: int = 20) -> DataFrame:
    """The first k entries that mention a name; without a name none."""
    if not name:
        return corpus.where("false").select("seq", F.lit(0.8).alias("score"))
    return corpus.where(F.contains(F.lower("content"), F.lit(name.lower()))).orderBy("seq").limit(k).select("seq", F.lit(0.8).alias("score"))


def rank_scores(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """1 for the first of the k, 0.02 less for each next."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("score", 1.0 - 0.02 * (F.row_number().over(Window.orderBy(*order)) - 1))


def temporal(corpus: DataFrame, how: str = "newest", k: int = 20) -> DataFrame:
    """oldest, newest, after:D (from D on), before:D (earlier than D) or range:D1..D2; undated entries count as earliest."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    dated = corpus.withColumn("t", F.coalesce(ts, F.lit("")))
    kind, _, date = how.partition(":")
    if kind == "oldest":
        return rank_scores(dated, [F.col("t"), F.col("seq")], k).select("seq", "score")
    if kind in ("after", "before", "range"):
        low, high = (date, "") if kind == "after" else ("", date) if kind == "before" else date.split("..")
        rows = dated.where(F.col("t") >= low) if low else dated
        rows = rows.where(F.col("t") < high) if high else rows
        order = [F.desc("t"), F.col("seq")]
        return rows.orderBy(*order).limit(k).select("seq", F.lit(0.8).alias("score"))
    return rank_scores(dated, [F.desc("t"), F.col("seq")], k).select("seq", "score")


def semantic(vectors: DataFrame, query: list[float], k: int = 30) -> DataFrame:
    """Cosine with a query vector, rounded so that ties break by seq; a zero query finds nothing."""
    if not any(query):
        return vectors.where("false").select("seq", F.lit(0.0).alias("score"))
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(vectors.select("seq", F.round(V.cosine(V.as_doubles(F.col("embedding")), q), 6).alias("score")), k)


def project(corpus: DataFrame, name: str, vectors: DataFrame | None = None, query: list[float] | None = None, k: int = 20) -> DataFrame:
    """Entries of threads whose name holds a text: by cosine where there are vectors, else the latest at 0.5."""
    rows = corpus.where(F.contains(F.lower("thread"), F.lit(name.lower())))
    if vectors is not None and query is not None:
        known = vectors.where(V.norm(V.as_doubles(F.col("embedding"))) > 0).join(rows.select("seq"), "seq", "left_semi")
        return semantic(known, query, k)
    return rows.orderBy(F.desc_nulls_last("ts"), "seq").limit(k).select("seq", F.lit(0.5).alias("score"))


def identifiers(corpus: DataFrame, names: list[str], k: int = 30) -> DataFrame:
    """Best match of any identifier: exact 1.0, whatever the case 0.9, its stem of four characters or more 0.7."""
    rows = corpus.select("seq", "content", F.lower("content").alias("c"))
    scores = []
    for name in names:
        base = name.rsplit("/", 1)[-1]
        stem = base.rsplit(".", 1)[0] if "." in base[1:] else base
        score = F.when(F.contains("content", F.lit(name)), 1.0).when(F.contains("c", F.lit(name.lower())), 0.9)
        if len(stem) >= 4:
            score = score.when(F.contains("c", F.lit(stem.lower())), 0.7)
        scores.append(score.otherwise(0.0))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return top(rows.select("seq", best.alias("score")).where("score > 0"), k)


def fuse(axes: list[tuple[DataFrame, float]], keywords: DataFrame | None = None, idents: DataFrame | None = None) -> DataFrame:
    """Weighted sums of scores; keywords count 0.4 where an axis found the entry too, else 0.3; identifiers 0.6."""
    parts = [df.select("seq", (F.col("score") * w).alias("s"), F.lit(0.0).alias("kw"), F.lit(1).alias("axis")) for df, w in axes]
    if keywords is not None:
        parts.append(keywords.select("seq", F.lit(0.0).alias("s"), F.col("score").alias("kw"), F.lit(0).alias("axis")))
    if idents is not None:
        parts.append(idents.select("seq", (F.col("score") * 0.6).alias("s"), F.lit(0.0).alias("kw"), F.lit(0).alias("axis")))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("seq").agg((F.sum("s") + F.sum("kw") * F.when(F.max("axis") == 1, 0.4).otherwise(0.3)).alias("score"))


def decayed(found: DataFrame, corpus: DataFrame, as_of: Column) -> DataFrame:
    """Scores times the decay factor of their entries. found is a fused top-k, so its side is the small one."""
    rows = corpus.join(found, "seq")
    return rows.withColumn("score", F.col("score") * X.decay_factor(F.col("role"), F.col("content"), F.col("ts"), as_of))


def filtered(found: DataFrame, role: str | None = None, project: str | None = None) -> DataFrame:
    """Role equality and thread substring, whatever the case; applied after the axes' own top k."""
    if role:
        found = found.where(F.lower("role") == role.lower())
    if project:
        found = found.where(F.contains(F.lower("thread"), F.lit(project.lower())))
    return found


def budget(ranked: DataFrame, most: int) -> DataFrame:
    """The longest prefix by rank whose chunks, as they are shown, stay within the budget in tokens.

    ranked is a top-k: one partition suffices.
    """
    order = Window.orderBy(F.desc("score"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = rendered(ranked).withColumn("tokens", X.tokens(F.col("chunk")))
    return counted.withColumn("running", F.sum("tokens").over(order)).where(F.col("running") <= most)


def rendered(df: DataFrame) -> DataFrame:
    """Chunks as text: a label in brackets and the content; code under a heading shows its kind and heading."""
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(""))
    label = F.concat(F.lit("["), F.col("seq").cast("string"), F.lit(" "), F.coalesce("thread", F.lit("?")))
    chunk = F.concat(label, F.lit(" "), day, F.lit(" "), F.coalesce("role", F.lit("?")), F.lit("] "), F.coalesce("content", F.lit("")))
    if {"heading", "chunk_type"} <= set(df.columns):
        code = F.concat(label, F.lit(" "), F.coalesce("chunk_type", F.lit("")), F.lit("] "), F.col("heading"), F.lit("\n"), F.coalesce("content", F.lit("")))
        chunk = F.when((F.col("role") == "code") & (F.coalesce("heading", F.lit("")) != ""), code).otherwise(chunk)
    return df.withColumn("chunk", chunk)


def static_budget(sources: DataFrame, most: int) -> DataFrame:
    """Sources (seq, path, content) as chunks under their paths, whole and in order while they fit; the first that does
    not is cut to the rest if more than 100 tokens remain."""
    body = F.coalesce("content", F.lit(""))
    t = sources.withColumn("chunk", F.concat(F.lit("--- "), F.col("path"), F.lit(" ---\n"), body, F.lit("\n")))
    t = t.withColumn("tokens", X.tokens(F.col("chunk")))
    ends = t.agg(F.min("seq").cast("double").alias("low"), F.max("seq").cast("double").alias("high"))
    share = F.floor((F.col("seq").cast("double") - F.col("low")) * RANGES / (F.col("high") - F.col("low") + 1))
    t = t.crossJoin(F.broadcast(ends)).withColumn("range", F.coalesce(share, F.lit(-1))).drop("low", "high")
    # sums of ranges meet in one window, rows only in that of their range; ranges behind the budget are not read on
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("range").agg(F.sum("tokens").alias("n")).select("range", F.sum("n").over(before).alias("offset"))
    reached = t.join(F.broadcast(sums.where(F.col("offset").isNull() | (F.col("offset") <= most))), "range")
    own = F.sum("tokens").over(Window.partitionBy("range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    t = reached.withColumn("running", own).withColumn("running", F.coalesce(F.col("running") + F.col("offset"), "running", "offset")).withColumn("rest", F.lit(most) - (F.col("running") - F.col("tokens")))
    # only the first source that does not fit begins within the budget
    kept = t.where((F.col("running") <= most) | (F.col("rest") > 100)).drop("range", "offset")
    cut = F.concat(F.lit("--- "), F.col("path"), F.lit(" (truncated) ---\n"), F.expr("substring(coalesce(content, ''), 1, cast(rest * 4 as int))"), F.lit("\n"))
    return kept.withColumn("chunk", F.when(F.col("running") <= most, F.col("chunk")).otherwise(cut))


def cull_indices(answer: str, n: int) -> list[int]:
    """Numbers of the chunks that a model's answer keeps: its first bracketed list, in its order, within range."""
    found = re.search(r"\[[\d,\s]+\]", answer)
    try:
        return [i for i in json.loads(found[0]) if 0 <= i < n] if found else []
    except ValueError:
        return []


def polarity_axis(corpus: DataFrame, which: str, k: int = 20) -> DataFrame:
    """The latest entries whose first 500 characters speak of failure or of success only, at 0.8: an axis of our own."""
    text = F.lower(F.substring("content", 1, 500))
    bad, good = X.any_of(text, X.BLOCK_FAILURE_WORDS), X.any_of(text, X.BLOCK_SUCCESS_WORDS)
    rows = corpus.where(bad & ~good if which == "failure" else good & ~bad)
    return rows.orderBy(F.desc_nulls_last("ts"), "seq").limit(k).select("seq", F.lit(0.8).alias("score"))
