"""Mixing sources to target weights with soft membership.

A classifier fitted on the labelled table gives each document a posterior over the domains `good`, `low` and
`toxic`. Every document gets a rate, its expected number of copies, such that the domains' expected token totals
(rate * tokens * posterior) match the targets: least squares over nonnegative rates, with a small pull to rate 1,
solved by projected gradient steps with momentum. A step needs the totals alone (one distributed aggregate, as many numbers as
there are domains); rates are not stored between steps but replayed from the few steps' vectors, row by row.

Targets are weights; the total is set so that the anchor domain keeps all its tokens and a headroom. Rates become
whole copies by a hash of the key: the integer part, and one more with the fraction's probability.

Edge cases. A null text has no tokens: it counts in no total, its posterior is that of an empty text and its rate
follows from it like any other. Null labels are not learned from; a document labelled more than once takes its
worst labels. With no labelled document, or labels of one domain only, posteriors are constant. Repeated rows are
mixed each. Extra columns of documents are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import PART_ROWS, arrow_map, discard, stage, tidy, with_columns_arrow

DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.90, "low": 0.09, "toxic": 0.01}
ANCHOR, HEADROOM = "good", 1.05
#: Most labelled documents of a domain that the classifier is fitted on, the bound of the sample.
SAMPLE_PER_DOMAIN = 1500
#: Words that the classifier looks at: those most associated with a domain in the sample.
CHOSEN = 1024
LEAST_DOCUMENTS = 8
NUMBERS = 7
PULL = 1e-3
STEP = 1.0
#: Steps after which a fit that has neither met its targets nor settled is an error.
MOST_STEPS = 150
#: Shares of all tokens: how near a domain must be to its target, and how little a step must still move rates.
MET, SETTLED = 1e-4, 1e-4
WORD = re.compile(r"\w+")
SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass
class Model:
    words: np.ndarray  # ascending 32-bit hashes of the chosen words
    weights: np.ndarray  # (words + NUMBERS, domains)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hashes of the distinct words, log counts, ratios of the text's form, tokens)."""
    text = text or ""
    words = WORD.findall(text.lower())
    tokens = len(text.split())
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    if words:
        h, counts = np.unique((pd.util.hash_array(np.array(words, dtype=object), categorize=False) >> np.uint64(32)).astype(np.int64), return_counts=True)
    else:
        h, counts = np.zeros(0, np.int64), np.zeros(0)
    symbols, upper = len(SYMBOL.findall(text)), sum(map(str.isupper, text))
    numbers = [1.0, min(symbols / n, 2.0), len(h) / n, upper / max(len(text), 1), sum(map(len, words)) / n / 10, (len(lines) - len(set(lines))) / max(len(lines), 1), np.log1p(n) / 10]
    return h, np.log1p(counts), np.array(numbers), tokens


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(domain, text) to (domain, words, values, numbers)."""
    for batch in batches:
        rows = [features(t)[:3] for t in batch.column(1).to_pylist()]
        kinds = (pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], pa.list_(kinds[i])) for i in range(3)]], names=["domain", "words", "values", "numbers"])


def place(words: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where in words, where in chosen) of the words that are chosen."""
    at = np.searchsorted(chosen, words)
    at[at == len(chosen)] = 0
    hit = np.flatnonzero(chosen[at] == words) if len(chosen) else np.zeros(0, np.int64)
    return hit, at[hit]


def choose(words: np.ndarray, domain: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CHOSEN words of the largest chi-square statistic with any domain; words and domain of each occurrence."""
    distinct, inverse = np.unique(words, return_inverse=True)
    seen = np.zeros((len(distinct), len(DOMAINS)))
    np.add.at(seen, (inverse, domain), 1)
    df, total = seen.sum(axis=1, keepdims=True), n.sum()
    a, b = seen, df - seen
    c, d = n - seen, total - n - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(total * (a * d - b * c) ** 2 / (df * (total - df) * n * (total - n))).max(axis=1)
    chi[df[:, 0] < LEAST_DOCUMENTS] = 0
    order = np.lexsort((distinct, -chi))[:CHOSEN]
    return np.sort(distinct[order[chi[order] > 0]])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: pa.Table, shares: dict[str, float], steps: int = 400, ridge: float = 1e-4) -> Model:
    """Multinomial logistic regression; rows are weighted so that the sample's domains have their labelled shares."""
    if not rows.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros((NUMBERS, len(DOMAINS)), np.float32))
    words, values, numbers = (rows[c].combine_chunks() for c in ("words", "values", "numbers"))
    domain = np.array([DOMAINS.index(d) for d in rows["domain"].to_pylist()])
    n = np.bincount(domain, minlength=len(DOMAINS))
    owner = np.repeat(np.arange(len(domain)), words.value_lengths().to_numpy())
    flat = words.flatten().to_numpy()
    chosen = choose(flat, domain[owner], n)
    hit, at = place(flat, chosen)
    x = np.zeros((len(domain), len(chosen) + NUMBERS), np.float32)
    x[owner[hit], at] = values.flatten().to_numpy()[hit]
    x[:, len(chosen) :] = numbers.flatten().to_numpy().reshape(-1, NUMBERS)
    weight = np.array([shares.get(DOMAINS[d], 0.0) / n[d] for d in domain], np.float32)
    weight /= weight.sum()
    y = np.eye(len(DOMAINS), dtype=np.float32)[domain]
    # the largest curvature of the weighted squares bounds the step
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        v /= (top := np.linalg.norm(v))
    w = np.zeros((x.shape[1], len(DOMAINS)), np.float32)
    rate, z, before, t = np.float32(1 / (0.5 * top + ridge)), w.copy(), w.copy(), 1.0
    for _ in range(steps):
        w = z - rate * (x.T @ (weight[:, None] * (softmax(x @ z) - y)) + np.float32(ridge) * z)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, before, t = w + np.float32((t - 1) / after) * (w - before), w, after
    return Model(chosen, w)


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "low")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_DOMAIN) -> Model:
    """docs (k, text), labels (k, quality, toxic)."""
    named = labels.where("k is not null and quality is not null and toxic is not null").groupBy("k").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).select("k", domain_of(F.col("q"), F.col("t")).alias("domain")).where("domain is not null")
    counts = {r.domain: r["count"] for r in named.groupBy("domain").count().collect()}
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.xxhash64("k"), "k"))).where(F.col("r") <= sample).select("k", "domain")
    # at most sample * domains keys; repeated rows of a key count once
    rows = docs.join(F.broadcast(ranked), "k").groupBy("k", "domain").agg(F.min("text").alias("text")).select("domain", "text")
    rows = arrow_map(rows, feature_rows, "domain string, words array<long>, values array<double>, numbers array<double>").toArrow()
    total = sum(counts.values()) or 1
    model = fit(rows, {d: c / total for d, c in counts.items()})
    del rows
    tidy()
    return model


def posteriors(model: Model) -> Callable[[str | None], tuple[int, np.ndarray]]:
    """A text's tokens and domain probabilities."""
    chosen, w = model.words, model.weights.astype(np.float64)

    def run(text: str | None) -> tuple[int, np.ndarray]:
        words, values, numbers, tokens = features(text)
        hit, at = place(words, chosen)
        return tokens, softmax(values[hit] @ w[at] + numbers @ w[len(chosen) :])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(k, text) to (k, tokens, p)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        posterior = posteriors(shared.value)
        for batch in batches:
            rows = [posterior(t) for at in range(0, batch.num_rows, PART_ROWS) for t in batch.column(1).slice(at, PART_ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["k", "tokens", "p"])

    return arrow_map(docs, run, f"k {docs.schema['k'].dataType.simpleString()}, tokens long, p array<double>")


def stepped(z: Column, v: Callable[[int], Column]) -> Column:
    """A projected gradient step from z: max(0, z - STEP * (p . v + PULL * (z - 1)))."""
    dot = sum((F.get("p", F.lit(k)) * v(k) for k in range(1, len(DOMAINS))), F.get("p", F.lit(0)) * v(0))
    return F.greatest(F.lit(0.0), z - F.lit(STEP) * (dot + F.lit(PULL) * (z - 1.0)))


def state_of(steps: list[list[float]]) -> Column:
    """(r, z) after the steps: a document's rate, and the point that momentum carries on to. A step is v and its momentum."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("z"))
    if not steps:
        return start

    def one(s: Column, v: Column) -> Column:
        r = stepped(s["z"], lambda k: F.get(v, F.lit(k)))
        return F.struct(r.alias("r"), (r + F.get(v, F.lit(len(DOMAINS))) * (r - s["r"])).alias("z"))

    return F.aggregate(F.array(*[F.array(*map(F.lit, v)) for v in steps]), start, one)


def rate_of(steps: list[list[float]]) -> Column:
    return state_of(steps)["r"]


def fit_rates(table: DataFrame, targets: dict[str, float], anchor: str, headroom: float) -> list[list[float]]:
    """The vectors of the projected gradient steps. Gradients are taken in the token measure, preconditioned by the
    domains' second moments, so that a handful of steps settles them."""
    n = len(DOMAINS)
    p = [F.get("p", F.lit(k)) for k in range(n)]
    weight = F.col("tokens").cast("double")
    moments = table.agg(F.sum(weight).alias("total"), *[F.sum(weight * p[i]).alias(f"m{i}") for i in range(n)], *[F.sum(weight * p[i] * p[j]).alias(f"g{i}{j}") for i in range(n) for j in range(n)]).first()
    if not moments.total:
        return []
    natural = np.array([moments[f"m{i}"] for i in range(n)]) / moments.total
    gram = np.array([[moments[f"g{i}{j}"] for j in range(n)] for i in range(n)]) / moments.total
    inverse = np.linalg.inv(gram + 1e-6 * np.eye(n))
    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    share = share / share.sum()
    a = DOMAINS.index(anchor)
    wanted = share * headroom * natural[a] / share[a]
    steps: list[list[float]] = []
    now = ahead = natural  # totals of the rates, and of the points ahead of them
    t = 1.0
    for _ in range(MOST_STEPS):
        if np.abs(now - wanted).max() < MET:
            return steps
        v = (inverse @ (ahead - wanted)).tolist()
        s, new = F.col("s"), F.col("new")
        rows = table.select("tokens", "p", state_of(steps).alias("s")).withColumn("new", stepped(s["z"], lambda k: F.lit(v[k])))  # noqa: B023
        sums = [F.sum(weight * p[i] * new).alias(f"m{i}") for i in range(n)]
        got = rows.agg(*sums, F.sum(weight * F.abs(new - s["z"])).alias("moved"), F.sum(weight * (new - s["r"]) * (s["z"] - new)).alias("back")).first()
        before, now = now, np.array([got[f"m{i}"] for i in range(n)]) / moments.total
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        # momentum starts anew where it points back
        momentum, t = (0.0, 1.0) if got.back > 0 else ((t - 1) / after, after)
        ahead = now + momentum * (now - before)
        steps.append([*v, momentum])
        # rates that no step moves any more are the least squares, met targets or not
        if got.moved / moments.total < SETTLED:
            return steps
    raise RuntimeError(f"rates not settled after {MOST_STEPS} steps: off by {np.abs(now - wanted).max():.2g} of the tokens")


@dataclass
class Fitted:
    """A fitted mix: the classifier, the gradient steps that give the rates, and the posteriors they were fitted on."""

    model: Model
    steps: list[list[float]]
    table: DataFrame


def fit_mix(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None, anchor: str = ANCHOR, headroom: float = HEADROOM) -> Fitted:
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    model = train(rows, labels.select(F.col(key).alias("k"), "quality", "toxic"))
    table = stage(scored(rows, model), "mixing-posteriors")
    return Fitted(model, fit_rates(table, targets or TARGETS, anchor, headroom), table)


def with_copies(df: DataFrame, key: str, steps: list[list[float]]) -> DataFrame:
    """Add rate and copies to rows that hold p and the key."""
    out = df.withColumn("rate", rate_of(steps))
    chance = F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key, n_tokens, p_good, p_low, p_toxic, rate, copies for every row of docs."""
    fitted = fit_mix(docs, labels, key, text, **how)
    out = with_copies(fitted.table, "k", fitted.steps)
    return out.select(F.col("k").alias(key), F.col("tokens").alias("n_tokens"), *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies")


def mixed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs, each as often as its copies. Posteriors are computed anew beside the row, so texts are not shuffled."""
    fitted = fit_mix(docs, labels, key, text, **how)
    discard(fitted.table)
    shared = docs.sparkSession.sparkContext.broadcast(fitted.model)
    # the row as one column, so that none of its names can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(text).alias("text"))

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        posterior = posteriors(shared.value)
        return lambda batch: {"p": pa.array([posterior(t)[1] for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))}

    out = with_copies(with_columns_arrow(rows, make, [T.StructField("p", T.ArrayType(T.DoubleType()))]), "k", fitted.steps)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")).select("row.*")


def op8_soft_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
