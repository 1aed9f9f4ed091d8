"""Language identification with a blended-spectrum string kernel, Nyström landmarks and one-versus-rest ridge regression.

k(x, y) is the number of distinct character n-grams (lengths 1 to 3) that x and y share, divided by the root of
the product of their own numbers. Landmark texts are drawn from a bounded labelled sample; the Nyström features of
a text are its kernel values with the landmarks times the inverse root of the landmark kernel; one ridge regression
is fitted for each language. Scoring is a product of matrices: presence rows (sparse) times the landmarks' presence
matrix, already multiplied by the inverse root and the regression weights.

An n-gram is a number made of its code points, so letters of every script keep apart. Texts whose letters are among
the sample's most frequent have their n-grams found in a table of presence, others by sorting; both give the same.
All labels are learned; the sample shrinks per label where there are many. What reaches the driver are the sample's
distinct n-grams, not its texts.

Edge cases. A null text, or one with no letter, is `und` with score 0. A null label is not learned from. With no
labelled row at all every text is `und`. Ties go to the smaller language name. Repeated rows are scored each; extra
columns stay, and give way where they have the name of a result column, whatever its case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import arrow_map, tidy, with_columns_arrow

UNKNOWN = "und"
#: Most labelled texts a language, and in all, that the classifier is fitted on: the bound of the sample.
SAMPLE_PER_LANGUAGE = 300
SAMPLE = 4000
#: Landmarks; two a language where there are more languages than half of it.
LANDMARKS = 256
RIDGE = 1e-3
GRAMS = 3
#: Letters with a place in the table of presence (the most frequent of the sample); others take the slower way.
LETTERS = 63
SIZE = sum(64**k for k in range(1, GRAMS + 1))
#: A gap between words is 1, a letter its code point and 2; 21 bits each.
GAP, BITS = 1, 21


@dataclass
class Model:
    """vocabulary: ascending numbers of the landmarks' n-grams; weights: a row for each, one of zeros, the constants."""

    languages: list[str]
    letters: np.ndarray
    vocabulary: np.ndarray
    weights: np.ndarray


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Grams:
    """Distinct n-grams of a text as ascending numbers."""

    def __init__(self) -> None:
        # -1: not met yet; such code points are looked up once, and become a letter or a gap
        self.table = np.full(0x110000, -1, np.int32)

    def codes(self, text: str) -> np.ndarray:
        points = code_points(text)
        codes = self.table[points]
        if (new := codes < 0).any():
            for p in np.unique(points[new]).tolist():
                self.table[p] = p + 2 if chr(p).isalpha() else GAP
            codes = self.table[points]
        # one gap between words, one at each end
        codes = np.concatenate(([GAP], codes, [GAP]))
        return codes[np.concatenate(([True], (codes[1:] != GAP) | (codes[:-1] != GAP)))].astype(np.int64)

    @staticmethod
    def numbers(codes: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
        """The n-grams of each length, in the order of the text."""
        out, value = [], codes
        for k in range(1, GRAMS + 1):
            if len(codes) < k:
                break
            value = codes if k == 1 else (value[:-1] << bits) | codes[k - 1 :]
            out.append(value)
        return out

    def present(self, text: str) -> np.ndarray:
        return np.unique(np.concatenate(self.numbers(self.codes(text))))


def letters_of(rows: list[np.ndarray]) -> np.ndarray:
    """The letters that most rows of n-grams have, as codes, ascending."""
    single = np.concatenate([r[(r < 1 << BITS) & (r != GAP)] for r in rows])
    codes, n = np.unique(single, return_counts=True)
    return np.sort(codes[np.lexsort((codes, -n))[:LETTERS]])


def fit(rows: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Distinct n-grams of each sample text and its language, in any order."""
    if not rows:
        return Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.float32))
    order = sorted(range(len(rows)), key=lambda i: (labels[i], len(rows[i]), rows[i].tobytes()))
    rows, labels = [rows[i] for i in order], [labels[i] for i in order]
    languages = sorted(set(labels))
    norms = np.sqrt([len(r) for r in rows])
    # landmarks are dealt to the languages in turn, from all lengths of text
    rng = np.random.default_rng(11)
    by = {lang: rng.permutation([i for i, own in enumerate(labels) if own == lang]).tolist() for lang in languages}
    turn = [i for r in range(max(map(len, by.values()))) for lang in languages for i in by[lang][r : r + 1]][: max(landmarks, 2 * len(languages))]
    # only n-grams that a landmark has can be shared with one; others fall on a row that stays empty
    vocabulary = np.unique(np.concatenate([rows[i] for i in turn]))
    marks = np.zeros((len(vocabulary) + 1, len(turn)), np.float32)
    for k, i in enumerate(turn):
        marks[np.searchsorted(vocabulary, rows[i]), k] = 1 / norms[i]
    kernel = np.stack([marks[placed(vocabulary, r)].sum(axis=0, dtype=np.float64) / n for r, n in zip(rows, norms, strict=True)])
    values, vectors = np.linalg.eigh(kernel[turn])
    good = values > values.max() * 1e-8
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.hstack([kernel @ root, np.ones((len(rows), 1))])
    targets = np.array([[1.0 if lang == own else -1.0 for own in languages] for lang in labels])
    # each language weighs the same
    weight = np.array([1 / len(by[lang]) for lang in labels])[:, None]
    beta = np.linalg.solve(features.T @ (weight * features) + ridge * np.eye(features.shape[1]), features.T @ (weight * targets))
    folded = marks @ (root @ beta[:-1]).astype(np.float32)
    # the last row is the regression's constant
    return Model(languages, letters_of(rows), vocabulary, np.vstack([folded, beta[-1:].astype(np.float32)]))


def placed(vocabulary: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where the n-grams are in the vocabulary; its length for those that are not."""
    at = np.searchsorted(vocabulary, grams)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == grams, at, len(vocabulary))


class Places:
    """Places in the vocabulary of a text's distinct n-grams."""

    def __init__(self, model: Model):
        self.grams, self.vocabulary = Grams(), model.vocabulary
        self.short = np.zeros(1 << BITS, np.uint8)
        self.short[GAP], self.short[model.letters] = 0, np.arange(1, len(model.letters) + 1)
        self.frequent = np.zeros(1 << BITS, bool)
        self.frequent[model.letters] = self.frequent[GAP] = True
        self.seen = np.zeros(SIZE, bool)
        self.place = np.full(SIZE, len(model.vocabulary), np.int32)
        # the table's number of each n-gram of the vocabulary whose letters are all frequent
        parts = [(model.vocabulary >> (BITS * k)) & ((1 << BITS) - 1) for k in range(GRAMS)]
        for k in range(1, GRAMS + 1):
            own = np.flatnonzero((model.vocabulary >= 1 << (BITS * (k - 1))) & ((model.vocabulary < 1 << (BITS * k)) if k < GRAMS else True) & np.logical_and.reduce([self.frequent[p] for p in parts[:k]]))
            number = sum(64**i for i in range(1, k)) + sum(self.short[parts[i][own]].astype(np.int64) << (6 * i) for i in range(k))
            self.place[number] = own

    def of(self, text: str) -> np.ndarray:
        codes = self.grams.codes(text)
        if not self.frequent[codes].all():
            return placed(self.vocabulary, np.unique(np.concatenate(Grams.numbers(codes))))
        base = 0
        for k, numbers in enumerate(Grams.numbers(self.short[codes].astype(np.int64), 6), 1):
            self.seen[numbers + base] = True
            base += 64**k
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return self.place[out]


def scorer(model: Model) -> Callable[[list[str | None]], tuple[list[str], list[float]]]:
    places = Places(model)
    weights, constant = model.weights[:-1], model.weights[-1]

    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and model.languages and has_letter(t)]
        for at in range(0, len(known), 256):
            some = known[at : at + 256]
            rows = [places.of(texts[i]) for i in some]
            starts = np.cumsum([0, *map(len, rows[:-1])])
            # presence rows times the folded landmark matrix
            raw = np.add.reduceat(weights[np.concatenate(rows)], starts, axis=0) / np.sqrt([len(r) for r in rows])[:, None] + constant
            e = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
            p = e / e.sum(axis=1, keepdims=True)
            for i, k, v in zip(some, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                langs[i], scores[i] = model.languages[k], v
        return langs, scores

    return score


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, grams), less texts without a letter."""
    grams = Grams()
    for batch in batches:
        some = [(lang, grams.present(t)) for lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.list_(pa.int64()))], names=["l", "grams"])


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled texts a language and about `most` in all (one a language at least), the first
    by a hash of the key, never held-out ones."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("k")))
    languages = rows.select("l").distinct().count()
    each = max(1, min(sample, most // max(languages, 1)))
    # only keys are ranked; a rank limit is applied before the shuffle, so a hot language sends few rows
    picked = rows.select("k", "l", F.xxhash64("k").alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))).where(F.col("r") <= each)
    # a row a language
    last = picked.groupBy("l").agg(F.max("h").alias("h"))
    chosen = rows.join(F.broadcast(last), "l").where(F.xxhash64("k") <= F.col("h"))
    # repeated rows of a key count once, so the bound holds whatever repeats
    found = arrow_map(chosen.groupBy("k", "l").agg(F.min("t").alias("t")).select("l", "t"), gram_rows, "l string, grams array<long>").toArrow()
    model = fit([np.asarray(x.values) for x in found["grams"]], found["l"].to_pylist())
    del found
    tidy()
    return model


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score. The model is as large as its n-grams and languages, whatever the input."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        score = scorer(shared.value)

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            langs, scores = score(batch.column(text).to_pylist())
            return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

        return run

    return with_columns_arrow(df, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
