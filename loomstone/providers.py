"""Model-backed steps behind interfaces, each with a deterministic offline default."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.operators import extract, session
from loomstone.operators.retrieval import Decomposition


class Decomposer(Protocol):
    def decompose(self, query: str) -> Decomposition: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Culler(Protocol):
    def keep(self, query: str, chunks: list[str]) -> list[int]: ...


class Summariser(Protocol):
    def summarise(self, text: str, most: int) -> str: ...


class SingleAxis:
    """One semantic axis of weight 1, no keywords, no identifiers."""

    def decompose(self, query: str) -> Decomposition:
        return Decomposition(query)


class NoEmbedder:
    """Entries stay keyword-only."""

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [None] * len(texts)


class HashEmbedder:
    """Signed hashed words, for tests and offline use."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


class KeepAll:
    def keep(self, query: str, chunks: list[str]) -> list[int]:
        return list(range(len(chunks)))


class HeadAndTail:
    """The first and the last half of the characters allowed."""

    def summarise(self, text: str, most: int) -> str:
        return text if len(text) <= most else f"{text[: most // 2]}\n  [...]\n{text[-(most // 2) :]}"


class Backend(Protocol):
    """A model that answers messages (role, content) under a system text."""

    def complete(self, system: str, messages: list[dict]) -> str: ...


class ActionExecutor(Protocol):
    """Does what an action block asks for; (ok, result)."""

    def execute(self, project: str, kind: str, content: str) -> tuple[bool, str]: ...


class Policy(Protocol):
    """Which rows of a log stay in its tail: adds in_tail."""

    def split(self, log: DataFrame, budget: int) -> DataFrame: ...


class TokenTail:
    """The suffix that fits the budget."""

    def split(self, log: DataFrame, budget: int) -> DataFrame:
        return session.tail_by_tokens(log, budget)


@dataclass(frozen=True)
class TurnTail:
    """The last turns, whatever the budget."""

    turns: int = 10

    def split(self, log: DataFrame, budget: int) -> DataFrame:
        return session.tail_by_turns(log, self.turns)


#: Compression policies by name.
POLICIES: dict[str, Policy] = {"tokens": TokenTail(), "turns": TurnTail()}


class Narrator(Protocol):
    """Retells turns (role, content) as JSON turns in a text, or gives None."""

    def narrate(self, turns: list[tuple[str, str]]) -> str | None: ...


class NoNarrator:
    def narrate(self, turns: list[tuple[str, str]]) -> str | None:
        return None


class Synthesiser(Protocol):
    """Kernels (kind, importance, content, refs) from lines about chains; none without a model."""

    def kernels(self, lines: list[str], projects: int) -> list[dict]: ...


class NoSynthesis:
    def kernels(self, lines: list[str], projects: int) -> list[dict]:
        return []


MOST_EMBEDDED, BATCH = 8000, 32


def embedded(rows: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """rows with their vectors: texts cut to MOST_EMBEDDED characters, BATCH of them a call, each alone where a call fails."""
    fields = [*[f for f in rows.schema.fields if f.name != "embedding"], T.StructField("embedding", T.ArrayType(T.DoubleType()))]
    kept = rows.select(*[f.name for f in fields[:-1]])

    def alone(t: str) -> list[float] | None:
        try:
            return embedder.embed([t])[0]
        except Exception:  # noqa: BLE001 - a provider's failure leaves the entry without a vector
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors: list = []
            texts = [(t or "")[:MOST_EMBEDDED] for t in batch.column(text).to_pylist()]
            for i in range(0, len(texts), BATCH):
                try:
                    vectors += embedder.embed(texts[i : i + BATCH])
                except Exception:  # noqa: BLE001
                    vectors += map(alone, texts[i : i + BATCH])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*batch.schema.names, "embedding"])

    return kept.mapInArrow(run, T.StructType(fields))


LEAST_NARRATED = 20


def narrated(log: DataFrame, narrator: Narrator, most: int = 60_000) -> DataFrame:
    """(thread, seq, role, content): threads of more than LEAST_NARRATED turns retold from their cut middle; all others, and
    those whose answer is no list of turns, as they are."""
    rows = log.withColumn("n", F.count("*").over(Window.partitionBy("thread")))
    cut = session.truncate_middle(rows.where(F.col("n") > LEAST_NARRATED), most)
    ask = F.struct("seq", F.when(F.col("role") == "user", 1).otherwise(0).alias("k"), "role", "content")
    told = cut.groupBy("thread").agg(F.array_sort(F.collect_list(ask)).alias("turns"))  # within the limit of characters
    kind = log.schema["thread"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [narrator.narrate([(t["role"], t["content"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("thread"), pa.array(answers, pa.string())], names=["thread", "answer"])

    answers = told.select("thread", "turns").mapInArrow(run, T.StructType([T.StructField("thread", kind), T.StructField("answer", T.StringType())]))
    new = answers.select("thread", extract.json_turns(F.col("answer")).alias("t")).where(F.col("t").isNotNull())
    flat = new.select("thread", F.posexplode("t").alias("seq", "x")).select("thread", F.col("seq").cast(log.schema["seq"].dataType).alias("seq"), "x.role", "x.content")
    return log.join(new.select("thread"), "thread", "left_anti").select("thread", "seq", "role", "content").unionByName(flat)
