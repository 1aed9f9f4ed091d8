"""Integration rounds: seeds to clusters to chains, by a provider, until a limit or convergence.

Chains go through known members, a smallest size, a non-empty synthesis, and greedy deduplication in order: each
new chain is dropped if its members overlap one kept before by more than half. A new chain that has a vector is a
seed of the next round, before all others; clusters hold entries of the corpus only. Only a round's own bounded pool
of seeds and their clusters reaches the driver.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators import mining
from loomstone.providers import MOST_EMBEDDED, Embedder, HeadAndTail, NoEmbedder, Summariser


@dataclass(frozen=True)
class Found:
    """What a provider finds in a cluster."""

    members: tuple[str, ...]
    synthesis: str
    kind: str = "thematic"
    cross_project: bool = False


class ChainFinder(Protocol):
    def find(self, prompt: str, members: list[dict]) -> Iterable[Found]: ...


class NoChains:
    """The default: without a model no chain is found."""

    def find(self, prompt: str, members: list[dict]) -> Iterable[Found]:
        return ()


class SharedWords:
    """Offline heuristic: one chain of the whole cluster, named by the words that all its members share."""

    def find(self, prompt: str, members: list[dict]) -> Iterable[Found]:
        shared = set.intersection(*({w for w in m["content"].lower().split() if len(w) > 3} for m in members))
        if shared:
            yield Found(tuple(str(m["seq"]) for m in members), "shares " + ", ".join(sorted(shared)[:8]), cross_project=len({m["thread"] for m in members}) > 1)


@dataclass
class Limits:
    rounds: int = 3
    chains: int = 500
    window: int = 3
    quiet: int = 2
    seeds: int = 24
    seconds: float = 1800
    tokens: int = 500_000


@dataclass
class Run:
    """Kept chains, what each round made and its seeds (chains of this run have negative numbers), and why it ended."""

    chains: list[dict] = field(default_factory=list)
    history: list[int] = field(default_factory=list)
    seeds: list[list[int]] = field(default_factory=list)
    tokens: int = 0
    stopped: str = "rounds"
    began: float = field(default_factory=time.monotonic)

    def over(self, limits: Limits) -> str | None:
        """The limit that is reached, if any."""
        if time.monotonic() - self.began >= limits.seconds:
            return "time"
        if self.tokens >= limits.tokens:
            return "tokens"
        return "chains" if len(self.chains) >= limits.chains else None

    def stats(self) -> dict:
        return {"passes": len(self.history), "chains": len(self.chains), "by_pass": self.history, "tokens": self.tokens, "stopped": self.stopped}


def converged(history: list[int], window: int = 3, most: int = 2) -> bool:
    """The last `window` rounds each made at most `most` chains."""
    return len(history) >= window and all(n <= most for n in history[-window:])


def overlaps(members: set[str], kept: list[set[str]], least: float = 0.5) -> bool:
    return any(len(members & k) > least * len(members | k) for k in kept)


def prompt_lines(members: list[dict], budget: int = 6000, summariser: Summariser | None = None) -> str:
    """One line a member, characters dealt evenly."""
    each, short = budget // max(len(members), 1), summariser or HeadAndTail()
    return "\n".join(f"[{m['seq']} {m['thread'] or '?'} {str(m['ts'] or '')[:10]} {m['role']}] {short.summarise(m['content'], each)}" for m in members)


def chain_of(found: Found, members: list[dict], kept: list[set[str]], round_no: int) -> dict | None:
    """A chain entry, or None where its members are unknown or taken or it says nothing."""
    known = {str(m["seq"]): m for m in members}
    names = [u for u in (u.strip().strip("[]") for u in found.members) if u in known]
    text = found.synthesis.strip()
    if not names or not text or overlaps(set(names), kept):
        return None
    threads = [known[u]["thread"] for u in names if known[u]["thread"]]
    primary = min(set(threads), key=lambda t: (-threads.count(t), t)) if threads else "unknown"
    uid = hashlib.sha256("|".join((text, *names)).encode()).hexdigest()[:12]
    return {"uid": uid, "role": "chain", "content": text, "thread": primary, "heading": f"chain: {text[:60]}", "chain_type": found.kind, "member_uids": names, "member_projects": sorted(set(threads)), "cross_project": found.cross_project, "dream_pass": round_no}


def integrate(rows: DataFrame, finder: ChainFinder | None = None, limits: Limits | None = None, embedder: Embedder | None = None, focus: str = "", as_of: Column | None = None) -> Run:
    """rows: seq, role, thread, ts, content, embedding. Limits hold from cluster to cluster.

    A round's seeds are the chains that wait, and then those of the pool that were not seeds before, by what no chain
    holds yet. Without an embedder chains have no vectors and are no seeds.
    """
    finder, limits, embedder, run = finder or NoChains(), limits or Limits(), embedder or NoEmbedder(), Run()
    spark, corpus = rows.sparkSession, rows.where("role <> 'chain'")
    kept: list[set[str]] = []
    spent: list[int] = []
    waiting: list[int] = []
    parts = ["seq", "thread", F.col("ts").cast("timestamp").alias("ts"), "content", F.col("embedding").cast("array<double>").alias("embedding")]
    for n in range(limits.rounds):
        own, waiting = waiting[: limits.seeds], waiting[limits.seeds :]
        places = []
        if len(own) < limits.seeds:
            numbers = lambda of: F.broadcast(spark.createDataFrame([(int(u),) for u in of], "seq long"))
            pool = mining.seeds(rows.join(numbers(spent), "seq", "left_anti"), numbers(u for k in kept for u in k), focus, limits.seeds - len(own), as_of)
            places = [r.seq for r in pool.select("seq", "place").orderBy("place").collect()]
        if not own and not places:
            run.stopped = "seeds"
            break
        spent += places
        run.seeds.append([*own, *places])
        of_run = [(s, c["thread"], None, c["content"], c["embedding"]) for s in own for c in [run.chains[-s - 1]]]
        seeds = spark.createDataFrame(of_run, "seq long, thread string, ts timestamp, content string, embedding array<double>")
        if places:
            seeds = seeds.unionByName(rows.join(numbers(places), "seq", "left_semi").select(*parts))
        found: dict[int, list[dict]] = {}
        for r in mining.clusters(corpus, seeds).join(rows, "seq").select("seed_seq", "place", "seq", "role", "thread", "ts", "content").orderBy("seed_seq", "place").collect():
            found.setdefault(r.seed_seq, []).append(r.asDict())
        made, why = 0, None
        for members in (found[s] for s in run.seeds[-1] if s in found):
            if why := run.over(limits):
                break
            prompt = prompt_lines(members)
            run.tokens += len(prompt) // 4
            for f in finder.find(prompt, members):
                run.tokens += len(f.synthesis) // 4
                if len(run.chains) < limits.chains and (chain := chain_of(f, members, kept, n)):
                    chain["embedding"] = embedder.embed([chain["content"][:MOST_EMBEDDED]])[0]
                    run.chains.append(chain)
                    kept.append(set(chain["member_uids"]))
                    if chain["embedding"]:
                        waiting.append(-len(run.chains))
                    made += 1
        run.history.append(made)
        if why := why or run.over(limits) or ("converged" if converged(run.history, limits.window, limits.quiet) else None):
            run.stopped = why
            break
    return run
