"""The retrieval facade: plan a query, run its axes, fuse, filter, decay, rank, fit the budget, cull."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone import providers as P
from loomstone.operators import identify as I
from loomstone.operators import retrieval as R

SUFFIX = {"anti_pattern": " error failed wrong bug", "causal": " because decided reason why"}


@dataclass
class Retriever:
    """corpus: seq, role, content, thread, ts, and heading and chunk_type of code; none: static sources answer.

    vectors: seq, embedding, or none; then axes that need them find nothing. known: the identifier index (column
    `identifier`), or none; then names are searched as the plan gives them. static: seq, path, content.
    """

    corpus: DataFrame | None
    vectors: DataFrame | None = None
    known: DataFrame | None = None
    static: DataFrame | None = None
    decomposer: P.Decomposer = field(default_factory=P.SingleAxis)
    embedder: P.Embedder = field(default_factory=P.NoEmbedder)
    culler: P.Culler = field(default_factory=P.KeepAll)

    def axis(self, a: R.Axis, query: str) -> DataFrame | None:
        if a.axis == "temporal":
            return R.temporal(self.corpus, a.filter or "newest")
        if a.axis == "entity":
            return R.entity(self.corpus, a.filter)
        if a.axis == "polarity" and a.filter in ("failure", "success"):
            return R.polarity_axis(self.corpus, a.filter)
        vector = self.embedder.embed([query + SUFFIX.get(a.axis, "")])[0] if self.vectors is not None else None
        if a.axis == "project" and a.filter:
            return R.project(self.corpus, a.filter, self.vectors if vector else None, vector)
        if a.axis in ("semantic", "project", *SUFFIX) and vector:
            return R.semantic(self.vectors, vector, 20 if a.axis in SUFFIX else 30)
        return None

    def names(self, raw: tuple[str, ...]) -> list[str]:
        """Identifiers of the index that a query's few names mean, three each at most; the names as they are without an index."""
        if self.known is None or self.known.isEmpty():
            return list(raw)
        found = I.resolved(list(raw), self.known.select(F.col("identifier").alias("known")))
        return list(dict.fromkeys(r.known for r in found.orderBy("raw", F.desc("score"), "known").collect()))

    def retrieve(self, query: str, budget: int, as_of: Column, tail: str = "", cull: bool = False, role: str | None = None, project: str | None = None) -> DataFrame:
        """Ranked chunks within the budget. With cull, five times the budget is found first and whole chunks are chosen."""
        if self.corpus is None:
            if self.static is None:
                raise ValueError("neither a corpus nor static sources")
            return R.static_budget(self.static, budget)
        asked = f"{tail[-2000:]}\n\nCurrent question: {query}" if tail else query
        plan = self.decomposer.decompose(asked)
        axes = [(found, a.weight) for a in plan.axes if (found := self.axis(a, plan.query)) is not None]
        words = R.keyword(self.corpus, " ".join((plan.query, *plan.keywords)))
        names = self.names(plan.identifiers) if plan.identifiers else []
        fused = R.fuse(axes, words, R.identifiers(self.corpus, names) if names else None)
        ranked = R.decayed(fused, self.corpus, as_of)
        ranked = R.filtered(ranked, role, project).withColumn("score", F.round("score", 6))
        out = R.budget(ranked, budget * 5 if cull else budget)
        if not cull:
            return out
        # a budget's worth of chunks, previews of 300 characters
        shown = out.orderBy(F.desc("score"), "seq").select("seq", F.substring("chunk", 1, 300).alias("p")).collect()
        kept = [shown[i].seq for i in self.culler.keep(query, [r.p for r in shown]) if 0 <= i < len(shown)] if len(shown) > 5 else [r.seq for r in shown]
        return R.budget(out.where(F.col("seq").isin(kept)).drop("tokens", "running", "chunk"), budget)
