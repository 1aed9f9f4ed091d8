"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Each unit vector is projected on many random lines, each line's values are sorted, and a window is laid around every
vector on every line. A pair collides on a line if one lies in the other's window; the number of lines on which it
collides decides whether its cosine is computed. Windows of single lines hold a fixed share of all vectors, whatever
their number, so this would count a share of all pairs: lines are first taken in tables of a few each, cut at random
offsets into cells, and sorting and counting go on within the cells. Width, lines a table, tables and the count a pair must reach
follow from the wanted recall at the threshold and the size of the largest label, as in locality-sensitive
hashing, so work grows nearly linearly with the rows where labels are not dense.

Equal vectors of a label are first joined to one with a multiplicity. Groups larger than a block are worked off
as pairs of blocks. A task keeps counts and a spanning forest of its links, never all pairs; a pair is counted
only in the first table that holds it.

Edge cases. Vectors that are null, empty, zero or hold a null or a non-finite component, and rows with a null
label or key, link with nothing; vectors of different lengths are not compared. Rows that repeat a key are one
vector, the smallest by label and components. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import arrow_map, connected_components, discard, grouped, stage

THRESHOLD = 0.98
RECALL = 0.9999
CELL = 6.0  # width of a cell in distances at the threshold
WINDOW = 2.0  # half width of a window in distances at the threshold
PARTNERS = 64  # unrelated vectors that may share a group, on average
BLOCK = 1024
FEW = 48
CHUNK = 64  # rows of a block whose collisions are counted at once


def same_cell(distance: float, width: float) -> float:
    """Probability that two vectors at that distance lie in one cell of a line with a random offset."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def count_needed(lines: int, p: float, miss: float) -> int:
    """The largest count that a pair at the threshold fails to reach with a probability of at most `miss`."""
    total, c = 0.0, 0
    while c < lines:
        total += math.exp(math.lgamma(lines + 1) - math.lgamma(c + 1) - math.lgamma(lines - c + 1) + c * math.log(p) + (lines - c) * math.log1p(-p))
        if total > miss:
            break
        c += 1
    return c


@dataclass(frozen=True)
class Plan:
    """What a threshold, a recall and the largest label ask for."""

    tables: int
    lines: int  # in each table
    cell: float
    window: float
    needed: int

    @classmethod
    def of(cls, largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
        distance = math.sqrt(max(2 - 2 * threshold, 1e-12))
        cell, miss = CELL * distance, 1 - recall
        lines = max(2, math.ceil(math.log(max(largest, 2) / PARTNERS) / -math.log(same_cell(math.sqrt(2), cell)))) if largest > PARTNERS else 2
        tables = math.ceil(math.log(miss / 2) / math.log1p(-(same_cell(distance, cell) ** lines)))
        return cls(tables, lines, cell, WINDOW * distance, count_needed(tables * lines, math.erf(WINDOW / math.sqrt(2)), miss / 2))


@lru_cache(maxsize=8)
def lines_of(plan: Plan, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (dimension, tables * lines) and offsets, fixed by the dimension."""
    rng = np.random.default_rng([dimension, 20])
    return rng.standard_normal((dimension, plan.tables * plan.lines)), rng.uniform(0, plan.cell, plan.tables * plan.lines)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that huge or tiny components neither overflow nor vanish
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cells_of(units: np.ndarray, plan: Plan) -> np.ndarray:
    """(rows, tables) numbers of the cells."""
    return numbered_cells(units @ lines_of(plan, units.shape[1])[0], units.shape[1], plan)


def numbered_cells(projected: np.ndarray, dimension: int, plan: Plan) -> np.ndarray:
    offsets = lines_of(plan, dimension)[1]
    cells = np.floor((projected + offsets) / plan.cell).astype(np.int64).astype(np.uint64).reshape(len(projected), plan.tables, plan.lines)
    h = np.zeros(cells.shape[:2], np.uint64)
    for i in range(plan.lines):
        h = (h ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


class Windows:
    """Sorted projections of one group: each vector's place on each line, and where the window centred on it lies."""

    def __init__(self, projected: np.ndarray, window: float):
        lines = projected.T
        self.small = None
        if len(projected) <= FEW:
            # the same counts without sorting, which pays in larger groups only
            self.small = (np.abs(projected[:, None, :] - projected[None, :, :]) <= window).sum(axis=2)
            return
        order = np.argsort(lines, axis=1)
        ranked = np.take_along_axis(lines, order, axis=1)
        self.place = np.empty(lines.shape, np.int32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(lines.shape[1], dtype=np.int32), lines.shape), axis=1)
        self.low = np.stack([np.searchsorted(r, q - window) for r, q in zip(ranked, lines, strict=True)]).astype(np.int32)
        self.high = np.stack([np.searchsorted(r, q + window, side="right") for r, q in zip(ranked, lines, strict=True)]).astype(np.int32)

    def collisions(self, rows: slice) -> np.ndarray:
        """(rows, all): on how many lines a vector lies in the windows of the rows."""
        if self.small is not None:
            return self.small[rows]
        out = np.zeros((rows.stop - rows.start, self.place.shape[1]), np.int16)
        for place, low, high in zip(self.place, self.low[:, rows], self.high[:, rows], strict=True):
            out += (place >= low[:, None]) & (place < high[:, None])
        return out


def link_group(units: np.ndarray, copies: np.ndarray, table: int, split: np.ndarray | None, plan: Plan, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row (weighted by copies) and a spanning forest of them, within one group."""
    n, projected = len(units), units @ lines_of(plan, units.shape[1])[0]
    windows, cells = Windows(projected, plan.window), None
    links, edges, component = np.zeros(n, np.int64), [], np.arange(n)
    for at in range(0, n, CHUNK):
        rows = slice(at, min(at + CHUNK, n))
        ok = windows.collisions(rows) >= plan.needed
        ok &= np.arange(n)[None, :] > np.arange(rows.start, rows.stop)[:, None]
        if split is not None:
            ok &= split[None, :] != split[rows, None]
        if not ok.any():
            continue
        a, b = np.nonzero(ok & (units[rows] @ units.T >= threshold))
        if not len(a):
            continue
        cells = numbered_cells(projected, units.shape[1], plan) if cells is None else cells
        a += at
        first = (cells[a] == cells[b]).argmax(axis=1) == table
        a, b = a[first], b[first]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for v, near in zip(*np.unique(a, return_index=True), strict=True):
            others = b[near : np.searchsorted(a, v, side="right")]
            for o in others[np.unique(component[others], return_index=True)[1]].tolist():
                if component[o] != component[v]:
                    component[component == component[o]] = component[v]
                    edges.append((int(v), o))
    return links, edges


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept), a row for each distinct key; a null key's row has null component and is kept."""
    # float components stay so where they are moved; cosines are computed in double precision
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(kind).alias("v"))
    ok = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    one = stage(rows.where("id is not null").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"), "vectors")
    good = one.where(ok).withColumn("same", F.xxhash64("label", "v"))
    groups = stage(good.groupBy("same", "label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("size", F.size("v")), "vector-groups")
    largest = groups.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    plan = Plan.of(largest, threshold, recall)

    def cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, cells = batch.column(1), [None] * batch.num_rows
            sizes = vectors.value_lengths().to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v = vectors.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), size)
                for i, c in zip(at.tolist(), cells_of(unit_rows(v), plan), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.int64()))], names=["rep", "cells"])

    cells = stage(arrow_map(groups.select("rep", "v"), cell_rows, "rep long, cells array<long>"), "vector-cells")
    dealt = cells.join(groups.select("rep", "label", "size"), "rep").select("rep", "label", "size", F.posexplode("cells").alias("table", "cell"))
    keys = ["label", "size", "table", "cell"]
    full = dealt.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    members = dealt.join(full, keys).join(groups.select("rep", "copies", "v"), "rep")
    cut = members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, [*keys, "i", "j"]):
            if t.num_rows < 2:
                continue
            ids, size, table = t["rep"].to_numpy(), t["size"][0].as_py(), t["table"][0].as_py()
            units = unit_rows(t["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), size))
            split = t["own"].to_numpy() if t["i"][0].as_py() != t["j"][0].as_py() else None
            links, edges = link_group(units, t["copies"].to_numpy(), table, split, plan, threshold)
            some = np.flatnonzero(links)
            if len(some):
                a = np.concatenate([ids[some], ids[[e[0] for e in edges]]])
                b = pa.array([None] * len(some) + ids[[e[1] for e in edges]].tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)]))], names=["a", "b", "n"])

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, "i", "j"]
    found = stage(arrow_map(cut.select(*order, "rep", "own", "copies", "v").repartition(width, *order).sortWithinPartitions(*order, "rep"), link_rows, "a long, b long, n long"), "vector-links")
    discard(cells)
    components = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = groups.join(counts, "rep", "left").join(components, "rep", "left")
    known = groups.select("same", F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = good.join(known, (good["same"] == known["same"]) & (good["label"] == known["l"]) & (good["v"] == known["w"])).select("id", "n_links", "component")
    rest = one.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = linked.unionByName(rest).unionByName(rows.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op9_collision_counting(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
