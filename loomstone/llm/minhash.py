"""Near-duplicate documents by DartMinHash signatures, banded joining and exact checks.

A document is a weighted set of five-word shingles (weight: the count, or 1 each). Every shingle throws darts:
points of a random process in the plane of weight and rank, the same wherever the shingle occurs, cut into
dyadic cells so that only cells under the shingle's weight and below the rank needed are made. A dart has one of
k coordinates; each coordinate keeps its earliest dart. Two sets agree in a coordinate with the probability of
their weighted Jaccard similarity (Christiani 2020). Light ranks come first and a document leaves as soon as all
its coordinates are filled, so the darts per document do not depend on its length.

Texts of equal normalised words are first joined to one representative. Bands of five coordinates put
representatives into buckets. Large buckets are cut into blocks, and pairs of blocks are worked off: first a
maximum spanning forest by estimated similarity, whose pairs are checked exactly and joined to components; then
every pair of a bucket that still lies in two components and is not estimated far below the threshold is checked
in its block, which sends on a spanning forest of what it finds. So groups are never expanded into all pairs, and
no link between components is lost.

Words are runs of letters, digits and underscores in lower case. Edge cases: a null or wordless text links with
nothing; a text of one to four words is one shingle; null keys link with nothing and are kept; rows that repeat a
key are one node of the graph. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import Forest, arrow_map, connected_components, discard, grouped, stage, tidy

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
#: Pairs estimated below this are not checked: 3.9 standard deviations under the threshold.
LEAST_ESTIMATE = 0.66
BLOCK = 1024
BLOCK_ELEMENTS = 1 << 22
CHUNK_ELEMENTS = 1 << 17
WORD = re.compile(r"\w+")
FIRST_SLAB = -14


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed(*parts: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little"))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


POWERS = [seed("power", i) | np.uint64(1) for i in range(SHINGLE)]


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the five-word windows, repeats included; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix(out + h[i : len(words) - n + 1 + i] * POWERS[i])
    return out


def weighted(hashes: np.ndarray, counts: bool) -> tuple[np.ndarray, np.ndarray]:
    distinct, n = np.unique(hashes, return_counts=True)
    return distinct, n.astype(np.float64) if counts else np.ones(len(distinct))


def poisson_steps(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a cell."""
    n = int(area + 12 * area**0.5 + 16)
    logs = -area + np.arange(n) * np.log(area) - np.concatenate(([0], np.cumsum(np.log(np.arange(1, n)))))
    return np.cumsum(np.exp(logs))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """(n_docs, k) identities of the earliest darts. doc[i] is the document of element i; each has an element."""
    best = np.full(n_docs * k, np.inf)
    out = np.zeros(n_docs * k, np.uint64)
    slab = FIRST_SLAB
    active = np.ones(n_docs, bool)
    while len(elements):
        low, high = (0.0 if slab == FIRST_SLAB else 2.0 ** (slab - 1)), 2.0**slab
        stratum, heaviest = 0, weights.max()
        keys, ranks, darts = [], [], []
        while stratum == 0 or 2.0 ** (stratum - 1) < heaviest:
            bottom, top = (0.0, 1.0) if stratum == 0 else (2.0 ** (stratum - 1), 2.0**stratum)
            under = np.flatnonzero(weights > bottom) if stratum else slice(None)
            e, w, d = elements[under], weights[under], doc[under]
            steps = poisson_steps((top - bottom) * (high - low))
            u = unit(mix(e ^ seed("cell", slab, stratum)))
            some = np.flatnonzero(u >= steps[0])
            e, w, d, n = e[some], w[some], d[some], np.searchsorted(steps, u[some], side="right")
            c = 0
            while len(e):
                h = mix(e ^ seed("dart", slab, stratum, c))
                hit = np.flatnonzero(bottom + unit(mix(h ^ seed("weight"))) * (top - bottom) < w)
                keys.append(d[hit] * k + (mix(h[hit] ^ seed("coordinate")) % np.uint64(k)).astype(np.int64))
                ranks.append(low + unit(mix(h[hit] ^ seed("rank"))) * (high - low))
                darts.append(h[hit])
                c += 1
                more = np.flatnonzero(n > c)
                e, w, d, n = e[more], w[more], d[more], n[more]
            stratum += 1
        if keys:
            key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
            np.minimum.at(best, key, rank)
            first = rank == best[key]
            out[key[first]] = dart[first]
        active &= ~np.isfinite(best.reshape(n_docs, k)).all(axis=1)
        still = active[doc]
        elements, weights, doc = elements[still], weights[still], doc[still]
        slab += 1
    return out.reshape(n_docs, k)


def signatures(texts: list[list[str]], counts: bool = False) -> np.ndarray:
    """Signatures of word lists, none of them empty, worked off in chunks of bounded size."""
    out, at = [], 0
    while at < len(texts):
        parts, size, end = [], 0, at
        while end < len(texts) and (end == at or size < CHUNK_ELEMENTS):
            parts.append(weighted(shingles(texts[end]), counts))
            size += len(parts[-1][0])
            end += 1
        doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        out.append(dart_signatures(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), doc, len(parts)))
        at = end
    return np.concatenate(out) if out else np.zeros((0, K), np.uint64)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(-1, BANDS, ROWS)
    h = np.zeros(s.shape[:2], np.uint64)
    for i in range(ROWS):
        h = mix(h + s[:, :, i] * POWERS[i])
    return h.view(np.int64)


def sketch(docs: DataFrame, counts: bool = False) -> DataFrame:
    """(id, text) to (id, same, bands, sig); same is a digest of the normalised words, null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [words_of(t) for t in part.column(1).to_pylist()]
                full = [i for i, w in enumerate(words) if w]
                sig = signatures([words[i] for i in full], counts)
                bands, small = band_hashes(sig), (sig & np.uint64(0xFFFF)).astype("<u2")
                cols: list[list] = [[None] * len(words) for _ in range(3)]
                for r, i in enumerate(full):
                    cols[0][i] = hashlib.blake2b(" ".join(words[i]).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                    cols[1][i], cols[2][i] = bands[r], small[r].tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.binary())], names=["id", "same", "bands", "sig"])

    return arrow_map(docs, run, "id long, same string, bands array<long>, sig binary")


def shingle_sets(docs: DataFrame, counts: bool = False) -> DataFrame:
    """(id, text) to (id, set): distinct shingles as 64-bit hashes; with counts, each occurrence is its own element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, sets = batch.slice(at, 256), []
                for t in part.column(1).to_pylist():
                    h = np.sort(shingles(words_of(t)))
                    if counts and len(h):
                        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                        h = mix(h + (np.arange(len(h)) - np.repeat(starts, np.diff([*starts, len(h)]))).astype(np.uint64))
                    sets.append(np.sort(np.unique(h).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return arrow_map(docs, run, "id long, set array<long>")


def forest(ids: np.ndarray, sig: np.ndarray, split: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of a maximum spanning forest by agreeing coordinates (Prim), of pairs at least LEAST_ESTIMATE.

    split[i]: which of two blocks row i is of; pairs within one block are then left to that block's own task.
    """
    n, least, out = len(ids), LEAST_ESTIMATE * sig.shape[1], []
    near, parent, out_of_tree = np.full(n, -1), np.full(n, -1), np.ones(n, bool)
    v = 0
    for _ in range(n):
        out_of_tree[v] = False
        agree = (sig == sig[v]).sum(axis=1)
        if split is not None:
            agree[split == split[v]] = -1
        better = out_of_tree & (agree > near)
        near[better], parent[better] = agree[better], v
        rest = np.flatnonzero(out_of_tree)
        if not len(rest):
            break
        v = rest[near[rest].argmax()]
        if near[v] >= least:
            out.append((ids[v], ids[parent[v]]))
    return out


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Exact Jaccard similarity of two ascending sets reaches the threshold."""
    at = a.searchsorted(b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum())
    return common >= threshold * (len(a) + len(b) - common) - 1e-9


def across(ids: np.ndarray, sig: np.ndarray, split: np.ndarray | None, component: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between components: every pair of the block that may reach the threshold and
    is not joined yet is checked exactly."""
    least, out, forest, first = LEAST_ESTIMATE * sig.shape[1], [], Forest(len(ids)), {}
    for i, c in enumerate(component.tolist()):
        forest.join(first.setdefault(c, i), i)
    for v in range(len(ids) - 1):
        ok = component[v + 1 :] != component[v]
        if split is not None:
            ok &= split[v + 1 :] != split[v]
        others = np.flatnonzero(ok) + v + 1
        if len(others):
            for o in others[(sig[others] == sig[v]).sum(axis=1) >= least].tolist():
                if forest.find(o) != forest.find(v) and similar(sets[v], sets[o], threshold):
                    forest.join(o, v)
                    out.append((ids[v], ids[o]))
    return out


KEYS = ["band", "hash", "i", "j"]


def dealt_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows (band, hash, id, ...) sorted by bucket and pair of blocks: a bucket of many members is cut into blocks,
    and each row goes to the pairs that its own block is in."""
    cut = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks", "n")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(width, *KEYS).sortWithinPartitions(*KEYS, "id")


def pair_table(work: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray | None], list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The map that gives each group's rows, ids, signatures and block numbers to work, and its pairs on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, KEYS):
            if table.num_rows < 2:
                continue
            ids = table["id"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(len(ids), -1)
            split = table["own"].to_numpy() if table["i"][0].as_py() != table["j"][0].as_py() else None
            if pairs := work(table, ids, sig, split):
                p = np.sort(np.array(pairs, np.int64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return run


def likely_pairs(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the buckets' forests: members (band, hash, n, id), chosen (id, sig)."""
    rows = dealt_blocks(members.join(chosen, "id"), F.ceil(F.col("n") / BLOCK))
    return arrow_map(rows, pair_table(lambda table, ids, sig, split: forest(ids, sig, split)), "a long, b long").distinct()


def bridges(members: DataFrame, chosen: DataFrame, sets: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """Links between different components, enough to join all that any link joins; a block's sets have a bounded size."""
    rows = members.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sized = rows.join(sets.select("id", F.size("set").alias("size")), "id")
    mixed = sized.groupBy("band", "hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("size").alias("elements")).where("lo < hi").select("band", "hash", "elements")
    wide = rows.join(mixed, ["band", "hash"]).join(chosen, "id").join(sets, "id")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("elements") / BLOCK_ELEMENTS))

    def work(table: pa.Table, ids: np.ndarray, sig: np.ndarray, split: np.ndarray | None) -> list[tuple[int, int]]:
        own = [x.values.to_numpy() for x in table["set"]]
        return across(ids, sig, split, table["component"].to_numpy(), own, threshold)

    return arrow_map(dealt_blocks(wide, blocks), pair_table(work), "a long, b long").distinct()


def checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose exact similarity reaches the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("common", common).where(F.col("common") >= threshold * (F.size("set_a") + F.size("set_b") - F.col("common")) - 1e-9).select("a", "b")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, counts: bool = True) -> DataFrame:
    """(key, component_id, kept), a row for each distinct non-null key: kept where the key is its component's smallest.

    A shingle weighs as often as it occurs, and similarity is the weighted Jaccard similarity; counts=False takes sets.
    """
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = stage(sketch(docs, counts), "dart-sketch")
    # one representative for texts of equal words; partial aggregation takes hot groups
    groups = stage(sketched.where("same is not null").groupBy("same").agg(F.min(F.struct("id", "bands", "sig")).alias("r")).select("same", "r.id", "r.bands", "r.sig"), "dart-groups")
    reps = groups.groupBy("id").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    dealt = reps.select("id", F.posexplode("bands").alias("band", "hash"))
    buckets = dealt.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(dealt.join(buckets, ["band", "hash"]), "dart-members")
    wanted = stage(members.select("id").distinct(), "dart-wanted")
    chosen = stage(reps.select("id", "sig").join(wanted, "id", "left_semi"), "dart-chosen")
    sets = stage(shingle_sets(docs.join(wanted, "id", "left_semi"), counts).dropDuplicates(["id"]), "dart-sets")
    first = stage(checked(likely_pairs(members, chosen), sets, threshold), "dart-first")
    components = stage(connected_components(first).withColumnRenamed("node", "id"), "dart-components")
    second = stage(bridges(members, chosen, sets, components, threshold), "dart-second")
    discard(members, wanted, chosen, sets)
    same = sketched.where("same is not null").join(groups.select("same", F.col("id").alias("rep")), "same").where("id <> rep").groupBy("id").agg(F.min("rep").alias("rep"))
    # the few links between components join these as a whole; a representative without links is its own
    part_of = {end: components.select(F.col("id").alias(end), F.col("component").alias(f"part_{end}")) for end in "ab"}
    parts = second.join(part_of["a"], "a", "left").join(part_of["b"], "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    wholes = stage(connected_components(parts).select(F.col("node").alias("part"), F.col("component").alias("whole")), "dart-wholes")
    discard(first, second)
    nodes = sketched.select("id").distinct().join(same, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    parted = nodes.join(components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    out = parted.join(wholes, "part", "left").select("id", F.coalesce("whole", "part").alias("component_id"))
    return out.select(F.col("id").alias(key), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op10_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
