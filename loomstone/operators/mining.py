"""Offline mining: coverage, seeds, clusters, weekly centroids and links, chain deduplication, cross-references, report."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomstone.functions import text as X
from loomstone.functions import vector as V

#: Bytes of the vectors of a block, rows and columns of the products of two, and shares of either side of all pairs.
BLOCK_BYTES, TILE, PARTS = 2 << 20, 1024, 12
#: Rows of a task where chains or members meet, so that its memory does not grow with the tables.
ROWS = 1 << 20


def coverage(rows: DataFrame, chained: DataFrame) -> DataFrame:
    """(thread, rows, chains, coverage): share of a thread's entries that a chain holds; the least covered first."""
    n = rows.groupBy("thread").agg(F.count("*").alias("rows"))
    c = rows.join(chained.select("seq").distinct(), "seq", "left_semi").groupBy("thread").agg(F.count("*").alias("chains"))
    return n.join(c, "thread", "left").select("thread", "rows", F.coalesce("chains", F.lit(0)).cast("long").alias("chains"), F.round(F.coalesce("chains", F.lit(0)) / F.col("rows"), 6).alias("coverage"))


def focus(covered: DataFrame) -> DataFrame:
    return covered.orderBy("coverage", "thread").limit(1)


#: Seed bands: name, priority, and the group in which the pool deals them: focus first, stale last, the rest in turn.
BANDS = (("focus", 2.5, 0), ("chain", 2.0, 1), ("fresh", 1.5, 1), ("corpus", 1.0, 1), ("stale", 0.5, 2))


def seeds(rows: DataFrame, chained: DataFrame, focus_thread: str, k: int, as_of: Column | None = None) -> DataFrame:
    """The first k of the seed pool. Entries of the focus thread come whole and first; chains, entries of the last
    seven days and others that no chain holds are dealt in turn; entries of chains come last.

    Only embedded entries are seeds, where rows have vectors. Order within a band is by a hash of seq. Without as_of
    no entry is fresh. Bands are cut to k before they meet.
    """
    usable = rows.where(~X.low_signal_mining(F.col("role"), F.col("content")))
    if "embedding" in rows.columns:
        usable = usable.where(F.col("embedding").isNotNull())
    flagged = usable.join(chained.select("seq", F.lit(True).alias("c")).distinct(), "seq", "left")
    fresh = F.coalesce(F.col("ts") >= as_of - F.expr("interval 7 days"), F.lit(False)) if as_of is not None else F.lit(False)
    focus = F.coalesce(F.col("thread") == focus_thread, F.lit(False)) if focus_thread else F.lit(False)
    band = F.when(F.col("role") == "chain", 1).when(focus, 0).when(F.col("c").isNotNull(), 4).when(fresh, 2).otherwise(3)
    of = lambda i: F.element_at(F.array(*[F.lit(b[i]) for b in BANDS]), F.col("band") + 1)
    w = Window.partitionBy("band").orderBy(F.md5(F.col("seq").cast("string")), "seq")
    ranked = flagged.select("seq", "thread", band.alias("band")).withColumns({"priority": of(1), "turn": F.row_number().over(w)}).where(F.col("turn") <= k)
    order = Window.orderBy(of(2), "turn", "band", "seq")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(left: DataFrame, right: DataFrame, links: DataFrame, k: int, least: float | None = None, per_right: bool = False, block: int | None = None) -> DataFrame:
    """Exact top k pairs by (cosine, seq_a, seq_b) of tasks: those of the whole are among them.

    left and right: groups (an array), seq, v; links: the (group_a, group_b) to compare, few rows. The k are of each
    link, or with per_right of each right row. Vectors with gaps or of unequal length pair with none, nor does,
    without per_right, a seq with itself.

    Rows are packed into blocks and written once; each task of their product reads a share of either side, so that
    what is on disk grows with the rows, not with the pairs. A pair of blocks is multiplied once for all links, and
    for both directions if right is left.
    """
    spark, same = left.sparkSession, right is left
    kinds = [links.schema[g].dataType.simpleString() for g in ("group_a", "group_b")]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{2 * BLOCK_BYTES}b")  # few pairs of blocks at once

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t, dim = t.sort_by("seq"), key[1].as_py()
        groups = t.column("groups").combine_chunks()
        names = groups.flatten().unique()
        held = np.zeros((len(t), len(names)), bool)
        held[np.repeat(np.arange(len(t)), pc.list_value_length(groups).to_numpy()), pc.index_in(groups.flatten(), names).to_numpy()] = True
        v = np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        blobs = [np.packbits(held).tobytes(), t.column("seq").to_numpy().tobytes(), v.tobytes()]
        return pa.table({**{c: pa.array([x.as_py()], x.type) for c, x in zip(("home", "dim", "own"), key, strict=True)}, "groups": pa.array([names.to_pylist()], pa.list_(names.type)), **{c: pa.array([x], pa.binary()) for c, x in zip(("held", "seq", "v"), blobs, strict=True)}})

    def packed(rows: DataFrame, kind: str, side: str) -> DataFrame:
        whole = rows.where("v is not null and not exists(v, x -> x is null)").select(F.array_min("groups").alias("home"), F.size("v").alias("dim"), "groups", "seq", V.as_doubles(F.col("v")).alias("v"))
        most = F.lit(block) if block else F.greatest(F.lit(1), F.lit(BLOCK_BYTES) / (8 * F.greatest("dim", F.lit(1))))
        n = whole.groupBy("home", "dim").agg(F.count("*").alias("n")).select("home", "dim", F.ceil(F.col("n") / most).alias("blocks"))
        dealt = whole.join(F.broadcast(n), ["home", "dim"]).withColumn("own", F.pmod(F.xxhash64("seq"), "blocks")).drop("blocks")
        made = dealt.groupBy("home", "dim", "own").applyInArrow(pack, f"home {kind}, dim int, own long, groups array<{kind}>, held binary, seq binary, v binary")
        made = made.repartition(PARTS, "home", "dim", "own")
        return made.select(*[F.col(c).alias(f"{c}_{side}") for c in made.columns])

    def opened(row: dict, side: str) -> tuple:
        seq, dim = np.frombuffer(row[f"seq_{side}"], np.int64), row[f"dim_{side}"]
        held = np.unpackbits(np.frombuffer(row[f"held_{side}"], np.uint8), count=len(seq) * len(row[f"groups_{side}"])).reshape(len(seq), -1).astype(bool)
        v = np.frombuffer(row[f"v_{side}"]).reshape(len(seq), dim) if dim else np.zeros((len(seq), 0))
        return seq, dict(zip(row[f"groups_{side}"], held.T, strict=True)), v, v.astype(np.float32), (row[f"home_{side}"], row[f"own_{side}"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked = None
        found: dict = {}  # the best so far as (key, cos, seq_a, seq_b), and what reaches the k-th place of a key
        for row in (r for batch in batches for r in batch.to_pylist()):
            linked = linked or [(x["group_a"], x["group_b"]) for x in row["links"]]
            x, y = opened(row, "a"), opened(row, "b")
            ways = [(x, y, False)] + [(y, x, True)] * (same and x[4] != y[4])
            here = [(link, a, b, flip, (link, row["dim_b"], b[4]) if per_right else link) for a, b, flip in ways for link in linked if link[0] in a[1] and link[1] in b[1]]
            for *_, b, _, name in here:
                if name not in found:
                    found[name] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)), np.full(len(b[0]) if per_right else 1, -np.inf if least is None else least)]
            slack = 1e-6 + 1.3e-7 * row["dim_a"]  # of single precision and of rounding
            for i in range(0, len(x[0]), TILE):
                for j in range(0, len(y[0]), TILE):
                    # a full score cannot be beaten, only preceded
                    live = [h for h in here if per_right or not (len(found[h[4]][0][0]) == k and found[h[4]][1][0] >= 1 and h[1][0][j if h[3] else i] > found[h[4]][0][2][-1])]
                    if not live:
                        continue
                    low = np.min([found[h[4]][1][j : j + TILE] if per_right else found[h[4]][1] for h in live], axis=0)
                    at, bt = np.nonzero(x[3][i : i + TILE] @ y[3][j : j + TILE].T >= (low - slack).astype(np.float32))
                    if not len(at):
                        continue
                    va, vb = x[2][i : i + TILE], y[2][j : j + TILE]
                    cos = np.round((va @ vb.T)[at, bt] if 64 * len(at) > len(va) * len(vb) else np.einsum("ij,ij->i", va[at], vb[bt]), 6)
                    for link, a, b, flip, name in live:
                        ai, bi = (bt + j, at + i) if flip else (at + i, bt + j)
                        best, edge = found[name]
                        kept = a[1][link[0]][ai] & b[1][link[1]][bi] & (cos >= edge[bi if per_right else 0])
                        if not per_right:
                            kept &= a[0][ai] != b[0][bi]
                        if least is not None:
                            kept &= cos > least
                        if kept.any():
                            ai, bi = ai[kept], bi[kept]
                            key, c, sa, sb = (np.concatenate(z) for z in zip(best, (bi if per_right else np.zeros_like(bi), cos[kept], a[0][ai], b[0][bi]), strict=True))
                            order = np.lexsort((sb, sa, -c, key))
                            place = np.arange(len(key)) - np.searchsorted(key[order], key[order])
                            order, last = order[place < k], order[place == k - 1]
                            edge[key[last]] = c[last]
                            found[name][0] = (key[order], c[order], sa[order], sb[order])
        names = ["group_a", "group_b", "seq_a", "seq_b", "cos"]
        for name, ((_, c, sa, sb), _) in found.items():
            link = name[0] if per_right else name
            yield pa.RecordBatch.from_arrays([*[pa.array([g] * len(c), t) for g, t in zip(link, types, strict=True)], pa.array(sa), pa.array(sb), pa.array(c)], names=names)

    types = [to_arrow_type(links.schema[g].dataType) for g in ("group_a", "group_b")]
    a = packed(left, kinds[0], "a")
    b = packed(right, kinds[1], "b")
    a = a.crossJoin(F.broadcast(links.agg(F.collect_list(F.struct("group_a", "group_b")).alias("links"))))
    holds = lambda x, y: F.exists("links", lambda z: F.array_contains(f"groups_{x}", z["group_a"]) & F.array_contains(f"groups_{y}", z["group_b"]))
    meets = (F.col("dim_a") - F.col("dim_b") == 0) & holds("a", "b")  # no equality of columns: it would deal pairs by that key
    if same:
        meets = (F.col("dim_a") - F.col("dim_b") == 0) & (F.struct(F.col("home_a").alias("h"), F.col("own_a").alias("o")) <= F.struct(F.col("home_b").alias("h"), F.col("own_b").alias("o"))) & (holds("a", "b") | holds("b", "a"))
    return a.join(b, meets).mapInArrow(meet, f"group_a {kinds[0]}, group_b {kinds[1]}, seq_a long, seq_b long, cos double")


def clusters(rows: DataFrame, seed_rows: DataFrame, near: int = 24, most: int = 8, least: int = 3) -> DataFrame:
    """Members of each seed's cluster, all seeds at once.

    rows and seed_rows: seq, thread, ts, content, embedding. Blocks of seeds meet blocks of rows as vectors; texts
    are fetched for the nearest of each seed only.
    """
    s = seed_rows.select(*[F.col(c).alias(f"seed_{c}") for c in ("seq", "thread", "ts", "content", "embedding")])
    side = lambda df: df.select(F.array(F.lit(0)).alias("groups"), F.col("seq").cast("long").alias("seq"), F.col("embedding").alias("v"))
    links = rows.sparkSession.range(1).select(F.lit(0).alias("group_a"), F.lit(0).alias("group_b"))
    by_seed = Window.partitionBy("seed_seq")
    found = nearest(side(rows), side(seed_rows), links, near, per_right=True).select(F.col("seq_b").alias("seed_seq"), F.col("seq_a").alias("seq"), "cos")
    few = found.withColumn("n", F.row_number().over(by_seed.orderBy(F.desc("cos"), "seq"))).where(F.col("n") <= near).select("seed_seq", "seq").distinct()
    cos = F.round(V.cosine(V.as_doubles(F.col("embedding")), V.as_doubles(F.col("seed_embedding"))), 6)
    pairs = few.join(rows, "seq").join(s, "seed_seq").withColumn("cos", cos)
    nearest_rows = pairs.withColumn("n", F.row_number().over(by_seed.orderBy(F.desc("cos"), "seq"))).where(F.col("n") <= near)
    if "role" in rows.columns:
        # only behind the nearest: what goes here frees no place
        nearest_rows = nearest_rows.where(~X.low_signal_mining(F.col("role"), F.col("content")))
        used = seed_rows.select("seq", F.lit(True).alias("used")).distinct()
        nearest_rows = nearest_rows.join(used, "seq", "left").where((F.col("role") != "chain") | F.col("used")).drop("used")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    a, b = words(F.col("content")), words(F.col("seed_content"))
    union = F.size(F.array_union(a, b))
    overlap = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
    days = F.abs(F.unix_micros("ts") - F.unix_micros("seed_ts")) / F.lit(86_400_000_000.0)
    score = 0.5 * F.col("cos") + F.when(F.col("thread") == F.col("seed_thread"), 0.15).otherwise(0.0) + F.when(days < 1, 0.2).when(days < 7, 0.1).otherwise(0.0) + 0.15 * overlap
    scored = nearest_rows.withColumn("score", F.round(score, 6)).withColumn("place", F.row_number().over(Window.partitionBy("seed_seq").orderBy(F.desc("score"), "seq"))).where(F.col("place") <= most)
    return scored.withColumn("size", F.count("*").over(Window.partitionBy("seed_seq"))).where(F.col("size") >= least).select("seed_seq", "seq", "cos", "score", "place")


def week(ts: Column) -> Column:
    """The Monday of the week; differences of keys are distances in days, across years too."""
    return F.to_date(F.date_trunc("week", ts))


def week_links(dated: DataFrame, days: int = 14, least: float = 0.7) -> DataFrame:
    """Pairs of weeks at a distance whose centroids agree. There are few hundred weeks in any corpus."""
    c = V.centroids(dated.withColumn("week", week(F.col("ts"))), ["week"], "embedding")
    a, b = c.select(F.col("week").alias("week_a"), F.col("centroid").alias("ca")), c.select(F.col("week").alias("week_b"), F.col("centroid").alias("cb"))
    pairs = a.join(b, F.datediff("week_b", "week_a") >= days)
    return pairs.select("week_a", "week_b", F.datediff("week_b", "week_a").alias("days"), F.round(V.cosine(F.col("ca"), F.col("cb")), 3).alias("similarity")).where(F.col("similarity") >= least)


def chunk_links(dated: DataFrame, weeks: DataFrame, least: float = 0.5, k: int = 3) -> DataFrame:
    """The k most similar pairs of entries of each linked pair of weeks, a vector counted once in its week."""
    # first without vectors' being sorted, as an aggregate of them would
    once = dated.select(F.col("seq").cast("long").alias("seq"), week(F.col("ts")).alias("week"), F.col("embedding").alias("v")).distinct()
    side = once.groupBy("seq", "v").agg(F.collect_set("week").alias("groups"))
    links = weeks.select(F.col("week_a").alias("group_a"), F.col("week_b").alias("group_b"))
    scored = nearest(side, side, links, k, least).select(F.col("group_a").alias("week_a"), F.col("group_b").alias("week_b"), "seq_a", "seq_b", "cos")
    w = Window.partitionBy("week_a", "week_b").orderBy(F.desc("cos"), "seq_a", "seq_b")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _parts(spark: SparkSession, rows: int) -> int:
    """Shares of so many rows: of ROWS each, smaller ones while there are cores for them."""
    return max(-(-rows // ROWS), min(spark.sparkContext.defaultParallelism, -(-rows * 16 // ROWS)), 1)


def overlapping_chains(chains: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of chains whose member sets overlap by more than the share. Candidates share a member, and the rarest
    half of a set suffices to find one that overlaps so much.

    Sizes and 64 hashed bits of either set tell nearly all other candidates where they are made; only the sets of
    those left are compared.
    """
    parts = _parts(chains.sparkSession, chains.count())
    m = chains.select("chain", "member").where("chain is not null and member is not null").repartition(parts, "member").distinct()
    by_chain = Window.partitionBy("chain")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("member"), F.lit(64)).cast("int"))
    freq = m.withColumn("f", F.count("*").over(Window.partitionBy("member"))).repartition(parts, "chain")
    sized = freq.withColumns({"size": F.count("*").over(by_chain), "bits": F.bit_or(bit).over(by_chain), "r": F.row_number().over(by_chain.orderBy("f", "member"))})
    # more than least of the union is as much of the set itself: so many members shared, one of them among the others' rarest
    whole = F.floor(F.col("size") * least)
    shared = F.when(whole / F.col("size") > least, whole).otherwise(whole + 1)
    prefix = sized.where(F.col("r") <= F.col("size") - shared + 1).select("chain", "member", "size", "bits").repartition(parts, "member")
    x, y = (prefix.select("member", F.col("chain").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    most = F.least(*[F.col(f"size_{c}") - F.bit_count(F.col(f"bits_{c}").bitwiseAND(F.bitwise_not(f"bits_{o}"))) for c, o in ("ab", "ba")])
    p = x.join(y, "member").where((F.col("a") < F.col("b")) & (most / (F.col("size_a") + F.col("size_b") - most) > least)).select("a", "b").distinct()
    named = p.select(F.explode(F.array("a", "b")).alias("chain")).distinct()
    sets = m.join(named, "chain", "left_semi").groupBy("chain").agg(F.collect_set("member").alias("s"))
    both = p.join(sets.select(F.col("chain").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("chain").alias("b"), F.col("s").alias("sb")), "b")
    score = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return both.select("a", "b", F.round(score, 6).alias("jaccard")).where(score > least)


def xrefs(chains: DataFrame) -> DataFrame:
    """(member, chain or co-member) edges: each member refers to its chains and to all it shares one with.

    A task gets some ROWS of them, however many there are; a member's edges lie in one.
    """
    spark = chains.sparkSession
    n = chains.groupBy("chain").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    parts = _parts(spark, n)
    m = chains.select("chain", "member").repartition(parts, "chain").distinct()
    to_chain = m.select("member", F.concat(F.lit("c"), F.col("chain").cast("string")).alias("ref"))
    other = m.join(m.select("chain", F.col("member").alias("o")), "chain").where("member <> o").select("member", F.concat(F.lit("m"), F.col("o").cast("string")).alias("ref"))
    return to_chain.unionByName(other).repartition(parts, "member").distinct()


def xref_sets(edges: DataFrame) -> DataFrame:
    """(member, refs): the sorted references of each member."""
    return edges.groupBy("member").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def project_counts(rows: DataFrame) -> DataFrame:
    """Entries of each thread, less chains, kernels and those without a thread."""
    return rows.where(~F.col("role").isin("chain", "kernel") & (F.coalesce("thread", F.lit("")) != "")).groupBy("thread").agg(F.count("*").alias("n"))


def project_chains(chains: DataFrame) -> DataFrame:
    """Chains of each project, by the chains' member_projects."""
    return chains.select(F.explode(F.array_distinct("member_projects")).alias("thread")).where("thread <> ''").groupBy("thread").agg(F.count("*").alias("chains"))


def temporal_chains(dated: DataFrame, links: DataFrame, weeks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Chain entries of the linked pairs: one for each pair of members, the first week pair that has it, less pairs that
    a known chain holds. dated: seq, content, thread; links: of chunk_links; known: chain, member.

    Two sets of two members overlap by more than half only if they are equal; with a known chain they do if it has no
    more than one member beside them.
    """
    pair = links.select("week_a", "week_b", F.least("seq_a", "seq_b").alias("x"), F.greatest("seq_a", "seq_b").alias("y"), "seq_a", "seq_b", "cos")
    first = Window.partitionBy("x", "y").orderBy("week_a", "week_b", F.desc("cos"))
    new = pair.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    if known is not None:
        sized = known.distinct().withColumn("size", F.count("*").over(Window.partitionBy("chain"))).where("size <= 3")
        sets = sized.groupBy("chain").agg(F.array_sort(F.collect_set("member")).alias("s")).select(F.explode(F.expr("filter(flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a as x, b as y)))), p -> true)")).alias("p"))
        new = new.join(sets.select("p.x", "p.y").distinct(), ["x", "y"], "left_anti")
    side = lambda c: dated.select(F.col("seq").alias(f"seq_{c}"), F.substring("content", 1, 80).alias(f"head_{c}"), F.col("thread").alias(f"thread_{c}")).dropDuplicates([f"seq_{c}"])
    days = F.datediff("week_b", "week_a")
    out = new.join(side("a"), "seq_a").join(side("b"), "seq_b").join(weeks.select("week_a", "week_b"), ["week_a", "week_b"], "left_semi")
    return out.select(
        F.lit("chain").alias("role"),
        F.concat(F.lit("Temporal link ("), days.cast("string"), F.lit("d): "), F.coalesce("head_a", F.lit("")), F.lit(" ↔ "), F.coalesce("head_b", F.lit(""))).alias("content"),
        F.coalesce("thread_a", F.lit("unknown")).alias("thread"),
        F.concat(F.lit("temporal: "), F.col("week_a").cast("string"), F.lit(" ↔ "), F.col("week_b").cast("string")).alias("heading"),
        F.lit("temporal_link").alias("chain_type"),
        F.array(F.col("seq_a").cast("string"), F.col("seq_b").cast("string")).alias("member_uids"),
        F.array_sort(F.array_distinct(F.filter(F.array("thread_a", "thread_b"), lambda x: F.coalesce(x, F.lit("")) != ""))).alias("member_projects"),
        (~F.col("thread_a").eqNullSafe(F.col("thread_b"))).alias("cross_project"),
        days.alias("temporal_distance_days"),
        F.round("cos", 3).alias("similarity"),
    )


def minable(rows: DataFrame) -> DataFrame:
    """What temporal links look at: dated entries with vectors that are no chains and not of low signal."""
    return rows.where(F.col("embedding").isNotNull() & F.col("ts").isNotNull() & (F.col("role") != "chain") & ~X.low_signal_mining(F.col("role"), F.col("content")))


def kernel_refs(kernels: DataFrame, chains: DataFrame) -> DataFrame:
    """(kernel, chain): the references that are chains, in their order."""
    each = kernels.select("kernel", F.posexplode("refs").alias("pos", "chain"))
    return each.join(chains.select("chain").distinct(), "chain").select("kernel", "pos", "chain")


#: The order of a report's sections, and the types of chains that it lists.
SECTIONS = ("orphan", "correction", "stress", "pattern", "growth", "question")
CHAIN_TYPES = ("thematic", "causal", "correction", "orphan", "temporal_link")


def kernels_shown(kernels: DataFrame, chains: DataFrame) -> DataFrame:
    """Kernels of the known kinds in the report's order, with the chains that they refer to, comma-joined; a kernel
    without any stays. Missing or zero importance counts as 5, a missing kind as pattern."""
    order = F.array(*map(F.lit, SECTIONS))
    matched = kernel_refs(kernels, chains).groupBy("kernel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chain"))), lambda x: x["chain"]), ",").alias("chains"))
    rows = kernels.withColumns({"kind": F.coalesce("kind", F.lit("pattern")), "importance": F.coalesce(F.nullif("importance", F.lit(0)), F.lit(5))}).where(F.array_contains(order, F.col("kind")))
    place = F.row_number().over(Window.orderBy(F.array_position(order, F.col("kind")), F.desc("importance"), "kernel"))
    return rows.join(matched, "kernel", "left").select("kernel", "kind", "importance", F.coalesce("chains", F.lit("")).alias("chains"), place.alias("place"))


def chains_by_type(chains: DataFrame) -> DataFrame:
    """(bucket, chain): chains in the report's buckets: by type, those across projects, and orphans as unfinished."""
    kind = F.coalesce("chain_type", F.lit("thematic"))
    buckets = F.array(F.when(kind.isin(*CHAIN_TYPES), kind), F.when(F.col("cross_project"), F.lit("cross_project")), F.when(kind == "orphan", F.lit("unfinished")))
    return chains.select(F.explode(F.array_compact(buckets)).alias("bucket"), "chain")


def report_rows(chains: DataFrame, members: DataFrame, kernels: DataFrame, stats: DataFrame) -> DataFrame:
    """(section, value): the report as JSON objects: stats as profile, kernels, and the chains of each bucket.

    chains: chain, chain_type, cross_project, content; members: of report(); kernels: of kernels_shown().
    """
    shown = chains_by_type(chains).join(chains.select("chain", "content"), "chain").join(members, "chain", "left")
    parts = [
        stats.select(F.lit("profile").alias("section"), F.to_json(F.struct("*")).alias("value")),
        kernels.select(F.lit("kernels"), F.to_json(F.struct(*kernels.columns))),
        shown.select("bucket", F.to_json(F.struct("chain", "content", "members", "threads"))),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def synthesis_lines(chains: DataFrame) -> DataFrame:
    """(chain, line): what a synthesis is asked about: id, type, content, number of members and their projects."""
    projects = F.array_join(F.array_sort(F.filter("member_projects", lambda p: p != "")), ", ")
    line = F.concat(F.lit("["), F.col("chain").cast("string"), F.lit("] ("), F.coalesce("chain_type", F.lit("thematic")), F.lit(") "), "content", F.lit(" ["), F.size("member_uids").cast("string"), F.lit(" members, projects: "), projects, F.lit("]"))
    return chains.select("chain", line.alias("line"))


def project_total(chains: DataFrame) -> DataFrame:
    return chains.select(F.explode("member_projects").alias("p")).where("p <> ''").agg(F.countDistinct("p").alias("projects"))


def thread_mode(members: DataFrame) -> DataFrame:
    """The most frequent thread of each chain; ties go to the smaller name."""
    n = members.groupBy("chain", "thread").agg(F.count("*").alias("n"))
    return n.groupBy("chain").agg(F.min_by("thread", F.struct(-F.col("n"), F.col("thread"))).alias("primary_thread"))


def report(chains: DataFrame, rows: DataFrame) -> DataFrame:
    """Per chain: members in order with their threads and first characters; unmatched members stay with empty fields."""
    joined = chains.join(rows.select(F.col("seq").alias("member"), "thread", F.substring("content", 1, 40).alias("head")), "member", "left")
    item = F.struct("pos", F.concat_ws(":", F.col("member").cast("string"), F.coalesce("thread", F.lit("")), F.coalesce("head", F.lit(""))).alias("x"))
    return joined.groupBy("chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]), "|").alias("members"), F.countDistinct("thread").alias("threads"))
