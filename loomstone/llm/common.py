"""Helpers shared by the training-data operators: shared-folder tables, connected components, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a map turns into Python objects at once.
PART_ROWS = 512
#: Bytes of an Arrow batch between the JVM and a worker, and of a staged table's row groups.
BATCH_BYTES = 4 << 20
ROW_GROUP_BYTES = 32 << 20


#: Paths of the tables that were staged and not deleted yet.
STAGED: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines see; unset, a temporary one on a single machine only."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = getattr(shared_root, "own", None) or tempfile.mkdtemp(prefix="loomstone-")
        shared_root.own = root
        root = f"file://{root}"
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomstone_path = path
    STAGED.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in STAGED:
        STAGED.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_loomstone_path", None):
            delete(table.sparkSession, path)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what was staged from that place of STAGED on, once no result that reads it is needed any more."""
    for path in STAGED[since:]:
        if path != getattr(keep, "_loomstone_path", None):
            delete(spark, path)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, so that long texts do not add up in a worker's memory."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != f"{BATCH_BYTES}b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give memory that earlier work in this reused worker has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries keep and trim
        ctypes.CDLL(None).malloc_trim(0)


def with_columns_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """Append columns computed per Arrow batch; an input column of the same name gives way to the new one.

    make() runs once in each task and returns the function from a batch to the new columns.
    """
    names = {f.name.lower() for f in fields}
    kept = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in names])
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        fn = make()
        for whole in batches:
            # parts of a batch, so that few texts are Python strings at once
            for at in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(at, PART_ROWS)
                new = fn(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[new[f.name] for f in fields]], names=[*batch.schema.names, *[f.name for f in fields]])
        tidy()

    return arrow_map(kept, run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by the keys; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != (rows[i - 1] if i else last):
                if i > start:
                    held.append(batch.slice(start, i - start))
                    start = i
                if held:
                    yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(start))
        last = rows[-1]
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over the rows of one block; the smaller number is the root."""
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b), a > b, are stars around their smallest node: no a has two edges or is a b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the undirected long edges (a, b); component is the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each a few joins and aggregates of
    fixed width; a node's neighbours are never collected. Each round is a written table, and stars need no other:
    a round's plans cost the driver as much for a few edges as for many.
    """
    e = stage(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )
    rounds = 0
    while not are_stars(e):
        if rounds == max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
        rounds += 1
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above the node go to the smallest of its neighbourhood
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its lower neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = stage(small, name)
        discard(e)
        e = nxt
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
