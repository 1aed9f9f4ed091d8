"""The index of a corpus: vectors, all metadata, distinct identifiers; and freshness of what was built before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import identify

METADATA = ("seq", "role", "content", "thread", "ts", "heading", "chunk_type")
#: What a code base's reader takes and skips.
CODE_SUFFIXES = ("py", "js", "ts", "jsx", "tsx", "sh", "bash", "html", "css", "json", "yaml", "yml", "toml", "go", "rs", "java", "c", "cpp", "h")
SKIPPED_FOLDERS = ("__pycache__", "node_modules", ".git", ".venv", "venv", "dist", "build", ".next", ".cache", "vendor", ".tox", "egg-info", ".eggs", ".mypy_cache", ".pytest_cache")


def build(corpus: DataFrame, path: str) -> dict[str, int]:
    """Write the three tables; returns the totals."""
    corpus.select(*[c for c in METADATA if c in corpus.columns]).write.mode("overwrite").parquet(f"{path}/metadata")
    if "embedding" in corpus.columns:
        corpus.where(F.col("embedding").isNotNull()).select("seq", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    identify.index(corpus).write.mode("overwrite").parquet(f"{path}/identifiers")
    embedded = F.count("embedding") if "embedding" in corpus.columns else F.lit(0)
    total, vectors = corpus.agg(F.count("*"), embedded).first()
    return {"total": total, "embedded": vectors, "keyword_only": total - vectors}


EMPTY = {"metadata": "seq long, role string, content string, thread string, ts timestamp", "vectors": "seq long, embedding array<float>", "identifiers": "identifier string"}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the index; an empty one where it was never built."""
    if not exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], EMPTY[name])
    return spark.read.parquet(f"{path}/{name}")


def newest(spark: SparkSession, path: str):
    """The time of the newest file below a folder; None where there is none."""
    if not exists(spark, path):
        return None
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.max("modificationTime")).first()[0]


def read_codebases(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(project, path, content) of the source files of named folders."""
    parts = [read_codebase(spark, path).select(F.lit(name).alias("project"), "path", "content") for name, path in folders.items()]
    return reduce(DataFrame.unionByName, parts)


def read_codebase(spark: SparkSession, path: str, most_bytes: int = 500_000) -> DataFrame:
    """(path, content) of source files; skipped folders and those whose name starts with a dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring(F.regexp_replace("path", r"^[a-z]+:/+", "/"), len(path.rstrip("/")) + 1, 1 << 20)
    folders = F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1)
    skipped = F.exists(folders, lambda x: x.isin(*SKIPPED_FOLDERS) | F.startswith(x, F.lit(".")))
    suffix = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return files.where((F.col("length") <= most_bytes) & suffix.isin(*CODE_SUFFIXES) & ~skipped).select("path", F.decode("content", "UTF-8").alias("content"))


def changed(spark: SparkSession, path: str, since) -> DataFrame:
    """Files of a folder that are newer than a time."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return meta.where(F.col("modificationTime") > F.lit(since)).select("path", "modificationTime")


def latest_session(spark: SparkSession, path: str, prefix: str = "") -> str | None:
    """The session file with that name, else the latest whose name starts so, else the latest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    name = F.regexp_extract("path", r"([^/]*)\.jsonl$", 1)
    rank = F.when(name == prefix, 2).when(F.startswith(name, F.lit(prefix)), 1).otherwise(0)
    row = files.select("path", rank.alias("r"), "modificationTime").agg(F.max_by("path", F.struct("r", "modificationTime", "path")).alias("path")).first()
    return row.path
