"""Sinks: corpus tables, chains and kernels, transcripts, reports, and the corpus cleaner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators.mining import CHAIN_TYPES, SECTIONS

BUCKETS = (*CHAIN_TYPES, "cross_project", "unfinished")


def write_corpus(df: DataFrame, path: str, by: str = "thread") -> None:
    """Overwrite only the partitions that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_kernels(df: DataFrame, path: str) -> None:
    """Kernels with the default kind and importance."""
    append(df.withColumns({"kind": F.coalesce("kind", F.lit("pattern")), "importance": F.coalesce("importance", F.lit(5))}), path)


def write_transcript(df: DataFrame, path: str) -> None:
    """JSON lines of one session in order: one file, as its readers expect."""
    df.orderBy("seq").select(F.to_json(F.struct(*[c for c in df.columns if c != "seq"])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_chains(df: DataFrame, path: str) -> None:
    """Chains of an integration run, appended under their run."""
    append(df.withColumn("dream_run", F.coalesce("dream_run", F.lit("none"))), path, "dream_run")


def write_xrefs(sets: DataFrame, path: str) -> None:
    """Each member's references; the last run's replace those before."""
    sets.write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, live: str, versions: str, stamp: str) -> None:
    """Report rows (section, value) as JSON lines: the live report is overwritten, the copy under its stamp stays."""
    for path, mode in ((live, "overwrite"), (f"{versions}/{stamp}", "error")):
        rows.write.mode(mode).partitionBy("section").text(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Compressed blocks of sessions, appended."""
    append(blocks, path)


STATE = "last_run string, pass_count int, chains_created int, tokens_used long, converged boolean, corpus_mtime_at_run timestamp"


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """The one row that tells what the last integration run did."""
    names = [x.split()[0] for x in STATE.split(", ")]
    spark.createDataFrame([tuple(state.get(n) for n in names)], STATE).coalesce(1).write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str) -> dict | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(STATE).parquet(path).first().asDict()


def clean_corpus(spark: SparkSession, path: str, dry_run: bool = True) -> list[tuple[str, int, int]]:
    """(file, kept, removed) of each file of a corpus of JSON lines; unless it is a dry run, the corpus is rewritten.

    The kept lines are written beside the corpus first and then take its place, a folder for each file.
    """
    lines = flagged_lines(spark, path)
    counts = [tuple(r) for r in lines.groupBy("file").agg(F.count_if(~F.col("low")), F.count_if("low")).orderBy("file").collect()]
    if not dry_run:
        new, old = f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"
        lines.where(~F.col("low")).select("file", "value").write.mode("overwrite").partitionBy("file").text(new)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not (fs.rename(hadoop(path), hadoop(old)) and fs.rename(hadoop(new), hadoop(path))):
            raise OSError(f"{new} could not take the place of {path}")
        fs.delete(hadoop(old), True)
    return counts


def flagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, low) of the lines that are not blank; lines that are no JSON are not low."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("file")).where(F.trim("value") != "")
    entry = F.from_json("value", "role string, content string")
    low = F.when(F.col("e.content").isNull() & F.col("e.role").isNull(), False).otherwise(X.low_signal_clean(F.coalesce("e.role", F.lit("")), F.col("e.content")))
    return lines.withColumn("e", entry).select("file", "value", low.alias("low"))


def cleaned(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines to keep, counts) of a corpus of JSON lines: low-signal entries go, lines that are no JSON stay."""
    flagged = flagged_lines(spark, path)
    return flagged.where(~F.col("low")).select("value"), flagged.agg(F.count_if(~F.col("low")).alias("kept"), F.count_if("low").alias("removed"))


def markdown_report(kernels: DataFrame, most: int = 10, chains: DataFrame | None = None) -> str:
    """The first kernels of each section by importance, sections in fixed order, and then the first chains of each bucket
    (bucket, chain, content). At most `most` rows a section are collected."""
    order = Window.partitionBy("kind").orderBy(F.desc("importance"), "content")
    rows = kernels.where(F.col("kind").isin(*SECTIONS)).withColumn("importance", F.coalesce(F.nullif("importance", F.lit(0)), F.lit(5))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    out = []
    found = rows.orderBy("kind", "r").collect()
    for section in SECTIONS:
        own = [r.content for r in found if r.kind == section]
        out += [f"## {section}", *(f"- {c}" for c in own), ""] if own else []
    if chains is not None:
        first = chains.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("chain"))).where(F.col("r") <= most).orderBy("bucket", "r").collect()
        for bucket in BUCKETS:
            own = [r.content for r in first if r.bucket == bucket]
            out += [f"## {bucket} chains", *(f"- {c}" for c in own), ""] if own else []
    return "\n".join(out)
