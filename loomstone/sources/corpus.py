"""Readers of corpora, and adapters from tables to the one corpus schema (seq, role, content, thread, ts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions import text as X
from loomstone.operators import chunking, extract

CORPUS_SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n == "turn" else T.StringType()) for n in ("uid", "role", "content", "turn", "ts", "thread", "source_session", "source_uuid", "source_file", "heading", "chunk_type")])
CHAIN_SCHEMA = "uid string, role string, content string, ts string, thread string, heading string, chain_type string, member_uids array<string>, member_projects array<string>, cross_project boolean, dream_pass int, dream_run string, temporal_distance_days int, similarity double"
SESSION_SCHEMA = "type string, message struct<role: string, content: string>, timestamp string, sessionId string, uuid string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as context entries; undated."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit("context").alias("role"), F.col("text").alias("content"), F.col("source").alias("thread"), F.lit(None).cast("timestamp").alias("ts"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated log entries, in UTC."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.lit("user").alias("role"), F.concat_ws(" ", "event_type", "props").alias("content"), F.col("user_id").cast("string").alias("thread"), F.col("ts").cast("timestamp").alias("ts")
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns; seq orders them within a thread."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, line, value): lines of files under a folder or of one file, numbered from 0 within each file."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    # a file's splits may lie in any order of partitions, but lines within a split do not
    place = F.row_number().over(Window.partitionBy("path").orderBy("block", "at"))
    return rows.select("path", (place - 1).cast("long").alias("line"), "value")


def new_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines of grown files behind those that are known. known: path, n (lines seen so far); other files are new in whole."""
    return lines.join(known.groupBy("path").agg(F.max("n").alias("n")), "path", "left").where(F.col("line") >= F.coalesce("n", F.lit(0))).drop("n")


def records(lines: DataFrame) -> DataFrame:
    """Session records of lines: (path, seq, type, role, raw, ts, source_session, source_uuid); blank and malformed lines go."""
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", SESSION_SCHEMA)).where(F.col("r.type").isNotNull())
    return parsed.select("path", F.col("line").alias("seq"), F.col("r.type").alias("type"), F.coalesce("r.message.role", "r.type").alias("role"), F.coalesce("r.message.content", F.lit("")).alias("raw"), F.col("r.timestamp").alias("ts"), F.col("r.sessionId").alias("source_session"), F.col("r.uuid").alias("source_uuid"))


def blocks_of(raw: Column) -> Column:
    """A content's list of blocks; null where it is text."""
    return F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, extract.BLOCKS))


def session_entries(lines: DataFrame, project: str | None = None) -> DataFrame:
    """Entries of session logs: users and assistants, with turns counted by user rows before low-signal ones go.

    A user's text stays as it is, lists in their JSON form; an assistant's blocks become text. Project: the given one, or
    the folder's.
    """
    rows = records(lines).where(F.col("type").isin("user", "assistant"))
    order = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("turn", F.sum((F.col("role") == "user").cast("long")).over(order))
    blocks = blocks_of(F.col("raw"))
    content = F.when((F.col("role") == "user") | blocks.isNull(), F.col("raw")).otherwise(extract.block_text(blocks))
    thread = F.lit(project) if project is not None else extract.project_of(F.col("path"))
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    out = rows.select("path", "seq", "role", content.alias("content"), "turn", F.coalesce("ts", F.lit("")).alias("ts"), thread.alias("thread"), F.coalesce("source_session", stem).alias("source_session"), F.coalesce("source_uuid", F.lit("")).alias("source_uuid"))
    return out.where(~X.low_signal_ingest(F.col("role"), F.col("content")))


def read_sessions(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """Entries of the session logs under a folder, or of one file, less those of sub-agents."""
    return session_entries(read_lines(spark, path).where(~F.contains("path", F.lit("subagent"))), project)


def conversation_turns(lines: DataFrame) -> DataFrame:
    """(path, seq, role, content, ts) of what was said: users' texts and text blocks, assistants' texts that are no summaries."""
    rows = records(lines).where(F.col("type").isin("user", "assistant"))
    blocks = blocks_of(F.col("raw"))
    said = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.trim(F.coalesce(b["text"], F.lit(""))) != "")), lambda b: b["text"]), "\n")
    text = F.when(blocks.isNull(), F.col("raw")).when(F.col("role") == "user", said).otherwise(extract.transcript_text(blocks))
    out = rows.select("path", "seq", "role", text.alias("content"), "ts").where(X.trimmed(F.col("content")) != "")
    return out.where((F.col("role") == "user") | ((F.col("role") == "assistant") & ~F.startswith("content", F.lit("["))))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus JSON lines; malformed ones are dropped."""
    return spark.read.schema(CORPUS_SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """Chains of a corpus with their members; an empty folder has none."""
    return spark.read.schema(CHAIN_SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path).where("role = 'chain'")


def read_whole_files(spark: SparkSession, path: str, globs: str = "*", most_bytes: int | None = None) -> DataFrame:
    """(path, text) of files, up to a size if one is given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(path)
    files = files if most_bytes is None else files.where(F.col("length") <= most_bytes)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def read_head(spark: SparkSession, path: str, most: int = 16_000) -> DataFrame:
    """(path, text): the first characters of files, as an action shows them."""
    return read_whole_files(spark, path).select("path", F.substring("text", 1, most).alias("text"))


def below(path: Column, root: str) -> Column:
    """A file's path under a root."""
    return F.substring(F.regexp_replace(path, r"^[a-z]+:/+", "/"), len(root.rstrip("/")) + 2, 1 << 20)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, project, text) of project notes and plans: files with the notes' name, or under a folder of plans. The
    project is the folder's path under the root, home at its top."""
    files = read_whole_files(spark, path, "*.md").withColumn("own", below(F.col("path"), path))
    project = F.regexp_extract("own", r"^(.*)/[^/]*$", 1)
    kept = files.where(F.col("own").rlike(r"(^|/)CLAUDE\.md$") | F.contains("own", F.lit("plans/")))
    return kept.select("path", F.when(project == "", "home").otherwise(project).alias("project"), "text")


def markdown_entries(files: DataFrame) -> DataFrame:
    """One context entry for each section of the files (path, project, text); turn 0, undated."""
    cut = chunking.markdown_sections(files.select(F.struct("path", "project").alias("seq"), F.col("text").alias("content")))
    return cut.select("seq.path", F.col("section").alias("pos"), F.lit("context").alias("role"), "content", F.lit(0).alias("turn"), F.lit("").alias("ts"), F.col("seq.project").alias("thread"), F.col("seq.path").alias("source_file"), "heading")


def code_entries(files: DataFrame, project: str) -> DataFrame:
    """One code entry for each chunk of the files (path, content)."""
    numbered = files.withColumn("seq", F.xxhash64("path"))
    chunks = chunking.source_chunks(numbered)
    return chunks.select("pos", F.lit("code").alias("role"), "content", F.lit(0).alias("turn"), F.lit("").alias("ts"), F.lit(project).alias("thread"), "heading", "chunk_type")


def static_sources(spark: SparkSession, sources: list[str]) -> DataFrame:
    """(seq, path, content) of globs, files and folders (markdown below them), in the given order and then by path."""
    fs = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for i, source in enumerate(sources):
        where = spark._jvm.org.apache.hadoop.fs.Path(source)
        if "*" in source or "?" in source:
            found = [s.getPath().toString() for s in fs(where).globStatus(where) or [] if s.isFile()]
        elif fs(where).exists(where):
            found = [source]
        else:
            found = []
        if found:
            folder = "*" not in source and "?" not in source and fs(where).getFileStatus(where).isDirectory()
            rows = spark.read.option("wholetext", "true")
            rows = (rows.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md") if folder else rows).text(found)
            parts.append(rows.select(F.lit(i).alias("source"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    if not parts:
        return spark.range(0).select(F.col("id").alias("seq"), F.lit("").alias("path"), F.lit("").alias("content"))
    # a handful of files
    return reduce(DataFrame.unionByName, parts).select((F.row_number().over(Window.orderBy("source", "path")) - 1).cast("long").alias("seq"), "path", "content")


def mangled(path: Column) -> Column:
    """A working directory as a folder name: slashes become dashes, with one in front."""
    name = F.replace(path, F.lit("/"), F.lit("-"))
    return F.when(F.startswith(name, F.lit("-")), name).otherwise(F.concat(F.lit("-"), name))
