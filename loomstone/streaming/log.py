"""The append-only log as a stream: incremental reads, and idle gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental(spark: SparkSession, path: str, schema: str, sink: str, checkpoint: str) -> DataFrame:
    """Append what is new in the folder since the last call to the sink table, once; returns the sink."""
    stream = spark.readStream.schema(schema).json(path)
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


def sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Runs of a thread's events with no gap of that length, batch or streaming (with a watermark set by the caller)."""
    return events.groupBy("thread", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("thread", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def due(newest_session, last_run, now, idle_seconds: int = 900, gap_seconds: int = 3600) -> bool:
    """May an integration run start? Sessions rest for a while, the last run lies back, and something is new since then."""
    if newest_session is None:
        return False
    rested = (now - newest_session).total_seconds() >= idle_seconds
    return rested and (last_run is None or ((now - last_run).total_seconds() >= gap_seconds and newest_session > last_run))


def entries(new: DataFrame, at: int = 0) -> DataFrame:
    """New lines of a session file (path, line, value) as log entries of the assistant: what a turn's end captures."""
    from loomstone.sources import corpus

    return corpus.conversation_turns(new).where((F.col("role") == "assistant") & (F.col("seq") >= at))
