"""Corpus pipeline: language, near duplicates, personal data, mixture and packing, each stage on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import language, minhash, mixing, packing, pii
from loomstone.llm.common import STAGED, discard, release, stage

#: A document whose best language has hardly more than the share of chance, one by the number of languages, is rejected.
LEAST_TIMES_CHANCE = 1.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; one without a label gets the predicted one. Null and letterless texts go."""
    model = language.train(docs)
    judged = language.identify(docs.select(F.struct("*").alias("row"), "text"), model)
    # with one language there is no choice to be sure of
    least = min(LEAST_TIMES_CHANCE / max(len(model.languages), 1), 1.0)
    kept = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least))
    return kept.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred"))).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest id, nulls last; repeated ids and null ids are rows of their own."""
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = minhash.near_duplicates(rows, "_row").select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    first = rows.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min(order).alias("first")).select("first._row")
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each span of personal data becomes its kind's name."""
    found = pii.find_pii(docs, redact=True)
    return found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their rate says: most once, hardly ever where they are toxic."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of binary length with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: Models and signatures are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES[:-1]:
        since = len(STAGED)
        before, docs = docs, stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, keep=docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
