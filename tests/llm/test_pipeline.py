"""The pipeline's stages, one after another."""

import corpus_pipeline

from loomstone.llm import minhash, pii
from loomstone.llm.common import stage


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, fn in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(fn(spark, docs, d), name)
        assert docs.columns == columns
        if name == "language_id":
            assert docs.count() == before.where("text is not null").count()
        if name == "near_duplicates":
            kept = {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "personal_data":
            assert docs.count() == before.count()
            assert not any(pii.base_spans(r.text) for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert out.count() > 0 and {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_near_duplicates_keep_one_row_of_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, d), (7, d), (None, a), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, a), (1, b), (None, c), (7, d), (None, None)], key=repr)


def test_row_stages_take_awkward_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, an empty table."""
    rows = [(1, "der und die " * 30, "de", "s", 1, "x"), (1, "der und die " * 30, "de", "s", 1, "x"), (2, "the of and " * 30_000, "en", None, None, None), (3, "", "en", "s", 0, "y"), (4, None, None, None, None, None), (None, "und der a.b@c.de", None, "s", 3, "z"), (6, "12 !?", "en", "s", 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, Spans string")
    said = corpus_pipeline.identify_language(spark, docs, "")
    assert said.columns == docs.columns and sorted((r.doc_id for r in said.collect()), key=repr) == [1, 1, 2, None]
    clean = corpus_pipeline.redact_personal_data(spark, docs.withColumnRenamed("Spans", "note"), "").collect()
    assert len(clean) == len(rows) and {r.doc_id: r.text for r in clean}[None] == "und der <EMAIL>" and {r.doc_id: r.n_chars for r in clean}[4] == 0
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, docs, "").collect()} == {1, 2, 3, 4, None, 6}
    for fn in (corpus_pipeline.identify_language, corpus_pipeline.redact_personal_data, corpus_pipeline.pack_sequences):
        assert fn(spark, docs.limit(0).withColumnRenamed("Spans", "note"), "").count() == 0
