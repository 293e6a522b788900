"""Texts wait for Python in small batches, whatever the caller's session says, and that session stays as it is."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tidemark.llm import ngram_join
from tidemark.llm import quality_classifier as qc
from tidemark.llm.shared import in_small_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def flat(spark, docs):
    return qc.fit(docs, cases.labels(spark))


@pytest.mark.parametrize(
    "operator",
    [
        lambda spark, docs: ngram_join.keep_one(docs),
        lambda spark, docs: ngram_join.linked_components(docs),
        lambda spark, docs: corpus_pipeline.packing_stage(spark, docs, ""),
        lambda spark, docs: qc.keep_good(docs, flat(spark, docs)),
        lambda spark, docs: qc.with_scores(docs, flat(spark, docs)),
    ],
)
def test_operators_hand_over_little_at_once(spark, operator):
    before = spark.conf.getAll
    out = operator(spark, cases.documents(spark).select("doc_id", "text"))
    assert out.sparkSession.conf.get(KEY) == "1m"
    assert spark.conf.getAll == before
    assert spark.catalog.listTables("global_temp") == []


def test_batches_are_small_and_rows_whole(spark):
    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400).alias("text"))
    found = in_small_batches(docs).mapInArrow(task, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 9000 and max(r["bytes"] for r in found) < 2 << 20


def test_other_settings_follow_and_frames_meet(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        docs = cases.documents(spark)
        small = in_small_batches(docs)
        assert small.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3"
        assert small.schema == docs.schema and small.exceptAll(docs).count() == docs.exceptAll(small).count() == 0
        assert docs.join(small.select("doc_id"), "doc_id").count() == small.join(docs.select("doc_id"), "doc_id").count() == 11
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
