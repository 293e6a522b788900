"""A corpus pipeline out of the operators of ``tidemark.llm``: every stage works on all that the one before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, ngram_join, packing, quality_classifier, quality_rules
from tidemark.llm.shared import in_small_batches, shared_folder


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality go."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go; no cutoff that costs good documents and finds no bad ones."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality_rules.Rules(spare=True))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five words, the one with the smallest id stays."""
    return ngram_join.keep_one(docs, width=5, percent=80)


#: Four fifths of the words, by weight; no document is used twice, as its copies have just been removed.
TARGETS = mixing.Targets(
    weights={"domain": {"web": 5, "code": 2, "books": 3}, "lang": {"en": 6, "fr": 2}, "source": {"src0": 2}}, percent=80, epochs=1
)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of every source, by the weights of domains, languages and sources."""
    return mixing.mix(docs, TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 2048, a row per piece."""
    return packing.pack_documents(in_small_batches(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classifier_stage),
    ("quality rules", quality_rule_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, seeded graph searches and differencing have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
