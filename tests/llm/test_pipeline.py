"""Each stage on what the stage before kept, held against a plain form of it."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import cases
from tests.llm.test_joins import brute
from tidemark.llm import mixing
from tidemark.llm import quality_classifier as qc

FOLDER = "/root/testdata/sf0.01"


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stages(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == [
        "quality classifier", "quality rules", "n-gram Jaccard join", "mixing to target weights", "packing",
    ]
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert new.columns == docs.columns and 0 < new.count() < docs.count()
            assert new.exceptAll(docs).count() == 0
        seen.append((docs, new))
        docs = new
    before, after = seen[0]
    model = qc.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = qc.with_scores(before, model).where("predicted = 1")
    assert ids(after) == ids(good)
    before, after = seen[2]
    found = brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert ids(after) == sorted(i for i, (_, c) in found.items() if c == i)
    before, after = seen[4]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == set(ids(before))


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1"), "doc_id").select(docs.columns)
    for _, stage in cp.STAGES[:2]:
        kept = stage(spark, docs, "/root/testdata/sf0.1").join(good.select("doc_id"), "doc_id").count()
        assert kept >= 0.95 * good.count()


def test_hard_rows_pass_all_stages(spark, tmp_path):
    cases.labels(spark, [(1, 1, 0), (2, 0, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (cases.documents(spark), cases.empty(spark)):
        for _, stage in cp.STAGES:
            stage(spark, docs, str(tmp_path)).count()


def test_a_document_without_an_id_is_mixed(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    chosen = mixing.choose(docs, cp.TARGETS).where("doc_id is null").agg(F.sum("copies")).first()[0]
    assert cp.mixing_stage(spark, docs, FOLDER).where("doc_id is null").count() == chosen > 0


def test_run(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
