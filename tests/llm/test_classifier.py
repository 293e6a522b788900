import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import quality_classifier as qc
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.1"
SMALL = qc.Training(per_class=300, epochs=3)


def test_held_out_accuracy(spark):
    out = queries.QUERIES["op6_quality_classifier"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r[0] == r[1] for r in rows]) >= 0.95
    assert np.mean([r[0] for r in rows if r[1] == 1]) >= 0.99  # clean documents stay
    assert out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_fold_is_crc32_of_the_id(spark):
    got = spark.range(200).select("id", qc.held_out("id").alias("h")).collect()
    assert [r["h"] for r in got] == [zlib.crc32(str(r["id"]).encode()) % 3 == 1 for r in got]


def test_scores_do_not_depend_on_batches_and_features_are_whole():
    rng = np.random.default_rng(1)
    model = qc.Model(rng.standard_normal(1 << 18).astype(np.float32), 0.3)
    texts = ["one two three", "", "x", "ünï 😀 code", "a b " * 10_000, cases.LONG]
    together = model.scores(texts)
    for text, score in zip(texts, together, strict=True):
        assert abs(model.scores([text])[0] - score) < 1e-9
    total, count = 0.0, 0
    data = np.frombuffer(qc.PAD + texts[0].encode() + qc.PAD, np.uint8)
    for places, buckets in qc.features(data, 1 << 18):
        inside = (places >= 4) & (places < 4 + len(texts[0]))
        total, count = total + model.weights[buckets[inside]].sum(), count + inside.sum()
    assert count == 13 + 13 + 3
    assert abs(together[0] - 1 / (1 + np.exp(-(total / count + 0.3)))) < 1e-6
    assert abs(together[1] - 1 / (1 + np.exp(-0.3))) < 1e-9


def test_same_words_share_a_bucket():
    data = np.frombuffer(qc.PAD + b"word other word" + qc.PAD, np.uint8)
    words = list(qc.features(data, 1 << 18))[2]
    assert words[0].tolist() == [4, 9, 15] and words[1][0] == words[1][2] != words[1][1]


def test_held_out_labels_are_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("quality", F.when(qc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = qc.fit(docs, labels, SMALL), qc.fit(docs, turned, SMALL)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_hard_rows(spark):
    docs = cases.documents(spark)
    none = qc.fit(docs, cases.labels(spark), SMALL)
    assert {r["score"] for r in qc.with_scores(docs, none).collect()} == {0.5}
    one = qc.fit(docs, cases.labels(spark, [(2, 1, 0), (9, 1, 0), (None, 0, 0), (3, 0, 0), (3, 1, 0)]), SMALL)
    assert all(r["score"] > 0.99 for r in qc.with_scores(docs, one).collect())
    both = qc.fit(docs, cases.labels(spark, [(i, i % 2, 0) for i in (1, 2, 3, 4, 5, 6, 8, 9)]), SMALL)
    out = qc.with_scores(docs, both)
    assert out.count() == len(cases.ROWS) and out.where("score is null or isnan(score)").count() == 0
    kept = qc.keep_good(docs, none)
    assert kept.schema == docs.schema and kept.count() == len(cases.ROWS)
    assert qc.keep_good(cases.empty(spark), none).count() == 0
    assert qc.with_scores(cases.empty(spark), qc.fit(cases.empty(spark), cases.labels(spark), SMALL)).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(
        spark.createDataFrame([(10**6, "word " * 150_000 + "y" * 700_000, "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    model = qc.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), SMALL)
    one = sorted(map(tuple, qc.with_scores(docs.coalesce(1), model).collect()))
    assert one == sorted(map(tuple, qc.with_scores(docs.repartition(13, "text"), model).collect()))


def test_runs_and_words_across_cuts_count_once(monkeypatch):
    rng = np.random.default_rng(2)
    model = qc.Model(rng.standard_normal(1 << 18).astype(np.float32), 0.1)
    texts = ["some words " * 30, "x" * 300 + " tail of it", "a" * 5 + " " + "b" * 260 + " c", "ü😀 " * 40]
    whole = model.scores(texts).tolist()
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(qc, "BLOCK", block)
        assert model.scores(texts).tolist() == whole


def test_features_of_a_long_text_take_little_memory():
    model, text = qc.Model(np.ones(1 << 18, np.float32), 0.0), "word " * 400_000
    model.scores(["one"])
    tracemalloc.start()
    try:
        model.scores([text])
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


def test_training_is_stable_on_uneven_samples():
    """Long and short texts, few of one class: steps stay bounded, so held-out texts are told apart at any rate up to one."""
    rng = np.random.default_rng(3)
    good, poor = [f"w{i}" for i in range(300)], [f"#{i}$" for i in range(40)]
    texts, labels = [], []
    for k in range(900):
        label = int(k % 7 > 0)
        texts.append(" ".join(rng.choice(good if label else good[:150] + poor, rng.choice((5, 60, 2000), p=(0.4, 0.5, 0.1)))))
        labels.append(label)
    for rate in (0.3, 1.0):
        model = qc.train(texts[:600], labels[:600], 6.0, qc.Training(rate=rate))
        right = (model.scores(texts[600:]) >= 0.5) == (np.array(labels[600:]) == 1)
        assert right.mean() >= 0.97 and np.isfinite(model.weights).all() and np.abs(model.weights).max() < 1000
