"""Repeated strings beside a plain version that keeps every window of every text in a dictionary."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import queries
from tidemark.llm import suffix_dedup as sd


def brute(rows, length=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(hash(t[k : k + length]) for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if times[hash(t[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(bytes(gone).replace(b"\0", b" ").split())
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def found(df, how=sd.Repeats()):
    return Counter(tuple(r) for r in sd.digest(df, how).collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    out = queries.QUERIES["op12_suffix_dedup"](spark, folder)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert Counter(map(tuple, out.collect())) == brute(rows)


def planted(seed, n=120):
    """Texts with passages around the length, shared by two or many, whole, with changes, overlapping and side by side."""
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passages = [noise(rng.choice((60, 63, 64, 65, 90, 130, 200))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + "é" + p[k + 1 :]
            parts += [noise(rng.choice((0, 0, 3, 50))), p[rng.choice((0, 0, 1, 20)) :]]
        rows.append((i, "".join(parts)))
    return [*rows, (n, "x" * 300), (n + 1, "x" * 63), (n + 2, "ab" * 200), (n + 3, "x" * 300), (n + 4, "abc" * 21 + "a")]


@pytest.mark.parametrize("group", [1 << 15, 1])
def test_planted_passages(spark, group):
    for seed in range(4 if group > 1 else 2):
        rows = planted(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert found(df, sd.Repeats(length=64, group=group, filter_bits=1 << 18)) == brute(rows, 64)


def test_a_full_bitmap_changes_no_result(spark):
    rows = planted(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, sd.Repeats(length=64, filter_bits=1 << 4)) == brute(rows, 64)


def test_hard_rows(spark):
    rows = [(r[0], r[1]) for r in cases.ROWS if r[1] != cases.LONG]
    docs = cases.documents(spark)
    assert found(docs.where(F.length("text").isNull() | (F.length("text") < 1_000_000))) == brute(rows)
    out = sd.digest(docs).collect()
    assert [(r[2], r[3]) for r in out if r[0] == 6] == [(len(cases.LONG), 1)] and len(out) == len(cases.ROWS)
    assert sd.digest(cases.empty(spark)).count() == 0


def test_blocks_make_the_same_anchors(monkeypatch):
    rng = random.Random(5)
    text = bytes(rng.choice(b"abc d") for _ in range(5000))
    whole = sd.anchors(text, 400).tolist()
    monkeypatch.setattr(sd, "BLOCK", 37)
    assert sd.anchors(text, 400).tolist() == whole and len(whole) < 100
    for s in range(0, 4601, 7):  # the anchor of a window is that of the window alone
        assert s <= sd.anchors(text[s : s + 400], 400)[0] + s and sd.anchors(text[s : s + 400], 400)[0] + s in whole


def test_multikey_quicksort():
    rng = random.Random(3)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    assert [keys[i] for i in sd.multikey_order(keys)] == sorted(keys)
    assert sd.common(b"abc", b"abd") == 2 and sd.common(b"", b"a") == 0 and sd.common(b"\0a", b"\0a") == 2
