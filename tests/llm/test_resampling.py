"""Importance resampling beside a plain version that splits, counts and sorts in the driver."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import importance_resampling as ir
from tidemark.llm import queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text, width, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(rows, targets, how=ir.Resampling()):
    found = [(i, *grams(t, how.width, how.buckets)) for i, t in rows]
    s = Counter(c for _, _, codes in found for c in codes)
    t = Counter(c for text in targets for c in grams(text, how.width, how.buckets)[1])
    big = (sum(s.values()) + how.buckets, sum(t.values()) + how.buckets)
    gain = lambda c: math.floor(1000 * math.log((t[c] + 1) * big[0] / ((s[c] + 1) * big[1])))
    out = []
    for i, n, codes in found:
        weight = sum(map(gain, codes)) // len(codes) if codes else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(codes), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= how.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: how.percent * len(able) // 100]
    ranked = [(*r, k) for k, r in enumerate(drawn, 1)]
    rest = Counter(out)
    rest.subtract(drawn)
    return Counter(ranked) + Counter({(*r, None): n for r, n in rest.items() if n})


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    aim = spark.read.parquet(f"{folder}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in aim.collect()])
    out = queries.QUERIES["op11_importance_resampling"](spark, folder)
    assert [c for c, _ in out.dtypes] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {kind for _, kind in out.dtypes} == {"bigint"}
    assert Counter(map(tuple, out.collect())) == Counter({(r[0], *r[2:]): n for r, n in want.items()})


def test_hard_rows_for_several_widths(spark):
    docs, aim = cases.documents(spark), spark.createDataFrame([("Quick brown fox",), (None,), ("",)], "text string")
    rows = [(r[0], r[1]) for r in cases.ROWS]
    for how in (ir.Resampling(percent=100, least_words=1), ir.Resampling(width=1, percent=50, least_words=0), ir.Resampling(width=3, buckets=100_000, percent=40, least_words=2)):
        assert got(ir.resample(docs, aim, how)) == brute(rows, ["Quick brown fox", None, ""], how)
    assert ir.resample(cases.empty(spark), aim).count() == 0
    assert got(ir.resample(docs, aim.where("1 = 0"))) == brute(rows, [])


def test_runs_at_the_ends_and_separators():
    scan = ir.Scanner(3, 1 << 30)
    for text in ("", "a", "A b", " a-b\0c ", "été ÉTÉ 12x", "one two one two one"):
        n, codes = scan(text.encode())
        words, want = grams(text, 3, 1 << 30)
        assert n == words and sorted(codes.tolist()) == sorted(want)


def test_ranks_over_many_ranges_and_ties(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(50).cast("long").alias("n_words"),
        F.when(F.col("id") % 4 > 0, F.lit(7)).otherwise(F.col("id") % 100).cast("long").alias("score"),
    ).repartition(16)
    out = ir.draw(rows, ir.Resampling(percent=60)).collect()
    drawn = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert len(out) == 30_000 and [r["rank"] for r in drawn] == list(range(1, 18_001))
    keys = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in drawn]
    left = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in out if not r["rank"]]
    assert keys == sorted(keys) and keys[-1] <= min(left)
