"""The prefix trie beside a plain version that keeps every prefix in a dictionary."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, said), role, text))
    own = {c: [r[1:] for r in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest())
        for k, m in members.items()
    )


def found(df, how=pt.Trie()):
    return Counter(map(tuple, pt.prefix_nodes(df, how).collect()))


def made(seed, convs=60, turns=14):
    rng = random.Random(seed)
    texts = ["", "yes", "no", "Ünï 😀", None, "a longer text of some words", "x:1"]
    rows = []
    for c in rng.sample(range(-150, 500), convs):
        start = rng.choice((0, 0, 3))
        for t in range(rng.choice((0, 1, 2, 5, turns))):
            rows.append((c, start + t if rng.random() < 0.95 else None, rng.choice(("user", "user", None, "assistant")), rng.choice(texts[: rng.choice((1, 2, 7))])))
    whole = [(t, "user", rng.choice(texts)) for t in range(turns)]
    for c in (700, 701, 702, 801, 801 + 100):
        rows += [(c, *t) for t in whole]
    return rows + rng.choices(rows, k=20) + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("width", [1 << 21, 1 << 3])
def test_equals_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(pt, "STRETCH", 4)
    for seed in (1, 2):
        rows = made(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(6)
        assert found(df, pt.Trie(width=width)) == brute(rows)


def test_one_long_conversation_among_copies(spark, monkeypatch):
    monkeypatch.setattr(pt, "STRETCH", 64)
    rows = [(c, t, "user", f"turn {t}") for c in (5, 300, 777) for t in range(700)] + [(9, t, "user", f"turn {t}") for t in range(350)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_many_ends_at_one_node(spark):
    df = spark.range(30_000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    out = pt.prefix_nodes(df)
    assert found(df) == brute([(c, 0, "user", "hi") for c in range(30_000)]) and out.count() == 2


def test_hard_rows(spark):
    rows = [(1, 0, "user", cases.LONG), (1, None, None, None), (2, 0, "user", cases.LONG), (None, None, None, None), (100, 1, "", "")]
    clashes = [F.lit(f"own {c}").alias(c) for c in ("depth", "a", "b", "said", "rank", "part", "place", "owner", "length")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *clashes)
    assert found(df) == brute(rows)
    assert pt.prefix_nodes(df.where("1 = 0")).count() == 0


def test_the_sketch_leaves_few_rows_to_group(spark):
    turns = pt.staged(pt.numbered(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")), "numbered")
    rows = pt.screened(pt.staged(pt.paths(turns, pt.Trie()), "paths"), pt.Trie())
    shared = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n")).first()[0]
    assert shared <= rows.where("maybe").count() <= 1.01 * shared + 5 < rows.count()
