import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import embedding_dedup as ed
from tidemark.llm import ngram_join as nj
from tidemark.llm import queries
from tidemark.llm.shared import components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    ids, edges, holders = list(sets), [], {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            edges.append((a, b))
    return {i: (len(sets[i]), c) for i, c in union_find(ids, edges).items()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components_of_documents(spark, width, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 400, 200)]
    made = []
    for k in range(150):  # near copies of one text with one to twelve words changed, so chains reach beyond one threshold
        words = list(base)
        for at in rng.integers(0, 200, 1 + k % 12):
            words[at] = f"n{rng.integers(0, 10**6)}"
        made.append((5000 + k, " ".join(words)))
    shared = " ".join(f"s{i}" for i in range(60))  # a passage in many otherwise different texts
    made += [(6000 + k, shared + " " + " ".join(f"t{i}" for i in rng.integers(0, 10**6, 20 + k))) for k in range(100)]
    docs = docs.union(spark.createDataFrame(made, docs.schema))
    if width == 1:
        docs = docs.where("doc_id >= 5000")
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.linked_components(docs, width, percent, 1 << 15).collect()}
    assert got == brute(rows, width, percent)


def test_the_order_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    small = sorted(map(tuple, nj.linked_components(docs, sketch=1 << 15).collect()))
    assert small == sorted(map(tuple, queries.QUERIES["op10_ngram_join"](spark, "/root/testdata/sf0.001").collect()))


def test_hard_documents(spark):
    docs = cases.documents(spark)
    out = nj.linked_components(docs)
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in out.collect())
    assert [(i, c) for i, _, c in rows] == [(-1, None), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (8, 8), (9, 9)]
    assert {n for i, n, _ in rows if i in (3, 4, 5)} == {0} and {n for i, n, _ in rows if i == 9} == {1}
    kept = nj.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 8, 9]
    assert nj.linked_components(cases.empty(spark)).count() == 0 and nj.keep_one(cases.empty(spark)).count() == 0


def test_ids_with_several_texts(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(6)]
    near = [t + " one more" for t in texts]
    rows = [(1, texts[0]), (5, texts[1]), (5, texts[2]), (9, near[2]), (12, near[1]), (20, texts[3]), (21, near[3]), (21, texts[0]), (30, texts[4]), (30, texts[4]), (31, texts[5])]
    rows += [(40, texts[5]), (40, None), (None, texts[5]), (50, ""), (50, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["n_shingles"] > 0): r["component_id"] for r in nj.linked_components(docs).collect()}
    want = {1: 1, 5: 5, 9: 5, 12: 5, 20: 1, 21: 1, 30: 30, 31: 31, 40: 31}
    assert got == {(i, True): c for i, c in want.items()} | {(40, False): 40, (None, True): None, (50, False): 50}
    assert sorted((r["doc_id"] or -1) for r in nj.keep_one(docs).collect()) == [-1, 1, 5, 30, 31, 50]


def test_a_group_of_near_copies_is_not_paired_out(spark, monkeypatch):
    """Near copies with one to forty changes: most link with few others, and the pair join must not grow with their square."""
    rng, rows = np.random.default_rng(6), []
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    for k in range(600):
        words = list(base)
        for at in rng.integers(0, 300, 1 + k % 20):
            words[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(words)))
    asked = []
    probe = nj.probe
    monkeypatch.setattr(nj, "probe", lambda docs, pairs, *rest: (asked.append(pairs.count()), probe(docs, pairs, *rest))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.linked_components(docs, 4, 85, 1 << 15).collect()}
    assert got == brute(rows, 4, 85)
    assert sum(asked) < 600 * 599 / 2 / 20


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(3000, 3001), (3001, 3002), (3002, 3000), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_brute(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float) / np.abs(v).max()  # tiny and huge components
            good[i] = x / np.linalg.norm(x)
    edges = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    component = union_find([i for i, _ in rows if i is not None], edges)
    return {i: (sum(i in e for e in edges), c, c == i) for i, c in component.items()}


def test_links_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = vectors_brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.QUERIES["op9_embedding_dedup"](spark, folder).collect()}
    assert set(got) == set(want)
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.99 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_saturated_lists_copies_and_blocks(spark):
    rng = np.random.default_rng(3)
    centre, rows = rng.standard_normal(16), []
    for i in range(300):  # a dense group far beyond the longest list
        rows.append((i, (centre + 0.05 * rng.standard_normal(16)).tolist()))
    rows += [(500 + i, rows[5][1]) for i in range(40)]  # copies
    rows += [(700 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    search = ed.Search(k=4, most=8, block=64)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ed.linked(frame, search).collect()}
    assert got == vectors_brute(rows)


def planted_pairs(pairs, n, cos, seed):
    """``n`` vectors without near ones, the first ``pairs`` of which have a partner each at about ``cos``, 100000 ids on."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.standard_normal((pairs, 64))
    aside -= (aside * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    partner = cos * x[:pairs] + np.sqrt(1 - cos**2) * aside
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(100_000 + i, v.tolist()) for i, v in enumerate(partner)]


def test_isolated_pairs_just_over_the_threshold(spark):
    rows = planted_pairs(400, 10_000, 0.905, 5)
    _, classes = ed.classes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {(r["a"], r["b"]) for r in ed.neighbours(classes, ed.Search()).where("cos >= 0.9").collect()}
    assert sum((k, 100_000 + k) in found or (100_000 + k, k) in found for k in range(400)) >= 0.95 * 400


def test_the_audit_sees_lost_pairs_beside_a_dense_group(spark):
    rng = np.random.default_rng(6)
    centre, rows = rng.standard_normal(64), planted_pairs(150, 3000, 0.95, 7)
    rows += [(200_000 + i, (centre + 0.05 * rng.standard_normal(64)).tolist()) for i in range(1500)]
    _, classes = ed.classes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    dense = F.col("id") >= 200_000
    ends = classes.select(
        "id", F.when(dense, 1499).otherwise(0).cast("long").alias("links"), F.when(dense, 200_000).otherwise(F.col("id")).alias("component"),
        F.lit(0).cast("long").alias("others"), dense.alias("exact"),
    )
    assert ed.audited_recall(classes, ends, ed.Search()) == 0.0
    whole = ends.withColumn("others", F.when((F.col("id") < 150) | F.col("id").between(100_000, 100_149), 1).otherwise(0).cast("long"))
    assert ed.audited_recall(classes, whole, ed.Search()) == 1.0


def test_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
        (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (13, [1e300, 1e300]),
    ]
    schema = "vec_id long, embedding array<double>"
    frame = spark.createDataFrame(rows + [(None, [1.0, 0.0])], schema).selectExpr("*", "'x' AS unit", "1 AS id")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ed.linked(frame).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == vectors_brute(rows)
    assert ed.linked(spark.createDataFrame([], schema)).count() == 0
