import hashlib
from collections import defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import mixing as mx


def share(given_, children):
    """children: name -> (weight, cap); the same sharing by repeated rounds."""
    budget, open_, left = {}, dict(children), given_
    for n, (w, _) in children.items():
        if w <= 0:
            budget[n] = 0
            del open_[n]
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, cap) in open_.items() if cap <= Fraction(w * left, total)]
        if not full:
            break
        for n in full:
            budget[n] = open_.pop(n)[1]
        left = given_ - sum(budget.values())
    if open_:
        total = sum(w for w, _ in open_.values())
        parts = {n: w * left // total for n, (w, _) in open_.items()}
        spare = left - sum(parts.values())
        for k, n in enumerate(sorted(parts)):
            budget[n] = parts[n] + (k < spare)
    return budget


def brute(rows, targets):
    """rows: (doc_id, domain, lang, source, tokens) -> copies."""
    supply = defaultdict(int)
    for _, d, l, s, n in rows:
        supply[d, l, s] += n
    weight = lambda level, name: targets.weights.get(level, {}).get(name, 1)
    levels = ("domain", "lang", "source")
    usable = lambda k, p: all(weight(levels[i], k[i]) > 0 for i in range(len(p), 3))
    cap = lambda *p: sum(v for k, v in supply.items() if k[: len(p)] == p and usable(k, p)) * targets.epochs
    total = sum(supply.values()) * targets.percent // 100
    names = lambda *p: {k[len(p)] for k in supply if k[: len(p)] == p}
    copies = {}
    domains = share(total, {d: (weight("domain", d), cap(d)) for d in names()})
    for d in names():
        langs = share(domains[d], {x: (weight("lang", x), cap(d, x)) for x in names(d)})
        for x in names(d):
            leaves = share(langs[x], {s: (weight("source", s), cap(d, x, s)) for s in names(d, x)})
            for s, budget in leaves.items():
                have = supply[d, x, s]
                whole, part = (budget // have, budget % have) if have else (0, 0)
                place = lambda i, e=whole: hashlib.md5(f"{targets.seed}|{e}|{i}".encode()).hexdigest()
                order = sorted((place(i), i, n) for i, dd, ll, ss, n in rows if (dd, ll, ss) == (d, x, s))
                at = 0
                for _, i, n in order:
                    at += n
                    copies[i] = whole + (at <= part)
    return copies


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.sampled_from("pq"), st.integers(0, 30)), min_size=1, max_size=40),
    st.integers(10, 250), st.integers(1, 3), st.dictionaries(st.sampled_from("abxyzpq"), st.integers(0, 9)),
)
def test_budgets_against_brute_force(spark, rows, percent, epochs, weights):
    targets = mx.Targets(weights={k: weights for k in ("domain", "lang", "source")}, percent=percent, epochs=epochs, seed="s")
    rows = [(i, *r) for i, r in enumerate(rows)]
    docs = spark.createDataFrame([(i, "w " * n, d, x, s) for i, d, x, s, n in rows], "doc_id long, text string, d string, lang string, source string")
    got = {r["doc_id"]: r["copies"] for r in mx.choose(docs, targets, F.col("d")).collect()}
    assert got == brute(rows, targets)


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "a", "x", "p", 10), (2, "a", "x", "q", 1000), (3, "b", "x", "p", 1000)]
    supply = spark.createDataFrame([r[1:] for r in rows], "domain string, lang string, source string, supply long")
    plan = {(r["domain"], r["source"]): r["budget"] for r in mx.allocate(supply, mx.Targets(percent=50, epochs=1)).collect()}
    assert plan == {("a", "p"): 10, ("a", "q"): 493, ("b", "p"): 502}  # 1005 tokens: 503 and 502


def test_hard_rows(spark):
    docs = cases.documents(spark)
    out = mx.mix(docs, mx.Targets(percent=100, epochs=2))
    assert out.schema == docs.schema and out.count() > 0
    once = mx.mix(docs, mx.Targets(percent=100, epochs=1))
    assert {r["doc_id"] for r in once.collect()} >= {None, 1, 2, 6, 8, 9}
    copies = mx.choose(docs, mx.Targets(percent=100, epochs=2)).where("doc_id is null").first()["copies"]
    assert once.where("doc_id is null").count() == 1 and out.where("doc_id is null").count() == copies > 0
    assert mx.mix(cases.empty(spark), mx.Targets()).count() == 0
    assert mx.choose(cases.empty(spark), mx.Targets()).count() == 0


def test_no_budget_is_lost_under_a_weight_of_zero(spark):
    rows = [("A", "en", "x", 100), ("A", "en", "y", 10), ("B", "en", "z", 1000)]
    supply = spark.createDataFrame(rows, "domain string, lang string, source string, supply long")
    budgets = lambda t: {r["source"]: r["budget"] for r in mx.allocate(supply, t).collect()}
    found = budgets(mx.Targets(weights={"source": {"x": 0}}, percent=18, epochs=1))
    assert found == {"x": 0, "y": 10, "z": 189}
    assert budgets(mx.Targets(weights={"lang": {"en": 0}}, epochs=1)) == {"x": 0, "y": 0, "z": 0}
