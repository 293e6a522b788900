import math
import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tidemark.llm import quality_rules as qr
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(cases.documents(spark).select("doc_id", "text", "lang"))
    odd = [(100, "a b c a b c a b"), (101, "a  a\na \ta a"), (102, "l\nl \nl\n\n \nl"), (103, "a b c a b c"), (104, " x")]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string").withColumn("lang", F.lit("en")))
    for r in qr.measure(docs).select("text", "_counts").collect():
        assert tuple(r["_counts"]) == brute(r["text"]), r["text"]


def test_binomial_tail_is_exact(spark):
    cases_ = [(0, 10, 0.3), (2, 10, 0.3), (0, 3000, 0.0025), (4, 4000, 0.0025), (9, 9000, 0.0025), (700, 400_000, 0.0025)]
    for k, n, p in cases_:
        got = spark.range(1).select(qr.binomial_tail(F.lit(k).cast("long"), F.lit(n), p)).first()[0]
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)  # noqa: B023, E731
        true = math.fsum(math.exp(log(i)) for i in range(k + 1))
        assert math.isclose(got, true, rel_tol=1e-8) or (got < 1e-300 and true < 1e-300)
    assert spark.range(1).select(qr.binomial_tail(F.lit(50).cast("long"), F.lit(100), 0.3)).first()[0] == 1.0


def sample(spark, n, bad):
    """``n`` good documents, ``bad`` of them full of symbols, and as many bad ones that all are."""
    plain = " ".join(f"word{i}" for i in range(60))
    good = spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < bad, F.lit("# " * 50 + plain)).otherwise(F.lit(plain)).alias("text"),
        F.lit("en").alias("lang"), F.lit(1).alias("quality"),
    )
    poor = spark.range(n, 2 * n).select(
        F.col("id").alias("doc_id"), F.lit("* " * 20 + plain).alias("text"), F.lit("en").alias("lang"), F.lit(0).alias("quality")
    )
    return good.union(poor)


def test_cutoffs_reject_what_good_documents_never_show(spark):
    docs = sample(spark, 4000, 0)
    rows = qr.score_documents(docs, docs.select("doc_id", "quality")).groupBy(F.col("doc_id") >= 4000, "kept").count().collect()
    assert {(r[0], r["kept"]): r["count"] for r in rows} == {(False, True): 4000, (True, False): 4000}


def test_cutoffs_that_good_documents_break_are_not_used(spark):
    docs = sample(spark, 4000, 60)  # 1.5 per cent are more than the risk allows
    judged = qr.score_documents(docs, docs.select("doc_id", "quality"))
    assert judged.where("doc_id < 60 and not kept and n_repeat_words * 2 <= n_words").count() == 0


def test_few_labels_reject_nothing(spark):
    docs = sample(spark, 100, 0)
    judged = qr.score_documents(docs, docs.select("doc_id", "quality"))
    assert judged.where(F.col("kept") == F.col("base_failed")).count() == 0


def test_hard_rows(spark):
    docs = cases.documents(spark)
    out = qr.score_documents(docs, cases.labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0)]))
    rows = {(r["doc_id"], r["n_words"]): r for r in out.collect()}
    assert out.count() == len(cases.ROWS)
    assert rows[(3, 0)]["base_failed"] and not rows[(3, 0)]["kept"]
    kept = qr.keep_good(docs, cases.labels(spark))
    assert kept.schema == docs.schema
    assert {r["n_words"] for r in kept.collect()} <= {"own n_words"}
    assert qr.score_documents(cases.empty(spark), cases.labels(spark)).count() == 0
    assert qr.keep_good(cases.empty(spark), cases.labels(spark)).count() == 0


def exact_tail(k, n, p):
    """P(X <= k) with whole numbers only, ``p`` one per cent."""
    assert p == 0.01
    return Fraction(sum(math.comb(n, i) * 99 ** (n - i) for i in range(k + 1)), 100**n)


def settings(good, rules):
    """stratum -> the last safe step of the path, from (stratum, signals) of good documents."""
    path, tails = rules.path, {}
    for stratum in {s for s, _ in good}:
        own = [v for s, v in good if s == stratum]
        worst, tails[stratum] = 0, []
        for cuts in path:
            rejected = sum(any(v[name] > cut for name, cut in cuts.items()) for v in own)
            worst = max(worst, exact_tail(rejected, len(own), rules.risk) if rejected < len(own) * rules.risk else 1)
            tails[stratum].append(worst)
    left, whole = dict(tails), set()
    for stratum, own in sorted(tails.items(), key=lambda kv: (kv[1][-1], kv[0])):
        if own[-1] > rules.level / len(left):
            break
        whole.add(stratum)
        del left[stratum]
    safe = lambda s, own: [k for k, t in enumerate(own) if s in whole or t <= rules.level / len(left)]
    return {s: max(safe(s, own), default=None) for s, own in tails.items()}


def test_verdicts_against_exact_tails(spark):
    """All verdicts at sf0.1, where the cutoffs reject documents that the base rule keeps."""
    folder, rules = "/root/testdata/sf0.1", qr.Rules()
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    measured = qr.measure(docs.select("doc_id", "text", qr.stratum_of(rules).alias("s"))).drop("text")
    rows = measured.select("doc_id", "s", qr.base_failed().alias("failed"), F.struct(*[v.alias(k) for k, v in qr._signals().items()]).alias("v")).collect()
    found = {}
    for r in labels.collect():
        found.setdefault(r["doc_id"], set()).add(r["quality"])
    good = [(r["s"], r["v"]) for r in rows if found.get(r["doc_id"]) == {1} and not r["failed"]]
    last = settings(good, rules)
    want = {}
    for r in rows:
        cuts = rules.path[last[r["s"]]] if last.get(r["s"]) is not None else {}
        want[r["doc_id"]] = not r["failed"] and not any(r["v"][name] > cut for name, cut in cuts.items())
    judged = queries.QUERIES["op2_quality_rules"](spark, folder).select("doc_id", "kept", "base_failed").collect()
    assert {r["doc_id"]: r["kept"] for r in judged} == want
    assert sum(not r["kept"] and not r["base_failed"] for r in judged) > 100


def test_a_stratum_that_passes_whole_hands_its_level_on(spark):
    """320 good documents are too few for half of the level, and enough for the whole of it."""
    rules = qr.Rules(strata=("a", "b", "c"), level=0.05)
    for clean, settled in (((2000, 320), {"a": 14, "b": 14}), ((320, 320), {"a": None, "b": None})):
        frames = [sample(spark, n, 0).where("quality = 1").withColumn("doc_id", F.col("doc_id") + 10_000 * k).withColumn("lang", F.lit(lang))
                  for k, (lang, n) in enumerate(zip("ab", clean, strict=True))]
        docs = frames[0].union(frames[1])
        measured = qr.measure(docs.select("doc_id", "text", qr.stratum_of(rules).alias("_stratum"))).drop("text")
        rows = qr.calibrate(measured, docs.select("doc_id", "quality"), rules).collect()
        assert {r["_stratum"]: r["cut_symbols"] for r in rows} == {s: k if k is None else rules.path[k]["symbols"] for s, k in settled.items()}
        assert {r["good"] for r in rows} == set(clean)


def test_no_good_documents_go_for_nothing(spark, tmp_path):
    """Ten good documents of 90 symbols per mille are few enough to be rejected; the bad ones have 250."""
    docs = sample(spark, 4000, 0).where("doc_id >= 10")
    words = " ".join(f"word{i}" for i in range(60))
    few = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("# " * 6 + words).alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("quality"))
    docs = docs.union(few)
    docs.select("doc_id", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    assert qr.keep_good(docs, labels).where("doc_id >= 10").count() == qr.keep_good(docs, labels).count() == 3990
    kept = corpus_pipeline.quality_rule_stage(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(4000))
    none = labels.where("quality = 1")  # nothing bad is known: the strictest cutoffs without a loss
    assert sorted(r["doc_id"] for r in qr.keep_good(docs, none, qr.Rules(spare=True)).collect()) == list(range(4000))


def test_strata_with_bad_documents_only_have_no_cutoffs(spark):
    docs = sample(spark, 1000, 0).withColumn("lang", F.when(F.col("quality") == 1, "en").otherwise("fr"))
    measured = qr.measure(docs.select("doc_id", "text", qr.stratum_of(qr.Rules()).alias("_stratum"))).drop("text")
    for spare in (False, True):
        rows = qr.calibrate(measured, docs.select("doc_id", "quality"), qr.Rules(spare=spare)).collect()
        assert [(r["_stratum"], r["good"], r["rejected"]) for r in rows] == [("en", 1000, 0)]
