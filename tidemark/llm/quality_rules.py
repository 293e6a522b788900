"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Signals of a text (per mille of its words) are compared with cutoffs. All signals' cutoffs move together along one fixed path
from lenient to strict settings, and a text is rejected at a setting if any signal exceeds its cutoff there. A setting is used
only if labelled good documents show that it rejects few of them: for each stratum the settings are tested in order with
the exact binomial tail P(X <= rejected | n, risk), and the walk stops at the first that fails (fixed-sequence testing). The
level is shared by the strata that have such documents after Holm: a stratum whose whole path passes hands its share on to the
others. So with probability ``1 - level`` no stratum loses more than ``risk`` of its good documents beyond the base rule;
with five strata 459 good ones without a rejection are enough for a setting. That holds for every safe setting at once, so any
of them may be used: the strictest or, with ``spare``, one that rejects as many labelled bad documents and fewer good ones.

Cases: a null or empty text has no words, fails the base rule and is not kept. Null or unlisted languages share the stratum
``other``. A stratum with too few labelled good documents gets no cutoff, so nothing is rejected there beyond the base rule.
A document with contradicting labels counts as unlabelled; repeated rows are judged one by one. Empty tables give empty
results. Columns of the input other than the named ones are never read; result names are fixed, so extra columns can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import staged, text_of

SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Parameters. ``grids`` holds each signal's cutoffs per mille, from lenient to strict; ``path`` puts them side by side.

    Of the safe settings the strictest is taken; with ``spare`` the strictest of those that reject the fewest labelled good
    documents among those that reject the most bad ones.
    """

    strata: tuple[str, ...] = ("en", "fr", "de", "es")
    risk: float = 0.01
    level: float = 0.05
    grids: dict[str, tuple[int, ...]] = field(
        default_factory=lambda: {
            "symbols": (3000, 2000, 1500, 1000, 800, 600, 400, 300, 200, 150, 100, 70, 50, 30, 20),
            "dup_lines": (500, 300, 200, 150, 100, 70, 50, 30, 20, 10),
            "repeats": (500, 450, 400, 350, 300, 250, 200, 150, 100),
            "long_words": (40000, 20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000),
        }
    )
    spare: bool = False


    @property
    def path(self) -> list[dict[str, int]]:
        steps = max(len(grid) for grid in self.grids.values())
        return [{name: grid[k * len(grid) // steps] for name, grid in self.grids.items()} for k in range(steps)]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_counts`` of the five counts of every whole text. Nothing is shuffled.

    Words are parted by one space first, so windows of words are plain substrings: one expression cuts them all out.
    """
    lines = F.filter(F.split(text_of(text), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    plain = F.trim(F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " "))
    windows = F.regexp_extract_all("_plain", F.lit("(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++ "), F.lit(1))
    # where all windows differ, none need be sorted
    places = F.sequence(F.lit(0), F.size("_windows") - 1)
    some_twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.sort_array(F.arrays_zip(F.col("_windows").alias("w"), places.alias("i")))
    same = lambda x, k: F.coalesce(F.get("_ordered", k)["w"] == x["w"], F.lit(False))
    twice = F.sort_array(
        F.filter(
            F.transform("_ordered", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull()
        )
    )
    covered = F.aggregate(
        twice,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    bare = F.char_length(F.replace("_plain", F.lit(" "), F.lit("")))
    counts = F.struct(
        F.when(bare == 0, 0).otherwise(F.char_length("_plain") - bare + 1).cast("long").alias("n_words"),
        bare.cast("long").alias("word_chars"),
        F.regexp_count("_plain", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return (
        docs.withColumns({"_lines": lines, "_plain": plain})
        .withColumn("_windows", windows)
        .withColumn("_ordered", F.when(some_twice, ordered))
        .withColumn("_counts", F.explode(F.array(counts)))  # a row each: filters on counts stay above, and count once
        .drop("_lines", "_plain", "_windows", "_ordered")
    )


def stratum_of(rules: Rules, lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(*rules.strata), F.col(lang)).otherwise(F.lit("other"))


def base_failed() -> Column:
    c = F.col("_counts")
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def _signals() -> dict[str, Column]:
    c = F.col("_counts")
    per_mille = lambda n: F.floor(1000 * n / F.greatest(c["n_words"], F.lit(1))).cast("long")
    return {
        "symbols": per_mille(c["n_symbols"]),
        "dup_lines": per_mille(c["n_dup_lines"]),
        "repeats": per_mille(c["n_repeat_words"]),
        "long_words": per_mille(c["word_chars"]),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in full; 1 where ``k`` is not below the mean (no need to know more there).

    The largest term comes from a sum of logarithms, the others from ratios of neighbours, so nothing underflows.
    """
    n, up = n.cast("double"), math.log(p) - math.log1p(-p)
    first = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        n * math.log1p(-p),
        lambda s, i: s + F.log((n - i + 1) / i) + up,
    )
    below = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct(
            (s["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("term"),
            (s["sum"] + s["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(first) * below)


def calibrate(measured: DataFrame, labels: DataFrame, rules: Rules = Rules(), key: str = "doc_id") -> DataFrame:
    """One row per stratum with labelled good documents: how many there are (``good``), how many of them its setting rejects
    (``rejected``), and a column ``cut_<signal>`` each (null: no setting could be shown to be safe).

    ``measured`` has ``key``, ``_stratum`` and ``_counts``; ``labels`` has ``key`` and ``quality`` (1: good, 0: bad). Documents that
    the base rule rejects say nothing about the cutoffs and are left out.
    """
    path = rules.path
    marked = labels.groupBy(key).agg(F.min("quality").alias("_least"), F.max("quality").alias("_most"))
    marked = marked.where("_least = 1 or _least = 0 and _most = 0").select(key, (F.col("_least") == 1).alias("_good"))
    kept = measured.where(~base_failed()).select(key, "_stratum", *[v.alias(k) for k, v in _signals().items()])
    held = kept.join(marked.where(F.col(key).isNotNull()), key)
    # cutoffs only fall along the path, so a document rejected at m settings is rejected at the last m
    over = sum((F.when(_exceeds(cuts), 1).otherwise(0) for cuts in path), F.lit(0))
    tally = held.groupBy("_stratum", "_good", over.alias("over")).count()
    own = lambda good: F.collect_list(F.when(F.col("_good") == good, F.struct("over", "count")))  # noqa: E731 - at most len(path) + 1
    strata = tally.groupBy("_stratum").agg(
        F.sum(F.when(F.col("_good"), F.col("count"))).alias("n"), own(True).alias("over"), own(False).alias("bad")
    )
    strata = strata.where("n is not null")  # without good documents nothing can be shown
    steps = strata.select("_stratum", "n", "over", "bad", F.explode(F.sequence(F.lit(0), F.lit(len(path) - 1))).alias("step"))
    rejected = lambda rows: F.aggregate(
        F.filter(rows, lambda x: x["over"] >= len(path) - F.col("step")), F.lit(0).cast("long"), lambda s, x: s + x["count"]
    )
    steps = steps.withColumns({"rejected": rejected("over"), "caught": rejected("bad")})
    steps = steps.withColumn("tail", binomial_tail(F.col("rejected"), F.col("n"), rules.risk))
    walk = Window.partitionBy("_stratum").orderBy("step")
    steps = steps.withColumn("worst", F.max("tail").over(walk))
    # Holm over the strata, a handful of rows: those that pass whole, in the order of their worst tails
    whole = steps.groupBy("_stratum").agg(F.max("tail").alias("worst"))
    order = Window.orderBy("worst", "_stratum")
    m = F.count("*").over(Window.partitionBy())
    passes = whole.select("_stratum", "worst", m.alias("m"), F.row_number().over(order).alias("place"))
    passes = passes.withColumn("passes", F.when(F.col("worst") <= rules.level / (F.col("m") - F.col("place") + 1), 1).otherwise(0))
    passes = passes.withColumn("done", F.min("passes").over(order))
    left = F.col("m") - F.sum("done").over(Window.partitionBy())
    levels = passes.select("_stratum", "done", (rules.level / F.greatest(left, F.lit(1))).alias("share"))
    safe = steps.join(levels, "_stratum").withColumn("safe", (F.col("done") == 1) | (F.col("worst") <= F.col("share")))
    lost = (-F.col("rejected")).alias("lost")
    place = F.struct("caught", lost, "step", "rejected") if rules.spare else F.struct("step", "rejected")
    last = safe.groupBy("_stratum").agg(F.max("n").alias("good"), F.max(F.when(F.col("safe"), place)).alias("last"))
    cuts = [
        F.get(F.array(*[F.lit(step[name]).cast("long") for step in path]), F.col("last.step")).alias(f"cut_{name}") for name in rules.grids
    ]
    return last.select("_stratum", "good", F.col("last.rejected").alias("rejected"), *cuts)


def _exceeds(cuts: dict) -> Column:
    over = F.lit(False)
    for name, cut in cuts.items():
        over = over | F.coalesce(F.col(name) > cut, F.lit(False))
    return over


def judge(measured: DataFrame, cutoffs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``measured`` with ``_base_failed`` and ``_kept``. ``cutoffs`` has at most one row per stratum, so it is broadcast."""
    over = F.lit(False)
    for name, signal in _signals().items():
        if name in rules.grids:
            over = over | F.coalesce(signal > F.col(f"cut_{name}"), F.lit(False))
    cutoffs = cutoffs.drop("good", "rejected")
    judged = measured.join(F.broadcast(cutoffs), "_stratum", "left").withColumn("_base_failed", base_failed())
    return judged.withColumn("_kept", ~F.col("_base_failed") & ~over).drop(*[f"cut_{name}" for name in rules.grids])


def score_documents(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every row of ``docs (doc_id, text, lang)``."""
    rows = docs.select("doc_id", "text", stratum_of(rules).alias("_stratum"))
    measured = staged(measure(rows).drop("text"), "measured")
    judged = judge(measured, calibrate(measured, labels, rules), rules)
    return judged.select(
        "doc_id", *[F.col("_counts")[c].alias(c) for c in COUNTS], F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``. Texts are measured again rather than shuffled."""
    rows = docs.select("doc_id", "text", stratum_of(rules).alias("_stratum"), F.struct("*").alias("_row"))
    measured = staged(measure(rows.drop("_row")).drop("text"), "measured")
    cutoffs = staged(calibrate(measured, labels, rules), "cutoffs")
    return judge(measure(rows), cutoffs, rules).where("_kept").select("_row.*")
