"""Mixing sources to target weights over a domain, language, source tree. DataFrame functions only.

The token budget goes down the tree. Among siblings it is shared by weight; a child that has too little (its documents times
``epochs``) gets all it has, and what it leaves goes to its siblings by weight. A parent's supply is what its children may
use (none for a weight of 0), so a
shortage passes to the parent's siblings only when all siblings below are used up. All shares are whole numbers: floors, and
one token more for the first children by name until nothing is left.

A leaf with budget ``b`` and supply ``s`` takes ``b div s`` whole epochs and from the next epoch the longest prefix, in the
order of md5(seed | epoch | doc_id), that fits in the rest. The prefix's end is found without sorting a leaf: sums over the
first three hex digits give the digits in which it lies, and only that 4096th of the leaf is ordered. Tokens are words.

Cases: null domain, language and source are the group ``''``. Null and empty texts have no tokens: they come with every whole
epoch, and with the prefix where their hash lies in it. Rows sharing an id share their fate; a null id counts as the id ``''``. Weights that are not given
are 1; weights of 0 and less leave a child without budget. An empty table gives no rows. Columns other than those
named are not read by ``choose``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import staged, text_of

LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Targets:
    """``weights`` per level and name; ``percent`` of all tokens is the budget; ``epochs`` bounds how often a document is used."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    percent: int = 100
    epochs: int = 4
    seed: str = "1"


def domain_of(source: str = "source") -> Column:
    """The domain that the corpus's sources belong to: by the number at the end of their names."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999")) % 3
    return F.when(number == 1, "code").when(number == 2, "books").otherwise("web")


def measure(docs: DataFrame, domain: Column) -> DataFrame:
    words = F.regexp_count(text_of("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select("doc_id", F.coalesce(domain, F.lit("")).alias("domain"), *named, words.alias("n_tokens"))


def _weight(name: str, targets: Targets) -> Column:
    """The weight of a node by the column ``name``; 0 for those that may have no budget."""
    weights = targets.weights.get(name, {})
    if not weights:
        return F.lit(1).cast("long")
    given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(name)]
    return F.greatest(F.coalesce(given, F.lit(1)), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parents: list[str], name: str, targets: Targets) -> DataFrame:
    """``nodes`` (parents, name, ``cap``, ``given``: the parent's budget) with ``budget``, the node's own."""
    big = lambda c: c.cast("decimal(38,0)")
    nodes = nodes.withColumn("w", _weight(name, targets))
    nodes = nodes.withColumn("room", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0).cast("long")))
    group = Window.partitionBy(*parents)
    poorest = group.orderBy(F.when(F.col("w") > 0, F.col("room") / F.col("w")).otherwise(F.lit(0.0)), name)
    nodes = nodes.withColumns(
        {
            "before": F.sum("room").over(poorest.rowsBetween(Window.unboundedPreceding, -1)),
            "from_here": F.sum("w").over(poorest.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("left", F.col("given") - F.coalesce("before", F.lit(0).cast("long")))
    full = big(F.col("room")) * big(F.col("from_here")) <= big(F.col("w")) * big(F.col("left"))
    nodes = nodes.withColumn("full", full)
    rest = F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(group), F.lit(0).cast("long"))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(group)
    nodes = nodes.withColumns({"rest": rest, "open": open_weight})
    part = F.expr("CAST((CAST(w AS DECIMAL(19,0)) * CAST(rest AS DECIMAL(19,0))) div CAST(open AS DECIMAL(19,0)) AS BIGINT)")
    nodes = nodes.withColumn("part", F.when(~F.col("full"), part))
    spare = F.col("rest") - F.coalesce(F.sum("part").over(group), F.lit(0).cast("long"))
    turn = F.row_number().over(Window.partitionBy(*parents, "full").orderBy(name))
    nodes = nodes.withColumns({"spare": spare, "turn": turn})
    extra = F.when(F.col("turn") <= F.col("spare"), F.lit(1)).otherwise(F.lit(0))
    budget = F.when(F.col("full"), F.col("room")).otherwise(F.col("part") + extra).cast("long")
    return nodes.select(*[F.col(c) for c in nodes.columns if c in (*LEAF, "supply", "cap")], budget.alias("budget"))


def allocate(supply: DataFrame, targets: Targets) -> DataFrame:
    """``domain, lang, source, supply, budget`` for leaves with ``supply`` tokens each."""
    # what a node can use is what its children can, so that no budget goes to a parent of none that may have it
    usable = lambda name: F.when(_weight(name, targets) > 0, F.col("cap")).otherwise(F.lit(0).cast("long"))
    leaves = supply.withColumn("cap", F.col("supply") * targets.epochs).withColumn("cap", usable("source"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("cap", usable("lang"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = supply.agg(F.coalesce(F.sum("supply"), F.lit(0).cast("long")).alias("all"))
    domains = domains.withColumn("given", F.floor(total.select("all").scalar() * targets.percent / 100).cast("long"))
    domains = _share(domains.withColumn("root", F.lit(0)), ["root"], "domain", targets)
    langs = _share(langs.join(domains.select("domain", F.col("budget").alias("given")), "domain"), ["domain"], "lang", targets)
    given = langs.select("domain", "lang", F.col("budget").alias("given"))
    return _share(leaves.join(given, ["domain", "lang"]), ["domain", "lang"], "source", targets).drop("cap")


def _decided(rows: DataFrame, ends: DataFrame, targets: Targets) -> DataFrame:
    """``rows`` (``doc_id`` and a leaf's columns) with ``copies``, from the leaves' ``whole`` epochs and ``last`` places."""
    copies = F.col("whole") + F.when(_place(targets) <= F.col("last"), 1).otherwise(0)
    return rows.join(ends, LEAF).withColumn("copies", copies.cast("long")).drop("whole", "last")


def _place(targets: Targets) -> Column:
    """A document's place in its leaf's next epoch."""
    id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{targets.seed}|"), F.col("whole").cast("string"), F.lit("|"), id).cast("binary"))


def ends_of(measured: DataFrame, targets: Targets) -> DataFrame:
    """Per leaf the ``whole`` epochs it takes and the ``last`` place that it takes of the next one. One row per leaf."""
    supply = staged(measured.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply")), "supply")
    some = F.col("supply") > 0
    plan = staged(
        allocate(supply, targets).select(
            *LEAF,
            F.when(some, F.expr("budget div nullif(supply, 0)")).otherwise(F.lit(0)).cast("long").alias("whole"),
            F.when(some, F.expr("budget % nullif(supply, 0)")).otherwise(F.lit(0)).cast("long").alias("part"),
        ),
        "plan",
    )
    ordered = measured.join(plan, LEAF).withColumn("order", _place(targets)).withColumn("digits", F.substr("order", F.lit(1), F.lit(3)))
    sums = ordered.groupBy(*LEAF, "part", "digits").agg(F.sum("n_tokens").alias("n"))
    walk = Window.partitionBy(*LEAF).orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 4096 rows at most
    over = sums.withColumn("upto", F.sum("n").over(walk)).where("upto > part")
    edges = over.groupBy(*LEAF).agg(F.min("digits").alias("edge"), F.min("upto").alias("upto"), F.min_by("n", "digits").alias("n"))
    edges = staged(edges.select(*LEAF, "edge", (F.col("upto") - F.col("n")).alias("taken")), "edges")
    near = ordered.join(edges, LEAF).where("digits = edge")
    running = Window.partitionBy(*LEAF).orderBy("order")  # rows with one hash (one id) count together
    near = near.withColumn("upto", F.col("taken") + F.sum("n_tokens").over(running)).where("upto <= part")
    last = near.groupBy(*LEAF).agg(F.max("order").alias("last"))
    ends = plan.join(edges, LEAF, "left").join(last, LEAF, "left")
    return staged(ends.select(*LEAF, "whole", F.coalesce("last", "edge", F.lit("g")).alias("last")), "ends")


def choose(docs: DataFrame, targets: Targets, domain: Column | None = None) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens`` and ``copies``, how often the document is used (0: not)."""
    measured = staged(measure(docs, domain_of() if domain is None else domain), "measured")
    chosen = _decided(measured, ends_of(measured, targets), targets)
    return chosen.select("doc_id", *LEAF, "n_tokens", "copies")


def mix(docs: DataFrame, targets: Targets) -> DataFrame:
    """The chosen rows of ``docs``, each as often as it is used, with the columns of ``docs``.

    Texts meet only the leaves' ends, one small row per leaf, so they are not shuffled while those fit a broadcast.
    """
    measured = staged(measure(docs, domain_of()), "measured")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select("doc_id", F.coalesce(domain_of(), F.lit("")).alias("domain"), *named, F.struct("*").alias("_row"))
    chosen = _decided(rows, ends_of(measured, targets), targets).where("copies > 0")
    if targets.epochs > 1:
        chosen = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return chosen.select("_row.*")
