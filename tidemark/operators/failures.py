"""Classifying failure texts, and the details and advice that go with a failure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv

RULESETS = {"host": fv.HOST_FAILURES, "run": fv.RUN_FAILURES, "registry": fv.REGISTRY_FAILURES}

# Short advice per kind of trouble; replace by passing a table to ``with_guidance``.
ADVICE = [
    ("permission", ["Permissão"], "Check the account's rights on the target, its folders and the share."),
    ("timeout", ["Timeout"], "Check load and response times, and raise the time limits if slowness is expected."),
    ("connectivity", ["conectividade", "certificado"], "Check name resolution, routes, firewalls, ports and certificates."),
    ("credentials", ["Token"], "Renew the token and check which account authorised it."),
    ("configuration", ["template", "Variável", "matriz", "Grupo", "Ambiente", "Namespace"], "Check the configuration named in the text."),
    ("transfer", ["CIFS", "transferência", "e-mail"], "Check the share, its path and the free space."),
    ("limits", ["Limite"], "Raise the limit or narrow the selection, then run again."),
    ("paths", ["Path"], "Check allowed prefixes, forbidden paths and the rule's own path."),
]
DEFAULT_ADVICE = "Read the task, the action and the message to find the cause."


def _alternatives(text: Column, alternatives: Sequence[Sequence[str]]) -> Column:
    found = F.lit(False)
    for tokens in alternatives:
        every = F.lit(True)
        for token in tokens:
            every = every & F.contains(text, F.lit(token))
        found = found | every
    return found


def category_of(text: Column, ruleset: str, task: Column | None = None) -> Column:
    """First category whose words occur in the (lower-case) text."""
    categories = RULESETS[ruleset]
    chain = None
    for i, (name, alternatives) in enumerate(categories):
        hit = _alternatives(text, alternatives)
        if ruleset == "registry" and i == 0 and task is not None:
            task_words, text_words = fv.REGISTRY_WAIT_TASK
            hit = hit | (F.contains(task, F.lit(task_words)) & F.contains(text, F.lit(text_words)))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(fv.UNCLASSIFIED)


def classify_failure(df: DataFrame, ruleset: str, text: str = "text", task: str | None = None) -> DataFrame:
    """Adds ``category``; the text is read whole, and lower-cased once."""
    lowered = df.withColumn("_lowered", F.lower(F.coalesce(text, F.lit(""))))
    at = None if task is None else F.lower(F.coalesce(task, F.lit("")))
    return lowered.withColumn("category", category_of(F.col("_lowered"), ruleset, at)).drop("_lowered")


def failure_details(df: DataFrame) -> DataFrame:
    """Messages of a failed task: one per failed item, or the task's own.

    Needs host and raw (results: array of item, failed, unreachable, msg, stderr, stdout, exception; and the same texts
    for the task itself).
    """

    def message(record: Column, default: str) -> Column:
        return F.trim(F.coalesce(record["msg"], record["stderr"], record["stdout"], record["exception"], F.lit(default)))

    none = F.lit(False)
    items = F.filter(
        F.col("raw.results"), lambda r: F.coalesce(r["failed"], none) | F.coalesce(r["unreachable"], none)
    )
    texts = F.transform(
        items,
        lambda r: F.concat(
            F.coalesce(r["item"], F.lit(fv.ITEM_LABEL_DEFAULT)),
            F.lit(": "),
            message(r, fv.FAILURE_DETAIL_DEFAULTS["item"]),
        ),
    )
    main = F.array(message(F.col("raw"), fv.FAILURE_DETAIL_DEFAULTS["main"]))
    chosen = F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, texts).otherwise(main)
    rest = [c for c in df.columns if c != "raw"]
    return df.select(*rest, F.posexplode(chosen).alias("position", "detail"))


def advice_of(category: Column) -> Column:
    chain = None
    for _, words, advice in ADVICE:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(category, F.lit(word))
        chain = F.when(hit, advice) if chain is None else chain.when(hit, advice)
    return chain.otherwise(DEFAULT_ADVICE)


def with_guidance(failures: DataFrame, guidance: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Adds advice and badge to classified failures. ``guidance`` holds one (category, text) per known category."""
    category = F.col("category")
    badge = F.when(category.isin(fv.WARN_CATEGORIES), "warn").otherwise("crit")
    if guidance is None:
        return failures.withColumns({"guidance": advice_of(category), "badge": badge})
    table = failures.sparkSession.createDataFrame(list(guidance), "category string, guidance string")
    joined = failures.join(F.broadcast(table), "category", "left")
    return joined.withColumns({"guidance": F.coalesce("guidance", F.lit(DEFAULT_ADVICE)), "badge": badge})
