"""Registered queries: a Spark callable and, where SQL can say the same, an oracle text."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


class Inputs:
    """The tables of one folder, and inputs derived from them by SQL that reads the same in both engines."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {name: self.table(name) for name in TABLES if "{" + name + "}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def files(self) -> dict[str, str]:
        return {name: f"{self.folder}/{name}.parquet" for name in TABLES}


def plain(text: str) -> str:
    """An input text as the oracle's engine reads it: tables under their own names."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under a name."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
