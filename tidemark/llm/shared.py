"""What several operators of this subpackage share: staged tables, the ASCII lower case, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import use_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one use, below the folder that all executors share."""
    return f"{use_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of texts that wait for Python at once. Spark's own batches of 64 MB make an executor's heap grow to its limit.
BATCH = "1m"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` in a new session, whose tasks hand rows to Python in batches of ``BATCH``: the same rows, the same settings else.
    The caller's session stays as it is."""
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    own = spark.newSession()
    known = own.conf.getAll
    for key, value in spark.conf.getAll.items():
        if known.get(key) != value and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    df.createGlobalTempView(name)  # the way for a DataFrame from one session to another
    try:
        return own.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches of a task, cut so that what Python makes of a slice's texts stays small beside the heap."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bitmap(rows: DataFrame, place: Column, size: int) -> np.ndarray:
    """``size`` bits in bytes of eight, of which those at the ``place`` (0 to ``size`` - 1) of all ``rows`` are set."""
    at = rows.select((place + 1).alias("at")).where("at is not null")
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for row in parts.toLocalIterator():  # a row of 4 KB for 32,768 bits, whatever the input
        bits[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def text_of(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Only A-Z become lower case, whatever the locale and the other letters."""
    return F.translate(text, UPPER, LOWER)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of the undirected ``edges (a, b)``: the smallest node that it reaches.

    Alternates "large star" and "small star" passes: every node hands its larger (then all) neighbours the smallest one.
    Each pass is one partial minimum per node and one equi-join, so a node with very many edges is never gathered, and
    each pass ends in a staged table. Self loops count as edges to nothing. No edges give no rows. The loop ends when a
    pass changes nothing; ``max_rounds`` only guards against a defect (the number of passes is about the logarithm of the
    longest path) and raises.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = staged(edges, "edges"), None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        both = edges.union(edges.select("b", "a"))
        # minima are staged, so that both sides of the joins below come from an exchange and Spark can split a hot node
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        # large star: neighbours above the node go to the smallest of node and neighbours
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below the node, and the node itself, go to the smallest neighbour
        large = staged(large.distinct(), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = staged(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    raise RuntimeError("components did not settle")
