"""Importance resampling towards a target distribution of hashed n-grams, drawn without replacement by Gumbel keys.

Features. A text's separators are collapsed to single spaces, one before the first word and one after the last. A regular
expression whose left border is such a space and whose right border is a lookahead for one is run with ``overlapped=True``,
so a match starts at every word; its nested groups are the runs of ``width`` words, of one fewer, down to the word itself.
Each run's bytes give a CRC-32 and so one of ``buckets`` buckets. Texts are scanned once: their buckets are kept as
ascending 16-bit (or 32-bit) differences in a staged table, from which counts and weights are computed.

Weights. With s of the S raw features and t of the T target features in a bucket, its gain is
``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``; a document's weight is the floored mean gain.
Gains are ``buckets`` numbers, a parameter, whatever the input; nothing else is sent to all tasks.

Draw. Each document adds ``floor(-1000 * ln(-ln(u)))`` with u from sha256 of ``seed:doc_id``; the highest scores are drawn.
Ranks are global without a global sort in one task: counts per score (a whole number, so there are some ten thousand at most)
give the lowest score drawn, rows from there up are dealt by ranges of (score, doc_id), numbered within their range, and
shifted by the rows of the ranges before.

Cases: null and empty texts have no features, weight 0, and too few words to be drawn. Null ids are drawn by the id ``''`` and
come last among ties; rows that repeat an id are drawn each, in any order among themselves. Very long texts are scanned
whole. An empty target counts no features; an empty table gives no rows. Only ``doc_id`` and ``text`` (of the target: ``text``)
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, staged

#: A-Z become small, digits, small letters and all bytes of other letters stay, everything else is a separator.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Resampling:
    """Parameters: runs of 1 to ``width`` words, ``percent`` of the documents with ``least_words`` words or more are drawn."""

    width: int = 2
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: str = "7"

    @property
    def code(self) -> str:
        return "<u2" if self.buckets <= 1 << 16 else "<u4"


class Scanner:
    """Buckets of all runs of words of a text."""

    def __init__(self, width: int, buckets: int):
        runs = "([^ ]++)"
        for _ in range(width - 1):
            runs = f"({runs} [^ ]++)"
        self.width, self.buckets = width, buckets
        self.spans = regex.compile(f" {runs}(?= )".encode())
        self.groups = tuple(range(1, width + 1))
        self.after = b" \0" * (width - 1) + b" "  # no word holds a zero byte; runs that reach these are left out

    def __call__(self, text: bytes) -> tuple[int, np.ndarray]:
        """The number of words, and the buckets of all features in no particular order."""
        found = self.spans.finditer(b" " + b" ".join(text.translate(_WORDS).split()) + self.after, overlapped=True)
        if self.width == 1:
            codes = np.fromiter((crc32(m[1]) for m in found), np.uint32)
        else:
            codes = np.fromiter(map(crc32, chain.from_iterable(m.group(*self.groups) for m in found)), np.uint32)
        codes = codes.reshape(-1, self.width) % np.uint32(self.buckets)
        n = len(codes)  # column k holds runs of width - k words
        return n, np.concatenate([codes[: max(0, n - (self.width - k) + 1), k] for k in range(self.width)])


def features(docs: DataFrame, how: Resampling) -> DataFrame:
    """``doc_id, n_words, codes`` of every row of ``docs (doc_id, text)``."""
    schema = "doc_id long, n_words long, codes binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(how.width, how.buckets)
        for batch in slices(batches):
            words, codes = [], []
            for text in batch[1].cast(pa.binary()).to_pylist():
                n, found = scan(text or b"")
                words.append(n)
                codes.append(np.diff(np.sort(found.astype(how.code)), prepend=np.zeros(1, how.code)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(words, pa.int64()), pa.array(codes, pa.binary())], ["doc_id", "n_words", "codes"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, schema)


def _codes(column: pa.Array, how: Resampling) -> Iterator[np.ndarray]:
    for held in column.to_pylist():
        yield np.cumsum(np.frombuffer(held, how.code), dtype=how.code)


def counts(found: DataFrame, how: Resampling) -> DataFrame:
    """``bucket, n`` of all rows; each task adds up its own rows first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in slices(batches):
            for codes in _codes(batch[0], how):
                total += np.bincount(codes, minlength=how.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "n"])

    return found.select("codes").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, how: Resampling) -> DataFrame:
    """``bucket, gain`` of every bucket, from the counts of both sides."""
    of = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    all = (
        raw.sparkSession.range(how.buckets).withColumnRenamed("id", "bucket")
        .join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", of("s").alias("s"), of("t").alias("t"))
    )
    total = lambda side: F.coalesce(side.agg(F.sum("n")).scalar(), F.lit(0)).cast("double") + how.buckets
    ratio = (F.col("t") + 1) * total(raw) / ((F.col("s") + 1) * total(target))
    return all.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(found: DataFrame, gain: np.ndarray, how: Resampling) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    schema = "doc_id long, n_words long, n_features long, weight long"
    sent = found.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, weight = [], []
            for codes in _codes(batch[2], how):
                n.append(len(codes))
                weight.append(int(sent.value[codes].sum()) // len(codes) if len(codes) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[1], pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"]
            )

    return found.select("doc_id", "n_words", "codes").mapInArrow(task, schema)


def draw(scored: DataFrame, how: Resampling) -> DataFrame:
    """``scored (doc_id, n_words, score, ...)`` with ``rank``, 1 for the highest score drawn, null where not drawn."""
    scored = staged(scored.withColumn("_place", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= how.least_words)
    wanted = able.count() * how.percent // 100
    per_score = able.groupBy("score").agg(F.count("*").alias("n"))
    upto = per_score.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score"))))  # one row per whole number
    lowest = upto.where(F.col("upto") >= max(1, wanted)).agg(F.max("score")).first()[0]
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long")).drop("_place")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_place")]
    near = F.coalesce((F.col("n_words") >= how.least_words) & (F.col("score") >= lowest), F.lit(False))
    ranged = scored.where(near).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    ranked = ranged.withColumn("rank", rank.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest).drop("_place")


def resample(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs (doc_id, text)``, towards ``target (text)``."""
    found = staged(features(docs, how), "features")
    wanted = staged(features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), how), "target")
    raw, aim = staged(counts(found, how), "raw"), staged(counts(wanted, how), "aim")
    gain = np.zeros(how.buckets, np.int64)
    for row in gains(raw, aim, how).collect():  # a row per bucket
        gain[row["bucket"]] = row["gain"]
    key = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substr(key, F.lit(1), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return draw(weigh(found, gain, how).withColumn("score", F.col("weight") + noise), how)
