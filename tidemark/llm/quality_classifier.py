"""A supervised quality classifier over hashed subword vectors.

Every word (of at most ``LONGEST_WORD`` bytes) and every run of three and of four bytes of a text is hashed to one of
``buckets`` learned vectors; their mean
goes through a softmax over the two classes. Vectors and output weights are learned by stochastic gradient descent in
numpy, on a sample of labelled rows that the parameters bound: at most ``per_class`` rows of each class, the first in the
order of a seeded hash, none longer than ``longest`` characters. Scoring is linear in the mean, so a trained model is one
number per bucket and a bias (its size is fixed), sent to the tasks; every whole text is scored in the task that reads it.

Labels of rows whose crc32(doc_id as text) mod 3 is 1 are never learned from. Ids, language, source and labels are no inputs
of a score. The sample is balanced, so the bias is moved by the log odds that all learnable labels show.

Weights are summed as whole multiples of ``UNIT``, so a score depends on the text alone, not on batches or partitions.

Cases: null and empty texts get the score of the bias alone. Texts beyond ``BLOCK`` bytes are scored in stretches that see
over their ends, so all runs and words count once. Documents with contradicting labels are not learned from; repeated rows are scored each. With
no labels of one class the score is the share of label 1 (0.5 without any labels). An empty table gives an empty result.
Only ``doc_id`` and ``text`` are read, so extra columns can't clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import in_small_batches, slices, text_of

BLOCK = 1 << 17  # bytes whose features are made at a time: a dozen arrays of eight times as many
LONGEST_WORD = 256
UNIT = 2.0**-24
PAD = b"\n\n\n\n"
SCORES = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Training:
    """Parameters. ``per_class`` and ``longest`` bound the training sample."""

    per_class: int = 4000
    longest: int = 60_000
    buckets: int = 1 << 18
    dim: int = 8
    epochs: int = 6
    rate: float = 1.0
    seed: int = 13


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per bucket, the difference of the classes' logits
    bias: float

    @cached_property
    def steps(self) -> np.ndarray:
        """The weights as whole multiples of ``UNIT``, whose sums are exact in any order."""
        return np.rint(self.weights.astype(np.float64) / UNIT).astype(np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for owners, starts, ends, data in blocks(texts):
            for places, buckets in features(data, len(self.weights)):
                summed = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.steps[buckets])])
                low, high = np.searchsorted(places, starts), np.searchsorted(places, ends)
                np.add.at(total, owners, summed[high] - summed[low])
                np.add.at(count, owners, high - low)
        logits = total * UNIT / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several texts side by side, padded so that no run reaches from one into the next: owner, start and end of
    each stretch, and the bytes. A stretch of a longer text comes with the byte before it and those after it that runs and
    words of its places reach."""
    stretches, held = [], 0

    def packed():
        offsets = np.cumsum([0] + [len(b) + len(PAD) for _, _, _, b in stretches])[:-1] + len(PAD)
        starts = offsets + np.array([before for _, before, _, _ in stretches])
        data = np.frombuffer(PAD + b"".join(b + PAD for _, _, _, b in stretches), np.uint8)
        return np.array([i for i, _, _, _ in stretches]), starts, starts + np.array([n for _, _, n, _ in stretches]), data

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(data), BLOCK):
            before = min(at, 1)
            stretches.append((i, before, min(BLOCK, len(data) - at), data[at - before : at + BLOCK + LONGEST_WORD + 1]))
            held += stretches[-1][2]
            if held >= BLOCK:
                yield packed()
                stretches, held = [], 0
    if stretches:
        yield packed()


def _mixed(x: np.ndarray, buckets: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def features(data: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and buckets of the runs of three, those of four, and the words."""
    wide = data.astype(np.uint64)
    three = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16)
    places = np.arange(len(three))
    yield places, _mixed(three, buckets)
    yield places, _mixed(three | wide[3:] << np.uint64(24) | np.uint64(1 << 40), buckets)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # padded with blanks, so edges come in pairs
    starts, ends = edges[::2], edges[1::2]
    short = ends - starts <= LONGEST_WORD
    starts, ends = starts[short], ends[short]
    # a word's hash is that of its bytes alone: the sum of byte times power, moved back to the power 0
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
    yield starts, _mixed((summed[ends] - summed[starts]) * _powers(_INVERSE, len(data))[starts] ^ np.uint64(1 << 41), buckets)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2 to the 64."""
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def train(texts: Iterable[str], labels: list[int], odds: float, training: Training = Training()) -> Model:
    """A model from a bounded sample; ``odds`` is the share of label 1 divided by that of label 0 among all labels."""
    rng = np.random.default_rng(training.seed)
    vectors = rng.uniform(-1 / training.dim, 1 / training.dim, (training.buckets, training.dim)).astype(np.float32)
    output = rng.uniform(-1, 1, (training.dim, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    held, times, ends = array("i"), array("I"), [0]  # side by side, so that the driver gets the memory back
    for text in texts:
        found = [
            buckets[np.searchsorted(places, start) : np.searchsorted(places, end)]
            for _, starts, stops, data in blocks([text])
            for start, end in zip(starts, stops, strict=True)
            for places, buckets in features(data, training.buckets)
        ]
        seen, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        held.frombytes(seen.astype(np.int32).tobytes())
        times.frombytes(counts.astype(np.uint32).tobytes())
        ends.append(len(held))
    all_seen, all_times = np.frombuffer(held, np.int32), np.frombuffer(times, np.uint32)
    rows = list(zip(ends, ends[1:], strict=False))
    steps, done = training.epochs * len(rows), 0
    for _ in range(training.epochs):
        for i in rng.permutation(len(rows)):
            rate = training.rate * (1 - done / steps)
            done += 1
            seen = all_seen[slice(*rows[i])]
            share = (all_times[slice(*rows[i])] / max(1, all_times[slice(*rows[i])].sum())).astype(np.float32)
            hidden = share @ vectors[seen]
            logits = hidden @ output + offset
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[labels[i]] -= 1
            back = output @ wrong
            # a step moves the logits by less than the rate, however long the text and large the weights
            step = rate / (1 + hidden @ hidden + np.square(output).sum())
            output -= step * np.outer(hidden, wrong)
            offset -= step * wrong
            vectors[seen] -= step / (share @ share) * np.outer(share, back)
    positive = sum(labels)
    prior = np.log(odds) - np.log(positive / (len(labels) - positive))
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(offset[1] - offset[0] + prior))


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Learn from the labelled rows of ``docs`` outside the held-out fold."""
    clear = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    clear = clear.where("quality = most and quality in (0, 1) and doc_id is not null").where(~held_out()).drop("most")
    counts = {r["quality"]: r["count"] for r in clear.groupBy("quality").count().collect()}  # two rows at most
    zero, one = counts.get(0, 0), counts.get(1, 0)
    share = one / (zero + one) if zero + one else 0.5
    flat = Model(np.zeros(training.buckets, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not zero or not one:
        return flat
    order = F.xxhash64(F.lit(training.seed), "doc_id")
    short = docs.select("doc_id", text_of("text").alias("text")).where(F.length("text") <= training.longest)
    known = clear.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    first = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(training.per_class) for q in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # at most 2 * per_class ids
    sample = short.join(chosen, "doc_id").dropDuplicates(["doc_id"]).collect()
    sample.sort(key=lambda r: r["doc_id"], reverse=True)
    found = [r["quality"] for r in reversed(sample)]
    if len(set(found)) < 2:
        return flat
    return train((sample.pop()["text"] for _ in range(len(sample))), found, one / zero, training)  # a text goes when read


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), text_of("text").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCORES.split(", ")]
        for batch in slices(batches):
            scores = sent.value.scores(batch[2].to_pylist())
            predicted = pa.array((scores >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(scores), predicted], names)

    return in_small_batches(rows).mapInArrow(task, SCORES)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = sent.value.scores([t or "" for t in batch[at].to_pylist()])
            yield batch.filter(pa.array(scores >= least))

    return in_small_batches(docs).mapInArrow(task, docs.schema)
