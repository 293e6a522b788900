"""Removal of every byte that lies in a string of ``length`` bytes found anywhere else too, by sorted suffixes.

Not every suffix is sorted. The windows of ``length`` bytes are told apart by their anchor, the place of the least hash of
``GRAM`` bytes inside the window, the first of equals: windows with equal bytes have their anchor at the same distance. An
anchor's windows are those that hold the half window after it, and those that hold the half window before it. That half (with the
anchor) is a row's core; its leading token is the core's hash; its context is what the windows hold on the left and the right of it.
Two rows with one core share a window exactly if the bytes common to their left and right sum up to ``length`` less the core.

1. Tokens of all anchors are counted; those of a single place are done with. A bitmap of fixed size (``filter_bits``) of the
   others tells the second scan which rows to make. Bits set for two tokens cost rows, not results.
2. A task sends a context's bytes once, and a row of places for each occurrence. Contexts with two occurrences are repeated
   whole. This keeps the interior of a passage in very many documents from being gathered.
3. Contexts are dealt by ranges of tokens with sampled splitters (``repartitionByRange``) and sorted. In a bucket, each token's
   suffixes, and its prefixes read backwards, are sorted by multikey quicksort; common lengths of neighbours give classes at every
   depth, and rows that agree in a class of both share a window. Equal tokens have one range, so no comparison is left
   across a boundary, but for tokens with more than ``group`` contexts: these are not gathered; each window of theirs becomes a
   hash of 128 bits, and Spark counts those in any number of tasks.
4. Each occurrence gets its context's reach to both sides. A text's removed runs are the union; only texts with some kept and
   some removed bytes are shuffled, to meet their runs.

Equal texts are told by their SHA-256. Those of ``length`` bytes and more that occur twice are removed whole.

Cases: null texts are empty; texts below ``length`` bytes keep all. Rows without or with repeated ids count as documents of
their own. Very long texts are scanned in blocks; a stretch that repeats a short pattern makes one row for its whole run.
Repeated rows remove each other. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bitmap, slices, staged, text_of

GRAM = 16
BLOCK = 1 << 16  # window starts that are hashed at a time
MOST_SEEN = 100_000  # digests that a task remembers
_PLACE = np.uint64((1 << 20) - 1)


@dataclass(frozen=True)
class Repeats:
    """Parameters. ``group`` contexts of one token are compared in one task at most; ``filter_bits`` is a power of two."""

    length: int = 400
    group: int = 1 << 15
    filter_bits: int = 1 << 25

    def __post_init__(self):
        if self.length < 2 * GRAM:
            raise ValueError(f"length must be {2 * GRAM} or more")

    @property
    def half(self) -> int:
        return self.length // 2


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place on."""
    wide = data.astype(np.uint64)
    for step in (1, 2, 4):
        wide = wide[:-step] | wide[step:] << np.uint64(8 * step)
    mixed = wide[:-8] * np.uint64(0x9E3779B97F4A7C15) + (wide[8:] ^ wide[8:] >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    return mixed


def anchors(text: bytes, length: int) -> np.ndarray:
    """The places of all anchors, ascending."""
    data, width = np.frombuffer(text, np.uint8), length - GRAM + 1
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(text) - length + 1, BLOCK):
        starts = min(BLOCK, len(text) - length + 1 - at)
        least = _hashes(data[at : at + starts - 1 + length])
        least = least & ~_PLACE | np.arange(len(least), dtype=np.uint64)  # of equal hashes the first is least
        size = 1
        while 2 * size <= width:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        least = np.minimum(least[:starts], least[width - size : width - size + starts])
        found.append(np.unique(least & _PLACE).astype(np.int64) + at)
    return np.unique(np.concatenate(found))


def cores(places: np.ndarray, n: int, how: Repeats) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Both kinds of cores of a text of ``n`` bytes: kind, starts, ends, and the bytes that a window holds beyond its core."""
    after = places[places + how.half <= n]
    yield 0, after, after + how.half, how.length - how.half
    before = places[places >= how.half]
    yield 1, before - how.half, before + GRAM, how.length - how.half - GRAM


def _tokens(text: bytes, kind: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(
        (digest(text[a:b], kind) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)
    )


class _Seen(set):
    """Digests seen lately; forgetting one only repeats work."""

    def new(self, digest: bytes) -> bool:
        if digest in self:
            return False
        if len(self) >= MOST_SEEN:
            self.clear()
        self.add(digest)
        return True


def _long_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """Print and bytes of each text, once where a task meets it again."""
    seen = _Seen()
    for batch in slices(batches, 64):
        for print, text in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()).to_pylist(), strict=True):
            if seen.new(print):
                yield print, text


def tokens(texts: DataFrame, how: Repeats) -> DataFrame:
    """``token, place`` of every core of ``texts (print, text)``; ``place`` is a hash of where it is."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def batch() -> pa.RecordBatch:
            columns = [np.concatenate(c).view(np.int64) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "place"])

        for print, text in _long_texts(batches):
            own, places = np.uint64(int.from_bytes(print[:8], "little")), anchors(text, how.length)
            for kind, starts, ends, _ in cores(places, len(text), how):
                for at in range(0, len(starts), BLOCK):
                    part = slice(at, at + BLOCK)
                    held.append((_tokens(text, kind, starts[part], ends[part]), own + starts[part].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    rows += len(held[-1][0])
                    if rows >= BLOCK:
                        yield batch()
                        held, rows = [], 0
        if held:
            yield batch()

    return texts.mapInArrow(task, "token long, place long")


FOUND = (
    "print binary, start long, stop long, in_left int, in_right int, run int, token long, need int, context binary, left binary, right binary"
)
_KINDS = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
_FOUND = [(c.split()[0], _KINDS[c.split()[1]]) for c in FOUND.split(", ")]


def occurrences(texts: DataFrame, bits: np.ndarray, how: Repeats) -> DataFrame:
    """A row per core whose token has its bit in ``bits``; consecutive ones with equal contexts make one row.

    ``left`` is read backwards from the core; both sides are null where the task has sent the context before.
    """
    sent, last = texts.sparkSession.sparkContext.broadcast(bits), np.uint64(how.filter_bits - 1)

    def rows_of(print: bytes, text: bytes, seen: _Seen) -> Iterator[tuple]:
        n = len(text)
        for kind, starts, ends, need in cores(anchors(text, how.length), n, how):
            found = _tokens(text, kind, starts, ends)
            at = (found & last).astype(np.int64)
            keep = np.flatnonzero((sent.value[at >> 3] >> (at & 7)) & 1)
            row = None
            for start, end, token in zip(starts[keep].tolist(), ends[keep].tolist(), found[keep].view(np.int64).tolist(), strict=True):
                left, right = text[max(0, start - need) : start], text[end : end + need]
                if len(left) + len(right) < need:
                    continue
                context = xxhash.xxh3_128_digest(b"%d %d %s%s" % (token, len(left), left, right))
                if row and row[8] == context and start <= row[2] + len(left) + len(right):
                    row = (*row[:2], end, *row[3:5], row[5] + 1, *row[6:])
                    continue
                if row:
                    yield row
                new = seen.new(context)
                row = (print, start, end, len(left), len(right), 1, token, need, context, left[::-1] if new else None, right if new else None)
            if row:
                yield row

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = _Seen(), []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _FOUND, strict=True)], [n for n, _ in _FOUND])

        for print, text in _long_texts(batches):
            for row in rows_of(print, text, seen):
                rows.append(row)
                if len(rows) >= 4096:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    return texts.mapInArrow(task, FOUND)


def multikey_order(keys: list[bytes], word: int = 8) -> list[int]:
    """Indexes of ``keys`` in ascending order, by three-way quicksort on ``word`` bytes at a time."""
    order, stack = [], [(list(range(len(keys))), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) == 1 or depth is None:
            order += rows
            continue
        pivot = keys[rows[len(rows) // 2]][depth : depth + word]
        less, same, more = [], [], []
        for i in rows:
            part = keys[i][depth : depth + word]
            (same if part == pivot else less if part < pivot else more).append(i)
        if more:
            stack.append((more, depth))
        stack.append((same, depth + word if len(pivot) == word else None))
        if less:
            stack.append((less, depth))
    return order


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common from the start."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def reaches(lefts: list[bytes], rights: list[bytes], need: int) -> list[tuple[int, int] | None]:
    """For each of the rows of a core how far the windows that it shares with another one reach to the left and the right.

    Rows share a window with ``l`` bytes on the left if they agree in ``l`` bytes there and in ``need - l`` on the right.
    """
    n = len(lefts)
    if n == 2:
        left, right = common(*lefts), common(*rights)
        return [(left, right) if left + right >= need else None] * 2
    sides = []
    for keys in (lefts, rights):
        order = multikey_order(keys)
        lcps = np.array([common(keys[a], keys[b]) for a, b in zip(order, order[1:], strict=False)], np.int64)
        sides.append((np.array(order), lcps, np.array([len(k) for k in keys])))

    def classes(side: int, depth: int) -> np.ndarray:
        order, lcps, _ = sides[side]
        found = np.zeros(n, np.int64)
        found[order[1:]] = np.cumsum(lcps < depth)
        return found

    most, least = np.full(n, -1), np.full(n, -1)
    for left in sorted({*sides[0][1].tolist(), *(need - sides[1][1]).tolist()}):
        rows = np.flatnonzero((sides[0][2] >= left) & (sides[1][2] >= need - left))
        keys = (classes(0, left) * n + classes(1, need - left))[rows]
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        rows = rows[times[inverse] > 1]
        most[rows] = left
        least[rows[least[rows] < 0]] = left
    return [(int(m), need - int(s)) if m >= 0 else None for m, s in zip(most, least, strict=True)]


REACH = "context binary, l int, r int"


def _reach_batch(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    kinds = (pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["context", "l", "r"])


def compare_buckets(contexts: DataFrame) -> DataFrame:
    """``context, l, r`` of the contexts that share a window with another one of their token, bucket by bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, need, group, out = None, 0, {}, []

        def solved() -> None:
            if len(group) > 1:
                lefts, rights = ([sides[k] for sides in group.values()] for k in (0, 1))
                out.extend((c, *r) for c, r in zip(group, reaches(lefts, rights, need), strict=True) if r)

        for batch in slices(batches, 4096):
            for t, n, context, left, right in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if t != token:
                    solved()
                    token, need, group = t, n, {}
                group[context] = (left, right)
            if out:
                yield _reach_batch(out)
                out.clear()
        solved()
        yield _reach_batch(out)

    rows = contexts.select("token", "need", "context", "left", "right")
    return rows.repartitionByRange("token").sortWithinPartitions("token", "context").mapInArrow(task, REACH)


def compare_windows(contexts: DataFrame) -> DataFrame:
    """The same for any number of contexts of one token: every window by its hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for token, need, context, left, right in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for at in range(max(0, need - len(right)), min(need, len(left)) + 1):
                    digest = xxhash.xxh3_128_digest(b"%d %d %s %s" % (token, at, left[:at], right[: need - at]))
                    rows.append((digest, context, at, need))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["window", "context", "at", "need"])

    rows = contexts.select("token", "need", "context", "left", "right").dropDuplicates(["context"])
    windows = staged(rows.mapInArrow(task, "window binary, context binary, at int, need int"), "windows")
    ends = windows.groupBy("window").agg(F.min("context").alias("a"), F.max("context").alias("b"))
    shared = windows.join(ends.where("a <> b").select("window"), "window", "left_semi")
    return shared.groupBy("context").agg(F.max("at").alias("l"), F.max(F.col("need") - F.col("at")).alias("r"))


def repeated_runs(texts: DataFrame, how: Repeats) -> DataFrame:
    """``print, start, stop`` of stretches of ``texts (print, text)`` that are repeated; they overlap, and may come twice."""
    counted = tokens(texts, how).groupBy("token").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    shared = staged(counted.where("a <> b").select("token"), "shared")
    bits = bitmap(shared, F.pmod("token", F.lit(how.filter_bits)), how.filter_bits)
    found = staged(occurrences(texts, bits, how), "found")

    contexts = found.where("left is not null")
    sizes = contexts.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > how.group)
    hot = staged(sizes.select("token"), "hot")
    some_hot = bool(hot.take(1))
    reach = compare_buckets(contexts.join(hot, "token", "left_anti") if some_hot else contexts)
    if some_hot:
        reach = reach.unionByName(compare_windows(contexts.join(hot, "token", "left_semi")))
    places = F.xxhash64("print", "start")
    twice = found.groupBy("context").agg(F.min(places).alias("a"), F.max(places).alias("b"), F.max("run").alias("run"))
    whole = F.lit(how.length)
    twice = twice.where("a <> b or run > 1").select("context", whole.alias("l"), whole.alias("r"))
    reach = staged(reach.unionByName(twice).groupBy("context").agg(F.max("l").alias("l"), F.max("r").alias("r")), "reach")
    spans = found.select("print", "start", "stop", "in_left", "in_right", "context").join(reach, "context")
    return spans.select(
        "print", (F.col("start") - F.least("in_left", "l")).alias("start"), (F.col("stop") + F.least("in_right", "r")).alias("stop")
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for run in runs for e in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _text_print(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def removed_runs(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """``print, runs, kept`` of the texts of ``docs`` that lose some bytes but not as copies of a whole text: ``runs`` are the
    removed ones as (start, stop), ``kept`` are the other bytes."""
    texts = docs.select(_text_print(text_of("text")).alias("print"), text_of("text").cast("binary").alias("text"))
    texts = texts.where(F.octet_length("text") >= how.length)
    spans = repeated_runs(texts, how).distinct()
    copies = texts.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    runs = spans.groupBy("print").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    runs = staged(runs.join(copies, "print", "left_anti"), "runs")
    bits = bitmap(runs, F.pmod(F.xxhash64("print"), F.lit(how.filter_bits)), how.filter_bits)
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    marked = texts.withColumn("bit", F.pmod(F.xxhash64("print"), F.lit(how.filter_bits)))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch[2].to_numpy().astype(np.int64)
            yield batch.filter(pa.array((sent.value[at >> 3] >> (at & 7)) & 1 == 1)).select([0, 1])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("print", pa.binary()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
        for batch in slices(batches, 64):
            rows = []
            for print, spans, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = merged([(s["start"], s["stop"]) for s in spans])
                rows.append({"print": print, "runs": [{"start": a, "stop": b} for a, b in found], "kept": kept_bytes(text, found)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    joined = runs.join(marked.mapInArrow(maybe, "print binary, text binary"), "print").select("print", "spans", "text")
    return joined.mapInArrow(task, "print binary, runs array<struct<start:bigint,stop:bigint>>, kept binary")


def digest(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs (doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sha = F.sha2(text_of("text").cast("binary"), 256)
    rows = staged(docs.select("doc_id", F.octet_length(text_of("text")).cast("long").alias("n_bytes"), sha.alias("sha")), "rows")
    rows = rows.withColumn("print", F.substring(F.unhex("sha"), 1, 16))
    removed = removed_runs(docs, how)
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    partly = removed.select("print", length.alias("removed"), F.size("runs").alias("spans"), F.sha2("kept", 256).alias("left_over"))
    copies = rows.where(F.col("n_bytes") >= how.length).groupBy("print").agg(F.count("*").alias("n"), F.max("n_bytes").alias("whole"))
    nothing = hashlib.sha256(b"").hexdigest()
    copies = copies.where("n > 1").select("print", F.col("whole").alias("removed"), F.lit(1).alias("spans"), F.lit(nothing).alias("left_over"))
    changed = staged(partly.unionByName(copies), "changed")
    return rows.join(changed, "print", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("left_over", "sha").alias("kept_sha256"),
    )
