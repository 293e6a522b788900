"""Jaccard self-join on word shingles by T-occurrence search over inverted lists (DivideSkip), as Spark jobs.

Two sets are linked when ``100 * intersection >= percent * union``. With ``n`` shingles in a set any linked partner shares at
least ``ceil(percent * n / 100)``. A global order of all shingles, rare before frequent, splits each set into its first
``n - that + 1`` shingles, whose inverted lists are short, and the rest, whose lists are long.

1. Documents with equal sets are one class, stood for by its smallest id.
2. DivideSkip takes as many long lists as a pair's overlap T allows, T - 1 of them, so a linked pair occurs in a short list of
   both: among the first ``n - T + 1`` shingles of each, with T from both sizes. The short lists are merged by a join on the
   shingle, which Spark's sort and shuffle do in place of one heap.
3. The long lists are not merged. The pairs found are probed: the shingles of one set are searched by bisection in the other.

Large groups of near copies would meet in every short list of their common part. So first each class is compared only with
one partner, the list head (smallest id) that it meets most often; the links found make first components. Only pairs that
cross components are then searched; in each list the largest component is a "main" side that others are joined with, and
lists within one component are left out. Shingles that a near copy has to itself come first in its order, so one that has too many
of them to be linked meets no other. Results are whole: pairs left out lie in one component already.

The order comes from a sketch of all shingles' counts of a fixed size (``sketch`` counters), so what is broadcast doesn't
grow with the input; any order gives the same result. Shingles are 64-bit hashes of 64-bit word hashes: two of a pair's
shingles are mistaken for each other with a chance of about 1e-13 for sets of a thousand. Sets are computed from the texts
when needed and never stored for all documents; a bitmap of fixed size tells which texts are worth the work.

Cases: null or wordless texts have empty sets and link with nothing. Fewer words than a shingle has make one shingle of all.
Rows without an id keep their set size and have no component. Rows sharing an id count as one node, linked by any of their
texts; a row of such an id without words keeps its own id. Very long texts are
taken whole. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import LOWER, UPPER, components, in_small_batches, slices, staged

LOWERING = bytes.maketrans(UPPER.encode(), LOWER.encode())
STEP = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 15  # sketch counters per row
FILTER_BITS = 1 << 23
MOST_WORDS = 200_000  # word hashes a task remembers


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, width: int, hashes: _Words) -> np.ndarray:
    """The text's distinct shingles as ascending 64-bit hashes."""
    words = text.translate(LOWERING).split()  # bytes.split parts at exactly 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    summed = np.full(len(words) - span + 1, np.uint64(span))
    for k in range(span):
        summed = summed * STEP + each[k : len(words) - span + 1 + k]
    return np.unique(_mixed(summed))


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [t or b"" for t in batch[at].cast(pa.binary()).to_pylist()]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


SCANNED = "doc_id long, n long, print binary, block int, counts binary"


def scan(docs: DataFrame, width: int, sketch: int) -> DataFrame:
    """A row per document with its set's size and fingerprint, and per task the rows of its sketch (``block`` not null)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _Words(), np.zeros(sketch, np.uint32)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), _texts(batch, 1), strict=True):
                found = shingle_set(text, width, hashes)
                rows.append((doc_id, len(found), xxhash.xxh3_128_digest(found.tobytes()), None, None))
                np.add.at(counts, (found & np.uint64(sketch - 1)).astype(np.int64), np.uint32(1))
            yield _batch(SCANNED, rows)
        for k in range(0, sketch, BLOCK):
            if counts[k : k + BLOCK].any():
                part = np.minimum(counts[k : k + BLOCK], 0xFFFF).astype("<u2")
                yield _batch(SCANNED, [(None, None, None, k // BLOCK, part.astype("<u4").tobytes())])

    return docs.mapInArrow(task, SCANNED)


def _summed(blocks: DataFrame, *keys: str) -> DataFrame:
    """Sketch rows ``(block, part, counts)`` added up per key, one at a time, at constant memory."""
    schema = "block int, part int, counts binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            for block, part, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held != (block, part):
                    if held:
                        yield _batch(schema, [(*held, np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes())])
                    held, total = (block, part), np.zeros(BLOCK, np.uint64)
                total += np.frombuffer(counts, "<u4")
        if held:
            yield _batch(schema, [(*held, np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes())])

    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


def order_of(scanned: DataFrame, sketch: int) -> np.ndarray:
    """A rank per counter, 0 for the rarest. ``sketch`` bytes, whatever the input."""
    blocks = scanned.where("block is not null").select("block", F.pmod(F.xxhash64("counts"), F.lit(32)).cast("int").alias("part"), "counts")
    summed = _summed(_summed(blocks, "block", "part").withColumn("part", F.lit(0)), "block", "part")
    ranks = np.zeros(sketch, np.uint8)
    for row in summed.collect():  # sketch / BLOCK rows of 128 KB, whatever the input
        counts = np.frombuffer(row["counts"], "<u4").astype(np.float64)
        ranks[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.minimum(8 * np.log2(1 + counts), 255)
    return ranks


def short_lists(docs: DataFrame, ranks: np.ndarray, width: int, percent: int) -> DataFrame:
    """``doc_id, n, print`` and the shingles of each document whose lists are short: the first ones in the global order."""
    schema = "doc_id long, n long, print binary, short array<long>"
    sent, last = docs.sparkSession.sparkContext.broadcast(ranks), np.uint64(len(ranks) - 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), _texts(batch, 1), strict=True):
                found = shingle_set(text, width, hashes)
                n = len(found)
                if n and doc_id is not None:
                    first = n - -(-n * percent // 100) + 1
                    rank = sent.value[(found & last).astype(np.int64)]
                    order = np.lexsort((found, rank))[:first]
                    rows.append((doc_id, n, xxhash.xxh3_128_digest(found.tobytes()), found[order].view(np.int64)))
            yield _batch(schema, rows)

    return docs.mapInArrow(task, schema)


def _bit(id: str) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(FILTER_BITS))


def bits_of(ids: DataFrame, id: str) -> np.ndarray:
    """A bitmap of fixed size in which the bits of all ``ids`` are set; others may be set too."""
    at = ids.where(F.col(id).isNotNull()).select((_bit(id) + 1).alias("at"))
    buckets = at.groupBy(F.bitmap_bucket_number("at").alias("bucket"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():  # 256 rows of 4 KB
        bits[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _set_bits(at: pa.Array, bits: np.ndarray) -> np.ndarray:
    places = at.to_numpy(zero_copy_only=False).astype(np.int64)
    return (bits[places >> 3] >> (places & 7)) & 1 == 1


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``(id, found)``, the sets of the documents in ``ids (id)`` and of a few others that share their bits."""
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(ids, "id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in slices(batches):
            batch = batch.filter(pa.array(_set_bits(batch[2], sent.value)))
            rows, held = [], 0
            for doc_id, text in zip(batch[0].to_pylist(), _texts(batch, 1), strict=True):
                rows.append((doc_id, shingle_set(text, width, hashes).tobytes()))
                held += len(rows[-1][1])
                if held > 1 << 22:
                    yield _batch("id long, found binary", rows)
                    rows, held = [], 0
            yield _batch("id long, found binary", rows)

    rows = docs.where("doc_id is not null").select("doc_id", "text", _bit("doc_id").alias("bit"))
    return rows.mapInArrow(task, "id long, found binary")


def probe(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are linked: the smaller set's shingles are searched by bisection in the larger."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    sets = staged(sets_of(docs, ids, width), "sets")
    left, right = (sets.select(F.col("id").alias(c), F.col("found").alias(f"in_{c}")) for c in ("a", "b"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            linked = []
            for x, y in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1]], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "in_a", "in_b")
    return joined.mapInArrow(task, "a long, b long").distinct()


def _may_link(n: str, m: str, percent: int) -> Column:
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & F.col(n).isNotNull()


def _overlap(n: str, m: str, percent: int) -> Column:
    """T, the least overlap of a linked pair."""
    return F.expr(f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}")


def linked_components(
    docs: DataFrame, width: int = 4, percent: int = 85, sketch: int = 1 << 21
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs (doc_id, text)``; no id, no component."""
    docs = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    scanned = staged(scan(docs, width, sketch), "scanned")
    ranks = order_of(scanned, sketch)
    rows = scanned.where("block is null").select("doc_id", "n", "print")

    filled = rows.where("n > 0 and doc_id is not null")
    classes = staged(filled.groupBy("n", "print").agg(F.min("doc_id").alias("class"), F.count("*").alias("rows")), "classes")
    short = short_lists(docs, ranks, width, percent)
    short = short.join(classes.select(F.col("class").alias("doc_id"), "print"), ["doc_id", "print"], "left_semi")
    short = staged(short.dropDuplicates(["doc_id", "print"]).drop("print"), "short")
    entries = short.select("doc_id", "n", F.posexplode("short").alias("place", "shingle"))
    heads = entries.groupBy("shingle").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count("*").alias("entries"))
    heads = staged(heads.where("entries > 1").select("shingle", "head.doc_id", "head.n").toDF("shingle", "head", "head_n"), "heads")
    lists = staged(entries.join(heads, "shingle"), "lists")  # lists of two and more

    # one partner per class: the head it meets most often
    met = lists.where((F.col("doc_id") > F.col("head")) & _may_link("n", "head_n", percent))
    met = met.groupBy("doc_id", "head").agg(F.count("*").alias("times"))
    star = met.groupBy("doc_id").agg(F.max_by("head", F.struct("times", -F.col("head"))).alias("b"))
    first = probe(docs, staged(star.select(F.col("doc_id").alias("a"), "b"), "star"), width, percent)
    # an id with several texts links the classes of all of them
    several = filled.groupBy("doc_id").agg(F.min(F.struct("n", "print")).alias("x"), F.max(F.struct("n", "print")).alias("y"))
    several = filled.join(several.where("x <> y").select("doc_id"), "doc_id").join(classes, ["n", "print"])
    first = first.union(several.select(F.col("doc_id").alias("a"), F.col("class").alias("b")))
    joined = staged(components(first), "joined")

    # pairs across first components
    part = F.coalesce("component", "doc_id").alias("part")
    sided = lists.select("shingle", "doc_id", "n", "place").join(joined, F.col("doc_id") == F.col("node"), "left")
    sided = staged(sided.select("shingle", "doc_id", "n", "place", part), "sided")
    parts = sided.groupBy("shingle", "part").agg(F.count("*").alias("entries"))
    mains = parts.groupBy("shingle").agg(F.max_by("part", "entries").alias("main"), F.count("*").alias("parts"))
    mixed = staged(sided.join(staged(mains.where("parts > 1").drop("parts"), "mains"), "shingle"), "mixed")
    x = mixed.where("part <> main").toDF("shingle", "a", "n", "place_a", "pa", "main_a").drop("main_a")
    y = mixed.toDF("shingle", "b", "m", "place_b", "pb", "main")
    once = (F.col("pa") != F.col("pb")) & ((F.col("pb") == F.col("main")) | (F.col("b") < F.col("a")))
    least = _overlap("n", "m", percent)
    early = (F.col("place_a") <= F.col("n") - least) & (F.col("place_b") <= F.col("m") - least)
    hits = x.join(y, "shingle").where(once & _may_link("n", "m", percent) & early)
    pairs = hits.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = probe(docs, staged(pairs, "pairs"), width, percent)
    edges = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
    final = components(edges).where("node <> component")

    ends = staged(
        classes.join(final, classes["class"] == final["node"], "left").select(
            "n", "print", F.coalesce("component", "class").alias("component_id")
        ),
        "ends",
    )
    found = rows.join(ends, ["n", "print"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that another document of their component, one with a smaller id, stands for; of
    several rows with one id one stays, that whose text has the least hash.

    Only documents whose bit is set in a fixed-size bitmap of the dropped and repeated ids meet the exact anti-join; the other texts are
    never shuffled.
    """
    found = staged(linked_components(docs.select("doc_id", "text"), width, percent), "found")
    docs = in_small_batches(docs)
    gone = staged(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    again = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_gone")).count().where("count > 1").select("_gone")
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(gone.union(again), "_gone"))
    marked = docs.select(F.coalesce(_bit("doc_id"), F.lit(-1)).alias("bit"), F.struct("*").alias("row"))

    def chosen(wanted: bool) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array((_set_bits(batch[0], sent.value) & (batch[0].to_numpy() >= 0)) == wanted))

        return marked.mapInArrow(task, marked.schema)

    maybe = chosen(True).withColumn("_gone", F.col("row.doc_id")).join(gone, "_gone", "left_anti")
    one = F.row_number().over(Window.partitionBy("_gone").orderBy(F.xxhash64("row.text")))
    maybe = maybe.withColumn("_turn", one).where("_turn = 1")
    return chosen(False).select("row.*").union(maybe.select("row.*"))
