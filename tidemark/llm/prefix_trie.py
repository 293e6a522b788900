"""The trie of conversation prefixes, with a count-min sketch that tells prefixes of one conversation from shared ones.

A conversation ``c`` is rebuilt first: the first ``h`` turns of conversation ``c - c % family``, then its own turns after the first
``h``; ``h`` is the CRC-32 of the id in decimal, modulo ``most_shared + 1``. A prefix is told by two 64-bit numbers, the exclusive
or of hashes of (place, role, text) over its turns, so prefix digests are running aggregates and the one of the parent is at hand.

1. Turns are numbered by ranges of (conversation, turn): within a range by a window, across ranges by a carry, a row per range at
   most. Running digests and, later, sums along a conversation are taken in stretches of ``STRETCH`` turns with a carry per
   stretch. A conversation with a third of all turns is so dealt to many tasks.
2. Every task counts prefix digests in a sketch of two rows of ``width`` counters, which stop at two; the tasks' sketches are
   added up, and one bit per counter (two or more) is sent to all tasks. An estimate of one proves that a prefix has one
   member. Its node is emitted where it is; only the other rows are shuffled for exact grouping. A full sketch sends more
   rows there and changes no result.
3. Sums over subtrees need no walk: a node's leaves are the members that are the first to end at a childless node, and the
   characters saved below it are those that its members hold, from it on, in nodes whose smallest member is another.

Cases: null roles and texts are empty; rows without ``conv_id`` belong to no conversation. Turns come in order, null first; turns
with one number in the order of a hash of role and text. Repeated rows are turns each. ``%`` takes the sign of the id, as in
SQL. Very long texts count by all their code points and are never shuffled. An empty table gives no rows. Only ``conv_id``,
``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import staged, text_of

STRETCH = 1024  # turns of one conversation in a window
PIECE = 1 << 15  # counters in a row of a sketch
NODE = ["depth", "a", "b"]
NOBODY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    """Parameters; ``width`` is a power of two."""

    family: int = 100
    most_shared: int = 5
    width: int = 1 << 21


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, rank, said, chars`` of every turn: its place in the conversation, a hash of role and text, and the code
    points of its text."""
    role = text_of("role")
    said = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text_of("text")).cast("binary")))
    rows = conversations.select(
        F.col("conv_id").cast("long"), "turn", said.alias("said"), F.char_length(text_of("text")).cast("long").alias("chars")
    ).where("conv_id is not null")
    rows = staged(rows.withColumn("place", F.monotonically_increasing_id()), "turns")
    order = [F.asc_nulls_first("turn"), F.asc("said"), F.asc("place")]
    rows = staged(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carry = sizes.withColumn("before", before).where("before > 0").drop("n")  # at most one conversation crosses a border
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    ranked = rows.withColumn("rank", local).join(F.broadcast(carry), ["conv_id", "part"], "left")
    return ranked.select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"), "said", "chars")


def rebuilt(turns: DataFrame, how: Trie) -> DataFrame:
    """``conv_id, depth, length, said, chars`` of every turn of the rebuilt conversations, and a row with depth 0 for each."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (how.most_shared + 1)).cast("int")
    convs = turns.groupBy("conv_id").agg(F.max("rank").alias("own"))
    convs = convs.withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % how.family})
    heads = turns.where((F.col("rank") <= how.most_shared) & (F.col("conv_id") % how.family == 0))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("rank", "said", "chars"))).alias("head"))
    lead = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h")))
    convs = convs.join(heads, "base", "left").withColumn("lead", lead)
    n_lead = F.greatest(F.coalesce(F.size("lead"), F.lit(0)), F.lit(0)).cast("long")
    convs = convs.withColumn("n_lead", n_lead)
    length = F.col("n_lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))
    convs = staged(convs.select("conv_id", "h", "n_lead", "lead", length.alias("length")), "convs")
    roots = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("chars")
    )
    leads = convs.select("conv_id", "length", F.posexplode("lead").alias("pos", "t"))
    leads = leads.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "length", "t.said", "t.chars")
    own = turns.join(convs.select("conv_id", "h", "n_lead", "length"), "conv_id").where("rank > h")
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("n_lead")).alias("depth"), "length", "said", "chars")
    return roots.unionByName(leads).unionByName(own)


def _with_carry(rows: DataFrame, parts: dict[str, Column], sums: dict[str, Column], backwards: bool, combine) -> DataFrame:
    """``rows`` with running aggregates along each conversation, in stretches and with a carry for those of several.

    ``parts`` makes the columns that are aggregated; ``sums`` aggregates them.
    """
    rows = rows.withColumns({**parts, "stretch": F.floor(F.col("depth") / STRETCH).cast("long")})
    along = F.desc if backwards else F.asc
    window = Window.partitionBy("conv_id", "stretch").orderBy(along("depth")).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.where(F.col("length") >= STRETCH).groupBy("conv_id", "stretch").agg(*[agg.alias(name) for name, agg in sums.items()])
    before = Window.partitionBy("conv_id").orderBy(along("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    step = {name: agg.over(before).alias(f"_{name}") for name, agg in zip(sums, [combine(F.col(n)) for n in sums], strict=True)}
    totals = totals.select("conv_id", "stretch", *step.values())
    rows = rows.withColumns({name: agg.over(window) for name, agg in sums.items()})
    return rows.join(totals, ["conv_id", "stretch"], "left").drop("stretch")


def paths(turns: DataFrame, how: Trie) -> DataFrame:
    """``conv_id, depth, length, chars``, the digest ``a, b`` of each prefix and that of its parent, ``pa, pb``."""
    step = lambda salt: F.when(F.col("depth") > 0, F.xxhash64(F.lit(salt), "depth", "said")).otherwise(F.lit(0).cast("long"))
    rows = _with_carry(
        rebuilt(turns, how), {"xa": step(1), "xb": step(2)}, {"a": F.bit_xor("xa"), "b": F.bit_xor("xb")}, False, F.bit_xor
    )
    for name in ("a", "b"):
        rows = rows.withColumn(name, F.col(name).bitwiseXOR(F.coalesce(f"_{name}", F.lit(0).cast("long"))))
    return rows.select(
        "conv_id", "depth", "length", "chars", "a", "b",
        F.col("a").bitwiseXOR(F.col("xa")).alias("pa"), F.col("b").bitwiseXOR(F.col("xb")).alias("pb"),
    )


def sketch(found: DataFrame, how: Trie) -> np.ndarray:
    """A bit per counter of both rows: whether the counter stands at two. ``width / 4`` bytes, whatever the input."""
    schema = "piece int, counts binary"

    def rows(counts: np.ndarray) -> pa.RecordBatch:
        pieces = counts.reshape(-1, min(PIECE, how.width))
        used = np.flatnonzero(pieces.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([pieces[k].tobytes() for k in used], pa.binary())], ["piece", "counts"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, how.width), np.uint8)
        for batch in batches:
            for k in (0, 1):
                seen, times = np.unique(_counter(batch[k], how.width), return_counts=True)
                counts[k][seen] = np.minimum(counts[k][seen] + np.minimum(times, 2), 2)
        yield rows(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, None
        for batch in batches:
            for at, held in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if at != piece:
                    if piece is not None:
                        yield bits(piece, total)
                    piece, total = at, np.zeros(min(PIECE, how.width), np.uint8)
                total = np.minimum(total + np.frombuffer(held, np.uint8), 2).astype(np.uint8)
        if piece is not None:
            yield bits(piece, total)

    def bits(piece: int, total: np.ndarray) -> pa.RecordBatch:
        packed = np.packbits(total == 2, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([packed], pa.binary())], ["piece", "counts"])

    parts = staged(found.select("a", "b").mapInArrow(count, schema), "sketches")
    summed = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(add, schema)
    out = np.zeros((2 * how.width // min(PIECE, how.width), -(-min(PIECE, how.width) // 8)), np.uint8)
    for row in summed.collect():  # 4 KB for each piece of the sketch
        out[row["piece"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(2, -1)


def _counter(digest: pa.Array, width: int) -> np.ndarray:
    return digest.to_numpy() & np.int64(width - 1)


def screened(found: DataFrame, how: Trie) -> DataFrame:
    """``found`` with ``maybe`` and ``parent_maybe``: false where the sketch proves that a prefix, or its parent, has one member."""
    sent = found.sparkSession.sparkContext.broadcast(sketch(found, how))

    def shared(a: pa.Array, b: pa.Array) -> np.ndarray:
        yes = np.ones(len(a), bool)
        for k, digest in enumerate((a, b)):
            at = _counter(digest, how.width)
            yes &= (sent.value[k][at >> 3] >> (at & 7)) & 1 == 1
        return yes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            depth = c["depth"].to_numpy()
            own, parent = shared(c["a"], c["b"]) | (depth == 0), shared(c["pa"], c["pb"]) | (depth <= 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(parent)], [*batch.schema.names, "maybe", "parent_maybe"]
            )

    schema = ", ".join(f"{name} {kind}" for name, kind in found.dtypes)
    return found.mapInArrow(task, f"{schema}, maybe boolean, parent_maybe boolean")


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ``conv_id`` in order, joined by commas. Ids are joined to long strings range by range, so that
    one task reads few rows of a node where very many conversations end (the hash itself can't be split)."""
    schema = "depth long, a long, b long, first long, ids string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for *at, conv_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != node or len(ids) >= 8192:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = at, []
                ids.append(conv_id)
            if len(out) >= 1024:
                yield _batch(out, "first", "ids")
                out = []
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        yield _batch(out, "first", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, out = None, None, []
        for batch in batches:
            for *at, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at == node:
                    held.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, held.hexdigest()))
                node, held = at, hashlib.sha256(ids.encode())
            if out:
                yield _batch(out, "ends_sha256")
                out = []
        if node:
            out.append((*node, held.hexdigest()))
        yield _batch(out, "ends_sha256")

    rows = ends.select(*NODE, "conv_id")
    joined = rows.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(join, schema)
    dealt = staged(joined, "ends").repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * (3 + len(names))
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.int64() if n == "first" else pa.string() for n in names]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, *names])


def prefix_nodes(conversations: DataFrame, how: Trie = Trie()) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``."""
    found = staged(paths(staged(numbered(conversations), "numbered"), how), "paths")
    found = staged(screened(found, how), "screened")
    lone, some = found.where("not maybe"), found.where("maybe")
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]

    groups = some.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb")
    )
    groups = staged(groups, "groups")
    children = groups.select(*up).unionByName(lone.where("parent_maybe").select(*up)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    nodes = groups.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = staged(nodes, "nodes")

    # along each member: characters that another conversation owns, and whether it is not the first to end at its leaf
    met = some.select("conv_id", "length", "chars", *NODE).join(nodes.select(*NODE, "owner", "n_children"), NODE)
    foreign = F.when(F.col("conv_id") != F.col("owner"), F.col("chars")).otherwise(F.lit(0).cast("long"))
    first = (F.col("n_children") == 0) & (F.col("conv_id") == F.col("owner"))
    no_leaf = F.when((F.col("depth") == F.col("length")) & ~first, 1).otherwise(0).cast("long")
    below = _with_carry(
        met, {"foreign": foreign, "no_leaf": no_leaf}, {"saved": F.sum("foreign"), "others": F.sum("no_leaf")}, True, F.sum
    )
    sums = below.groupBy(*NODE).agg(
        *[(F.sum(c) + F.coalesce(F.sum(f"_{c}"), F.lit(0).cast("long"))).alias(c) for c in ("saved", "others")]
    )
    ends = ends_digest(some.where("depth = length"))
    exact = nodes.join(sums, NODE).join(ends, NODE, "left").select(
        F.col("owner").alias("conv_id"), *NODE, "pa", "pb", "n_convs", "n_children",
        (F.col("n_convs") - F.col("others")).alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )

    ended = F.col("depth") == F.col("length")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = lone.select(
        "conv_id", *NODE, "pa", "pb", one.alias("n_convs"), F.when(ended, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(ended, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
        "parent_maybe",
    )
    below_shared = exact.withColumn("parent_maybe", F.lit(True)).unionByName(tails.where("parent_maybe"))
    parents = nodes.select(*[F.col(c).alias(f"_{c}") for c in NODE], "owner")
    on = (F.col("depth") - 1 == F.col("_depth")) & (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b"))
    # a parent that was never grouped has one member: the node's own
    parent = F.when(F.col("depth") > 0, F.coalesce("owner", "conv_id")).alias("parent_conv_id")
    columns = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    joined = below_shared.join(parents, on, "left").select("conv_id", "depth", parent, *columns)
    local = tails.where("not parent_maybe").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *columns)
    return joined.unionByName(local)
