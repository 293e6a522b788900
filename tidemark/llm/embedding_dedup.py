"""Near-duplicates among vectors by NN-descent, as Spark jobs over rows.

Equal vectors are one class. A first graph comes from orderings of the classes by the signs of random projections: in every
ordering a vector is compared with those up to ``reach * n ** 0.25`` places away (n classes), and the ``near`` nearest become
neighbours. How many orderings that takes is measured: ``probes`` vectors at exactly the threshold from sampled ones are put
between the others, and orderings are added until ``planted`` of these isolated pairs were met. Then each vector's
neighbours, and those whose neighbour it is, are compared with one another (a join with the neighbours of neighbours), and
every vector keeps its ``k`` nearest at any cosine; what is farther than a full list's last isn't emitted for that list.
Rounds end when one finds hardly any new edge over the threshold for vectors whose lists aren't full of such. A list that holds only neighbours over the threshold is
saturated: such lists are doubled and refined again, up to ``most``. Where lists of ``most`` are still saturated, their whole
component is compared with itself in blocks, which counts the links exactly and emits counts, not pairs. Edges over the
threshold remain. The search is audited: vectors outside the components that were counted exactly are drawn, ``audit`` at
first and twice as many each time, and compared with all, until ``linked`` of them have links. The mean over these vectors of
the share of their links that was found, copies apart, must reach ``recall``; below, the search starts again with more
orderings and more neighbours, and raises if that doesn't help. Where fewer than ``linked`` turn up among ``most_audit``
vectors, those few count, and the planted pairs.

What is held in one task is a stretch of an ordering, 2k vectors, or two blocks. Nothing grows in the driver.

Cases: vectors that are null or empty, all zero, or hold null or non-finite components link with nothing (their component is
their own id). Vectors of different lengths link with nothing in common. Rows without an id are not compared and have no
component; rows that share an id are counted each. An empty table gives no rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import components, staged


@dataclass(frozen=True)
class Search:
    """Parameters. ``audit`` bounds the vectors that are sent to all tasks."""

    threshold: float = 0.9
    orderings: int = 8  # at first; more follow
    most_orderings: int = 512
    reach: int = 4
    near: int = 4
    probes: int = 1000
    planted: float = 0.97
    k: int = 10
    most: int = 40
    rounds: int = 4
    settled: float = 0.002
    audit: int = 256
    most_audit: int = 16384
    linked: int = 100
    recall: float = 0.95
    block: int = 4096
    seed: int = 7


def _units(batch: pa.RecordBatch) -> list[bytes | None]:
    """Unit vectors in double precision; None for what can't be compared."""
    found = []
    for v in batch[1].to_pylist():
        if not v or None in v:
            found.append(None)
            continue
        x = np.array(v, np.float64)
        big = np.abs(x).max() if np.isfinite(x).all() else 0.0
        if big == 0.0:
            found.append(None)
            continue
        x = x / big  # neither overflow nor underflow in the norm
        found.append((x / np.sqrt(x @ x)).tobytes())
    return found


def _matrix(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors side by side, shorter ones filled with zeros, and their lengths."""
    sizes = np.array([len(u) // 8 for u in units])
    if len(set(sizes.tolist())) == 1:
        return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1), sizes
    out = np.zeros((len(units), sizes.max()))
    for row, u in zip(out, units, strict=True):
        row[: len(u) // 8] = np.frombuffer(u, np.float64)
    return out, sizes


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of the rows that share their first ``keys`` columns, from batches in that order."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        names = list(zip(*columns[:keys], strict=True))
        start = 0
        for i in range(1, len(names) + 1):
            if i < len(names) and names[i] == names[start]:
                continue
            part = [c[start:i] for c in columns]
            if held is not None and tuple(c[0] for c in held[:keys]) == names[start]:
                held = [a + b for a, b in zip(held, part, strict=True)]
            else:
                if held is not None:
                    yield held
                held = part
            start = i
    if held is not None:
        yield held


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(vec_id, unit)`` and classes ``(id, unit, copies)`` of equal unit vectors, ``id`` the smallest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(_units(batch), pa.binary())], ["vec_id", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    rows = staged(rows.mapInArrow(task, "vec_id long, unit binary"), "rows")
    able = rows.where("unit is not null and vec_id is not null")
    return rows, staged(able.groupBy("unit").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")


def _planted(classes: DataFrame, search: Search) -> DataFrame:
    """``id, unit``: for sampled classes a vector each whose cosine with the class is the threshold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = [], []
            for id, unit in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                x = np.frombuffer(unit, np.float64)
                aside = np.random.default_rng([search.seed, id % (1 << 63)]).standard_normal(len(x))
                aside -= (aside @ x) * x
                length = np.sqrt(aside @ aside)
                if len(x) > 1 and length > 1e-9:
                    ids.append(id)
                    units.append((search.threshold * x + np.sqrt(1 - search.threshold**2) * aside / length).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(units, pa.binary())], ["id", "unit"])

    drawn = classes.select("id", "unit").orderBy(F.xxhash64(F.lit(search.seed), "id"), "id").limit(search.probes)
    return drawn.mapInArrow(task, "id long, unit binary")


def _first_edges(classes: DataFrame, planted: DataFrame, search: Search, turns: range, reach: int) -> DataFrame:
    """``a, b, cos`` for vectors near each other in some ordering; with ``planted`` a row ``a`` for each probe that met its origin.

    A probe whose nearest ones in a stretch are all links counts as met: it is no isolated pair, and full lists are refined.
    """
    spread = "ordering int, place binary, id long, unit binary, planted boolean"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            units = batch[1].to_pylist()
            if not units:
                continue
            x, sizes = _matrix(units)
            for t in turns:
                bits = np.zeros((len(units), 64), bool)
                for size in set(sizes.tolist()):
                    if (size, t) not in planes:
                        planes[size, t] = np.random.default_rng([search.seed, size, t]).standard_normal((size, 64))
                    rows = sizes == size
                    bits[rows] = x[rows][:, :size] @ planes[size, t] > 0
                packed = np.packbits(bits, axis=1)
                ids = [t] * len(units)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary()), batch[0], batch[1], batch[2]],
                    ["ordering", "place", "id", "unit", "planted"],
                )

    def compared(held: list[list], first: int, end: int) -> pa.RecordBatch:
        """Edges of the rows from ``first`` to ``end``, each with the rows about it."""
        order, ids, probe = np.array(held[0]), np.array(held[1]), np.array(held[3])
        x, sizes = _matrix(held[2])
        parts = []
        for start in range(first, end, reach):
            stop, left, right = min(start + reach, end), max(start - reach, 0), min(start + 2 * reach, len(ids))
            cos = x[start:stop] @ x[left:right].T
            other = (order[start:stop, None] != order[None, left:right]) | (sizes[start:stop, None] != sizes[None, left:right])
            cos[other | probe[None, left:right]] = -2
            cos[np.arange(stop - start), np.arange(start - left, stop - left)] = -2
            few = min(search.near, right - left)
            best = np.argpartition(-cos, few - 1, axis=1)[:, :few]
            value = np.take_along_axis(cos, best, 1)
            keep = (value > -2) & ~probe[start:stop, None]
            of = np.repeat(ids[start:stop], keep.sum(1))
            parts.append((of, ids[left:right][best][keep], value[keep], np.zeros(len(of), bool)))
            asked = np.flatnonzero(probe[start:stop])
            own = (ids[left:right][best[asked]] == ids[start:stop][asked, None]) & (value[asked] > -2)
            met = ids[start:stop][asked][own.any(1) | (value[asked] >= search.threshold).all(1)]
            parts.append((met, met, np.full(len(met), search.threshold), np.ones(len(met), bool)))
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "cos", "planted"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        done = 0  # the first rows held are only there for those after them
        for batch in batches:
            held = [a + batch[c].to_pylist() for a, c in zip(held, (0, 2, 3, 4), strict=True)]
            end = len(held[0]) - reach  # rows that all of their neighbours have come for
            if end > done:
                yield compared(held, done, end)
                cut = max(end - reach, 0)
                held, done = [c[cut:] for c in held], end - cut
        if len(held[0]) > done:
            yield compared(held, done, len(held[0]))

    rows = classes.select("id", "unit", F.lit(False).alias("planted")).union(planted.select("id", "unit", F.lit(True)))
    placed = rows.mapInArrow(places, spread)
    ordered = placed.repartitionByRange("ordering", "place", "id").sortWithinPartitions("ordering", "place", "id")
    return ordered.mapInArrow(near, "a long, b long, cos double, planted boolean")


def _first_graph(classes: DataFrame, search: Search) -> DataFrame:
    """The ``k`` nearest of each vector over as many orderings as the planted pairs need."""
    reach = search.reach * math.ceil(classes.count() ** 0.25)
    planted = staged(_planted(classes, search), "planted")
    asked, turns = planted.count(), range(search.orderings)
    graph = hits = None
    while True:
        met = staged(_first_edges(classes, planted, search, turns, max(reach, 1)), "first")
        edges = met.where("not planted").drop("planted")
        graph = staged(_nearest(edges if graph is None else graph.union(edges), search.k), "graph")
        new = met.where("planted").select("a")
        hits = staged((new if hits is None else hits.union(new)).distinct(), "hits")
        share, done = (hits.count() / asked if asked else 1.0), turns.stop
        if share >= search.planted:
            return graph
        if done >= search.most_orderings:
            raise RuntimeError(f"{done} orderings find only {share:.3f} of the planted pairs")
        missed = max(1 - share, 1e-9) ** (1 / done)  # by one ordering
        needed = 1.15 * math.log(1 - search.planted) / math.log(missed) if missed < 1 else math.inf
        turns = range(done, min(max(math.ceil(min(needed, 4 * done)), done + 2), search.most_orderings))


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "cos"])


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each vector, one row per pair. Each map task keeps k rows of a vector before the shuffle."""
    best = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    once = edges.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    return once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def _compare(graph: DataFrame, classes: DataFrame, k: int, least: float = -1.5) -> DataFrame:
    """Edges between any two neighbours of a vector: those it lists, up to ``k`` that list it, and itself.

    Edges below ``least`` are left out, and those too far for the full list of the vector that they start from.
    """
    full = graph.groupBy("a").agg(F.min("cos").alias("last"), F.count("*").alias("n")).where(F.col("n") >= k)
    full = full.select(F.col("a").alias("id"), F.greatest("last", F.lit(least)).alias("floor"))
    units = classes.select("id", "unit").join(full, "id", "left").fillna(least, "floor")
    back = Window.partitionBy("b").orderBy(F.desc("cos"), "a")
    listed_by = graph.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= k)
    members = graph.select(F.col("a").alias("at"), F.col("b").alias("id"))
    members = members.union(listed_by.select(F.col("b").alias("at"), F.col("a").alias("id")))
    members = members.union(graph.select(F.col("a").alias("at"), F.col("a").alias("id"))).distinct()
    members = staged(members, "members").join(staged(units, "units"), "id").select("at", "id", "unit", "floor")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, ids, units, floors in _runs(batches, 1):
            if len(ids) < 2:
                continue
            x, sizes = _matrix(units)
            cos = x @ x.T
            cos[sizes[:, None] != sizes[None, :]] = -2
            np.fill_diagonal(cos, -2)
            few = min(k, len(ids) - 1)
            ids = np.array(ids)
            best = np.argpartition(-cos, few - 1, axis=1)[:, :few]
            value = np.take_along_axis(cos, best, 1)
            keep = value >= np.array(floors)[:, None]
            parts.append((np.repeat(ids, keep.sum(1)), ids[best][keep], value[keep]))
            held += int(keep.sum())
            if held > 1 << 16:
                yield _edges(parts)
                parts, held = [], 0
        if parts:
            yield _edges(parts)

    return members.repartition("at").sortWithinPartitions("at").mapInArrow(task, "a long, b long, cos double")


def _gain(before: DataFrame, after: DataFrame, search: Search) -> float:
    """The share of new links among those of the vectors whose lists were not full of links before."""
    links = F.sum(F.when(F.col("cos") >= search.threshold, 1).otherwise(0))
    old, new = before.groupBy("a").agg(links.alias("old")), after.groupBy("a").agg(links.alias("new"))
    both = new.join(old, "a", "left").fillna(0, "old").where(F.col("old") < search.k)
    sums = both.agg(F.sum("new").alias("new"), F.sum(F.col("new") - F.col("old")).alias("more")).first()
    return sums["more"] / sums["new"] if sums["new"] else 0.0


def neighbours(classes: DataFrame, search: Search) -> DataFrame:
    """``a, b, cos``: each vector's nearest ones found, at least ``k`` (more where lists were saturated)."""
    graph = _first_graph(classes, search)
    over = F.col("cos") >= search.threshold
    for _ in range(search.rounds):
        before = graph
        graph = staged(_nearest(graph.union(_compare(graph, classes, search.k)), search.k), "graph")
        if _gain(before, graph, search) <= search.settled:
            break
    k = search.k
    while k < search.most:
        full = graph.groupBy("a").agg(F.sum(F.when(over, 1).otherwise(0)).alias("n")).where(F.col("n") >= k).select("a")
        full = staged(full, "full")
        if full.isEmpty():
            break
        k = min(2 * k, search.most)
        # only saturated lists and their neighbours are refined; other lists stay
        dense = staged(graph.where(over).join(full, "a", "left_semi"), "dense")
        longer = staged(_nearest(dense.union(_compare(dense, classes, k, search.threshold)), k), "longer")
        graph = staged(graph.union(longer).groupBy("a", "b").agg(F.max("cos").alias("cos")), "graph")
    return graph


def _count_in_blocks(members: DataFrame, search: Search) -> DataFrame:
    """``id, links``: links inside each component of ``members (id, component, unit, copies)``, by pairs of blocks."""
    n = F.count("*")
    blocks = F.greatest(F.ceil(n / search.block), F.least(F.lit(8), F.ceil(n / 128)))  # small components are spread as well
    sizes = staged(members.groupBy("component").agg(blocks.cast("int").alias("blocks")), "sizes")
    rows = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "unit", "copies")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, ids, units, copies in _runs(batches, 3):
            own, ids, copies = np.array(own), np.array(ids), np.array(copies)
            x, sizes = _matrix(units)
            left, right = own == i[0], own == j[0]
            counts = np.zeros(len(ids), np.int64)
            rows, columns = np.flatnonzero(left), np.flatnonzero(right)
            for start in range(0, len(rows), 512):
                part = rows[start : start + 512]
                near = (x[part] @ x[columns].T >= search.threshold) & (sizes[part][:, None] == sizes[columns][None, :])
                counts[part] += near @ copies[columns]
                if i[0] != j[0]:
                    counts[columns] += copies[part] @ near
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["id", "links"])

    ordered = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counted = ordered.mapInArrow(task, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    return counted.withColumn("links", F.col("links") - 1)  # a vector is no link of its own


def _search(classes: DataFrame, search: Search) -> DataFrame:
    """``id, links, component`` of all classes, ``others``, the classes each is linked with, and if they were counted ``exact``."""
    graph = neighbours(classes, search)
    listed = graph.groupBy("a").agg(F.sum(F.when(F.col("cos") >= search.threshold, 1).otherwise(0)).alias("n"))
    found = graph.where(F.col("cos") >= search.threshold).select("a", "b")
    edges = staged(found.union(found.select("b", "a")).distinct(), "links")
    joined = staged(components(edges), "joined")
    full = listed.where(F.col("n") >= search.most).select(F.col("a").alias("node"))
    dense = staged(joined.join(full, "node", "left_semi").select("component").distinct(), "dense")
    members = joined.join(dense, "component").join(classes, F.col("node") == F.col("id")).select("id", "component", "unit", "copies")
    exact = staged(_count_in_blocks(members, search), "exact")
    counts = edges.join(classes.select(F.col("id").alias("b"), "copies"), "b").groupBy("a")
    counts = counts.agg(F.sum("copies").alias("other"), F.count("*").alias("others"))
    counts = staged(counts.withColumnRenamed("a", "node"), "counts")
    ends = classes.select("id", "copies").join(joined, F.col("id") == F.col("node"), "left").drop("node")
    ends = ends.join(exact, "id", "left").join(counts, F.col("id") == F.col("node"), "left")
    links = F.coalesce("links", F.coalesce("other", F.lit(0)) + F.col("copies") - 1)
    others, exactly = F.coalesce("others", F.lit(0)).cast("long"), F.col("links").isNotNull()
    return staged(
        ends.select(
            "id", links.cast("long").alias("links"), F.coalesce("component", "id").alias("component"),
            others.alias("others"), exactly.alias("exact"),
        ),
        "ends",
    )


def audited_recall(classes: DataFrame, ends: DataFrame, search: Search) -> float:
    """The mean share of a linked vector's links to other classes that was found, the true ones counted against every vector.

    Only vectors outside exactly counted components are drawn, more and more until ``linked`` of them have links.
    """
    open_ends = staged(classes.select("id", "unit").join(ends.where("not exact").select("id", "others"), "id"), "open")
    order = [F.xxhash64(F.lit(search.seed), "id"), "id"]
    shares, done, draws = [], 0, search.audit
    while True:
        drawn = open_ends.orderBy(*order).limit(draws).collect()  # most_audit at most
        true = _true_links(classes, [(r["id"], bytes(r["unit"])) for r in drawn[done:]], search)
        shares += [r["others"] / true[r["id"]] for r in drawn[done:] if true[r["id"]]]
        if len(shares) >= search.linked or len(drawn) < draws or draws >= search.most_audit:
            return sum(shares) / len(shares) if shares else 1.0
        done, draws = draws, min(2 * draws, search.most_audit)


def _true_links(classes: DataFrame, asked: list[tuple[int, bytes]], search: Search) -> dict[int, int]:
    """How many other classes each of ``asked`` is linked with."""
    if not asked:
        return {}
    sent = classes.sparkSession.sparkContext.broadcast(asked)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = zip(*sent.value, strict=True)
        totals = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, sizes = _matrix(list(units) + batch[1].to_pylist())
                y, other = x[len(ids) :], sizes[len(ids) :]
                for start in range(0, len(ids), 512):
                    part = slice(start, min(start + 512, len(ids)))
                    near = (x[part] @ y.T >= search.threshold) & (sizes[part, None] == other[None, :])
                    totals[part] += near.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals)], ["id", "true"])

    true = classes.select("id", "unit").mapInArrow(task, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    return {r["id"]: r["true"] - 1 for r in true.collect()}  # a vector is no link of its own


def linked(vectors: DataFrame, search: Search = Search()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors (vec_id, embedding)``."""
    rows, classes = classes_of(vectors)
    for attempt in range(3):
        now = replace(search, orderings=search.orderings << attempt, k=search.k << attempt, most=search.most << attempt, seed=search.seed + attempt)
        ends = _search(classes, now)
        recall = audited_recall(classes, ends, now)
        if recall >= search.recall:
            break
    else:
        raise RuntimeError(f"the neighbour search finds only {recall:.3f} of the links")
    named = staged(ends.join(classes.select("id", "unit"), "id").select("unit", "links", "component"), "named")
    found = rows.join(named, "unit", "left")
    able = F.col("vec_id").isNotNull()
    component = F.when(able, F.coalesce("component", "vec_id"))
    return found.select(
        "vec_id", F.when(able, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
