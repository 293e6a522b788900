"""Repeatable masking: every value is made from values of other rows, in an order drawn from a seed.

The order and the distances are taken from hashes of (seed, key), so a run can be repeated and checked. Rows get a
global rank from an order-preserving hash prefix; blocks of consecutive ranks, each with a few rows of its neighbours,
then hold every row a value may come from. Two shuffles serve all columns of a table, however many are masked.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.common import unique_or_fail

REACH = 7  # farthest neighbour any method asks for
BLOCK = 1 << 13  # ranks per block
PREFIX_DIGITS = 4  # 65,536 hash prefixes


def _seeded(seed: str, purpose: str, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *([F.lit(purpose)] if purpose else []), *[F.col(k).cast("string") for k in keys]))


def drawn(seed: str, purpose: str, keys: Sequence[str], low: int, high: int) -> Column:
    """Whole number in low..high, drawn per row from a hash."""
    number = F.conv(F.substring(_seeded(seed, purpose, keys), 1, 7), 16, 10).cast("bigint")
    return (F.lit(low) + number % (high - low + 1)).cast("int")


def global_rank(df: DataFrame, keys: Sequence[str], seed: str, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Adds ``_rank`` 0.. in hash order without sorting everything in one task.

    Rows are sorted within a hash prefix; the counts of earlier prefixes (at most 16**digits rows) are broadcast.
    """
    prefix = F.substring("_order", 1, digits)
    hashed = df.withColumn("_order", _seeded(seed, "", keys)).withColumn("_prefix", prefix)
    counts = hashed.groupBy("_prefix").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_prefix", F.coalesce(earlier, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_prefix").orderBy("_order", *keys))
    ranked = hashed.withColumn("_place", place).join(F.broadcast(starts), "_prefix")
    return ranked.withColumn("_rank", F.col("_start") + F.col("_place") - 1).drop("_order", "_prefix", "_place", "_start")


class Neighbours:
    """Values of the rows before and after, in the drawn order, for the methods below."""

    def __init__(self, seed: str, keys: Sequence[str], name: str):
        self.seed, self.keys, self.name = seed, keys, name

    def draw(self, label: str, low: int, high: int) -> Column:
        return drawn(self.seed, f"{self.name}.{label}", self.keys, low, high)

    def _value(self, side: str, distance: Column | int, column: str | None = None) -> Column:
        away = F.lit(distance) if isinstance(distance, int) else distance
        return F.get(F.col(side), away - 1)[column or self.name]

    def lead(self, distance: Column | int, column: str | None = None) -> Column:
        return self._value("_after", distance, column)

    def lag(self, distance: Column | int, column: str | None = None) -> Column:
        return self._value("_before", distance, column)


Method = Callable[[Neighbours], Column]


def with_neighbours(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], seed: str, reach: int = REACH, block: int = BLOCK
) -> DataFrame:
    """Adds ``_before`` and ``_after``: up to ``reach`` rows on either side, nearest first."""
    ranked = global_rank(df, keys, seed)
    home, inside = F.floor(F.col("_rank") / block), F.col("_rank") % block
    shared = F.array_compact(
        F.array(
            F.struct(home.alias("b"), F.lit(True).alias("core")),
            F.when((inside < reach) & (home > 0), F.struct((home - 1).alias("b"), F.lit(False).alias("core"))),
            F.when(inside >= block - reach, F.struct((home + 1).alias("b"), F.lit(False).alias("core"))),
        )
    )
    spread = ranked.withColumn("_at", F.explode(shared)).withColumns(
        {"_block": F.col("_at.b"), "_core": F.col("_at.core"), "_row": F.struct(*columns)}
    )
    order = Window.partitionBy("_block").orderBy("_rank")
    before = F.array(*[F.lag("_row", i).over(order) for i in range(1, reach + 1)])
    after = F.array(*[F.lead("_row", i).over(order) for i in range(1, reach + 1)])
    rows = spread.withColumns({"_before": before, "_after": after}).where("_core")
    return rows.drop("_rank", "_at", "_block", "_core", "_row")


def scramble(df: DataFrame, keys: Sequence[str], methods: Mapping[str, Method], seed: str, block: int = BLOCK) -> DataFrame:
    """Replace columns by values made from neighbouring rows; rows, keys and other columns stay as they are."""
    rows = with_neighbours(df, keys, list(methods), seed, block=block)
    made = {name: method(Neighbours(seed, keys, name)) for name, method in methods.items()}
    return rows.withColumns(made).select(*df.columns)


def name_words(lead: int = 1, second_lead: int = 1, words: Sequence[tuple[int, int]] = ((1, 2), (3, 1), (1, 3))) -> Method:
    """Three words, each of another row; ``words`` gives the word taken ahead and the one taken behind instead."""

    def made(near: Neighbours) -> Column:
        def word(value: Column, i: int) -> Column:
            return F.split_part(value, F.lit(" "), F.lit(i))

        (a1, b1), (a2, b2), (a3, b3) = words
        first = F.coalesce(word(near.lead(lead), a1), word(near.lag(near.draw("1", 1, 6)), b1))
        second = F.coalesce(word(near.lead(second_lead), a2), word(near.lag(3), b2))
        third = F.coalesce(word(near.lead(near.draw("2", 1, 6)), a3), word(near.lag(near.draw("3", 1, 6)), b3))
        return F.upper(F.concat(first, F.lit(" "), second, F.lit(" "), third))

    return made


def email_parts(substitute: bool = False) -> Method:
    """Local part of one neighbour at the domain of another; ``substitute`` also changes letters."""

    def made(near: Neighbours) -> Column:
        def part(value: Column, i: int) -> Column:
            return F.split_part(value, F.lit("@"), F.lit(i))

        if not substitute:
            local = F.coalesce(part(near.lead(1), 1), part(near.lag(near.draw("1", 1, 6)), 1))
            domain = F.coalesce(part(near.lead(near.draw("2", 1, 4)), 2), part(near.lag(near.draw("3", 1, 6)), 2))
            return F.lower(F.concat(local, F.lit("@"), domain))
        local = F.coalesce(part(near.lag(1), 1), part(near.lead(near.draw("1", 1, 6)), 1))
        domain = F.coalesce(part(near.lead(near.draw("2", 2, 7)), 2), part(near.lag(near.draw("3", 2, 7)), 2))
        text = F.lower(F.concat(local, F.lit("@"), domain))
        # One after the other: an "a" made from "i" stays.
        for old, new in (("_", "."), ("a", "e"), ("u", "o"), ("i", "a")):
            text = F.translate(text, old, new)
        return text

    return made


def digits(old: str = "12345", before: str = "94", after: str = "74", as_number: bool = False) -> Method:
    """A neighbour's number with the digits ``old`` replaced, one of them by a drawn digit 1..9."""

    def made(near: Neighbours) -> Column:
        value = F.coalesce(near.lag(near.draw("1", 2, 7)), near.lead(near.draw("2", 1, 6))).cast("string")
        new = F.concat(F.lit(before), near.draw("3", 1, 9).cast("string"), F.lit(after))
        text = F.call_function("translate", value, F.lit(old), new)
        return F.nullif(F.trim(text), F.lit("")).cast("decimal(38,0)") if as_number else text

    return made


def swapped() -> Method:
    """A previous row's value, else a following one's."""

    def made(near: Neighbours) -> Column:
        return F.coalesce(near.lag(near.draw("1", 1, 6)), near.lead(near.draw("2", 1, 6)))

    return made


METHODS: dict[str, Callable[..., Method]] = {"name": name_words, "email": email_parts, "digits": digits, "swap": swapped}


def mask_by_spec(df: DataFrame, keys: Sequence[str], spec: Sequence[Mapping], seed: str) -> DataFrame:
    """Mask a table by rows of a spec: column, method, args. Neighbour methods share one pass.

    Methods: name, email, digits, swap (neighbours); template (prefix, suffix), multiple (factor), constant (value).
    """
    moved = {s["column"]: METHODS[s["method"]](**s.get("args", {})) for s in spec if s["method"] in METHODS}
    rows = scramble(df, keys, moved, seed) if moved else df
    fixed = {}
    for s in spec:
        args = s.get("args", {})
        if s["method"] == "template":
            fixed[s["column"]] = template(keys[0], args.get("prefix", ""), args.get("suffix", ""))
        elif s["method"] == "multiple":
            fixed[s["column"]] = F.col(keys[0]) * args["factor"]
        elif s["method"] == "constant":
            fixed[s["column"]] = F.lit(args["value"])
        elif s["method"] not in METHODS:
            raise ValueError(f"unknown masking method: {s['method']}")
    return rows.withColumns(fixed) if fixed else rows


def template(key: str, prefix: str = "", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(suffix))


def mask_template(df: DataFrame, templates: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(templates))


def mask_constant(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def apply_updates(df: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of ``updates`` written over the rows with equal keys; a key given twice fails the job."""
    changed = [c for c in updates.columns if c not in keys]
    once = unique_or_fail(updates, keys).select(*keys, F.struct(*changed).alias("_new"))
    joined = df.join(once, list(keys), "left")
    values = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in changed}
    return joined.withColumns(values).select(*df.columns)


def masking_audit(masked: DataFrame, sessions: DataFrame, settings: DataFrame, key: str = "environment_name") -> DataFrame:
    """The audit row of a masking run: environment, sessions seen, rows masked."""
    environment = settings.where(F.col("config_key") == key).agg(F.max("config_value"))
    return masked.agg(F.count("*").alias("rows_masked")).select(
        environment.scalar().alias("observed_environment"),
        sessions.agg(F.count("*")).scalar().alias("observed_runtime_sessions"),
        "rows_masked",
    )

