"""Join, ranking and checking helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """First ``n`` rows of every key. Each map task keeps only ``n`` rows of a key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_position", F.row_number().over(window)).where(F.col("_position") <= n).drop("_position")


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in arrival order. ``order`` must decide every tie."""
    return first_rows(df, keys, order)


def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last in arrival order."""
    return first_rows(df, keys, [F.desc_nulls_last(c) if isinstance(c, str) else c.desc() for c in order])


def last_n(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n)


def preview(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows for a report, each with the number of rows left out."""
    left_out = F.greatest(df.agg(F.count("*")).scalar() - F.lit(n), F.lit(0).cast("bigint"))
    return df.orderBy(*order).limit(n).withColumn("remaining", left_out)


def total(value: Column | str) -> Column:
    """Sum that is 0 over no rows."""
    return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))


def keep_or_fail(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """Pass every row on, and fail the job at the first row that breaks ``condition``."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text)))


def unique_or_fail(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, or a failed job where a key occurs twice."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    message = F.concat(F.lit("duplicate key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    return keep_or_fail(packed, F.col("_n") == 1, message).select(*df.columns)
