"""Relational operators that DataFrame has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exists(left: DataFrame, right: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Rows of left with a partner; a residual condition may be part of on."""
    return left.join(right, on, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, on: Column | str | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """SQL's NOT IN: no row stays if right holds a null, and none whose own value is null unless right is empty.

    The two cases are decided by one row of counts, so the rest is a plain anti join, which shuffles like any other; Spark's
    own form for nullable columns must broadcast right whole.
    """
    seen = right.agg(F.count(F.lit(1)).alias("__rows"), F.count(other).alias("__known"))
    rows = left.join(right.select(F.col(other).alias("__other")), F.col(column) == F.col("__other"), "left_anti")
    rows = with_scalar(rows, seen).where((F.col("__rows") == 0) | ((F.col("__rows") == F.col("__known")) & F.col(column).isNotNull()))
    return rows.drop("__rows", "__known")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], parts: int, how: str = "inner") -> DataFrame:
    """left join right on keys where a key may have very many rows of left: these are dealt over parts by a hash of the whole row, and
    each row of right goes to all parts. For joins that keep the rows of left or drop them, not those of right alone."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of right are in all parts, so {how} would repeat them")
    dealt = left.withColumn("__part", F.pmod(F.xxhash64(*left.columns), F.lit(parts)))
    copied = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    return dealt.join(copied, [*keys, "__part"], how).drop("__part")


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """df beside the one row of a global aggregate, which is broadcast: its size is one row whatever the input."""
    return df.crossJoin(F.broadcast(scalar))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: each task keeps k of its own (TakeOrderedAndProject), no full sort. The order should be total."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key. Spark keeps k of a key's rows in each task before it shuffles (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def combine(df: DataFrame, files: int) -> DataFrame:
    """Fewer, larger partitions without a shuffle."""
    return df.coalesce(files)


def distinct_count(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """COUNT(DISTINCT): the column joins the keys for a first aggregation, so one key's values spread over tasks."""
    return df.select(*keys, column).distinct().groupBy(*keys).agg(F.count(column).alias(name)) if keys else df.agg(F.countDistinct(column).alias(name))
