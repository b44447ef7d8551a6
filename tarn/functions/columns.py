"""Column expressions that the queries share; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def between_days(column: str, first: str, end: str) -> Column:
    """first <= column < end, as a range that a Parquet scan can use."""
    return (F.col(column) >= day(first)) & (F.col(column) < day(end))


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money(column: Column, digits: int = 2) -> Column:
    """Rounded, so that the order of a sum does not show."""
    return F.round(column, digits)


def ratio(above: Column, below: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(above, below), digits)


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def year(column: str) -> Column:
    return F.year(column).cast("long")


def hash_partition(key: Column, partitions: int, modulus: int = 91397, text: bool = False) -> Column:
    """The partition of a key, as an explicit column: of a whole number, or of text by the first 13 digits of its MD5."""
    number = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") if text else key
    return F.pmod(F.pmod(number, F.lit(modulus)), F.lit(partitions)).cast("long")
