"""All queries of the library by name, and their SQL twins for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.plans import micro, star, star_sql, text
from tarn.workload import files
from tarn.workload import queries as workload


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return star.QUERIES | text.QUERIES | micro.QUERIES | workload.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    return star_sql.SQL | text.TWINS | micro.SQL | workload.SQL | files.SQL
