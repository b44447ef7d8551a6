"""The suite as SQL texts through spark.sql, over views of a folder's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tarn.plans.star_sql import SQL
from tarn.sources.tables import Tables

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def run(spark: SparkSession, sf: str, text: str) -> DataFrame:
    Tables(spark, sf).views(*(n for n in NAMES if re.search(rf"\b{n}\b", text)))
    return spark.sql(text)


def query(name: str):
    return lambda spark, sf: run(spark, sf, SQL[name])


QUERIES = {f"sql_{name}": query(name) for name in SQL}
TWINS = {f"sql_{name}": text for name, text in SQL.items()}
