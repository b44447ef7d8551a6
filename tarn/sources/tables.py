"""Base tables: one Parquet (or ORC) file or folder each; columns and filters are left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import share_package


class Tables:
    """Tables of a folder by attribute: Tables(spark, dir).lineitem."""

    def __init__(self, spark: SparkSession, sf_dir: str, kind: str = "parquet") -> None:
        share_package(spark)
        self.spark, self.dir, self.kind = spark, sf_dir, kind

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.format(self.kind).load(f"{self.dir}/{name}.{self.kind}")

    @property
    def partsupp(self) -> DataFrame:
        """Who supplies what, derived from lineitem: the least price asked and the quantity sold."""
        return self.offers()

    def offers(self, parts: DataFrame | None = None, suppliers: DataFrame | None = None) -> DataFrame:
        """partsupp of some parts (p_partkey) or suppliers (s_suppkey). They are the aggregate's own keys, so lines of others go before it shuffles."""
        lines = self.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        if parts is not None:
            lines = lines.join(parts.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        if suppliers is not None:
            lines = lines.join(suppliers.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
        return lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.min("l_extendedprice").alias("ps_supplycost"), F.sum("l_quantity").alias("ps_availqty"))

    def views(self, *names: str) -> SparkSession:
        """Registers tables as temporary views, for SQL texts."""
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark


def to_orc(tables: Tables, path: str, *names: str) -> Tables:
    for name in names:
        getattr(tables, name).write.mode("overwrite").orc(f"{path}/{name}.orc")
    return Tables(tables.spark, path, "orc")
