"""Demand curves from task intervals. A trace is a key; its curve is dense in time, so what a window sorts in one task is
as long as the time covered, however many intervals there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.sources.tables import Tables

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def event_intervals(spark: SparkSession, sf: str, unit: str = "HOUR", scale: float = 10.0) -> DataFrame:
    """trace, start, end (exclusive), bytes: an event is a task of its type that takes value / scale units, one at least."""
    length = F.greatest(F.ceil(F.coalesce("value", F.lit(0.0)) / scale), F.lit(1)).cast("long")
    start = F.expr(f"timestampdiff({unit}, {EPOCH}, ts)").cast("long")
    return Tables(spark, sf).events.where("ts is not null").select(F.col("event_type").alias("trace"), start.alias("start"), (start + length).alias("end"), (length * 1000).alias("bytes"))


def demand(intervals: DataFrame, weight: str | None = None, pad: int = 0) -> DataFrame:
    """trace, t, demand: how many intervals (or how much weight) are open at t, dense, with pad zero points before the first.

    Each interval is +1 and -1, so the work does not grow with its length.
    """
    w = F.col(weight) if weight else F.lit(1)
    ends = F.array(F.struct(F.col("start").alias("t"), w.cast("long").alias("d")), F.struct(F.col("end").alias("t"), (-w).cast("long").alias("d")))
    deltas = intervals.where("start < end").select("trace", F.explode(ends).alias("x")).groupBy("trace", F.col("x.t").alias("t")).agg(F.sum("x.d").alias("d"))
    spine = intervals.groupBy("trace").agg(F.min("start").alias("a"), F.max("end").alias("b")).select("trace", F.explode(F.sequence(F.col("a") - pad, F.col("b") - 1)).alias("t"))
    running = Window.partitionBy("trace").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(deltas, ["trace", "t"], "left").select("trace", "t", F.sum(F.coalesce("d", F.lit(0))).over(running).alias("demand"))


def max_gauge(samples: DataFrame, unit: str = "HOUR") -> DataFrame:
    """trace, t, value: the largest value of each interval of time."""
    return samples.groupBy("trace", F.expr(f"timestampdiff({unit}, {EPOCH}, ts)").cast("long").alias("t")).agg(F.max("value").alias("value"))
