"""Streaming twins of the gauges: event-time windows with watermarks.

A window is written once, when the watermark has passed its end, and its state goes; rows that come later than the watermark allows are
dropped by Spark. So state is as large as the windows that are open, however long the stream runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import shared_folder

#: ts (without a time zone) read as UTC, so that windows begin at the same points in any session's zone.
AT = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern (of this name alone), since a stream's base path may not be a single file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def settled(gauge: Callable[[DataFrame], DataFrame], stream: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a gauge over a stream once all that is there has been read, with the windows that are still open then.

    batch: what the stream read, for these last windows; a filter on their time keeps that to the rows since. Each micro-batch writes its
    own folder anew, so one that is repeated after a failure changes nothing. A source without files gives no rows.
    """
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    closed = gauge(stream)

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = closed.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p.get("eventTime", {})]
    if not marks:
        return spark.createDataFrame([], closed.schema)
    done = spark.read.schema(closed.schema).parquet(f"{folder}/rows").select(closed.columns)
    return done.unionByName(gauge(batch).where(F.col("end") > F.to_timestamp(F.lit(max(marks)))))


def max_gauge(events: DataFrame, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, start, end, value: the largest value of each interval."""
    at = events.withColumn("at", F.expr(AT))
    return at.withWatermark("at", late).groupBy("event_type", F.window("at", interval).alias("w")).agg(F.max("value").alias("value")).select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value")


def sliding_load(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """event_type, start, end, n, value: count and sum over sliding windows."""
    at = events.withColumn("at", F.expr(AT))
    return at.withWatermark("at", late).groupBy("event_type", F.window("at", length, step).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
