"""Stage graphs of queries: fan-outs, depth, and the stage after which an output is no longer needed.

dag: query, stage, num_tasks, deps (array<int>), no_drop (array<int>). Stages are in an order in which deps come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import shared_folder

SCHEMA = "query string, stage int, num_tasks int, deps array<int>, no_drop array<int>"


def edges(dag: DataFrame) -> DataFrame:
    return dag.select("query", F.explode("deps").alias("producer"), F.col("stage").alias("consumer"))


def stage_summary(dag: DataFrame) -> DataFrame:
    """query, stage, num_tasks, fan_in, fan_out, shuffle_parts (tasks of the stage times tasks of its consumers)."""
    e = edges(dag).join(dag.select("query", F.col("stage").alias("consumer"), F.col("num_tasks").alias("n")), ["query", "consumer"])
    out = e.groupBy("query", F.col("producer").alias("stage")).agg(F.count("*").alias("fan_out"), F.sum("n").alias("readers"))
    rows = dag.join(out, ["query", "stage"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("query", "stage", F.col("num_tasks").cast("long").alias("num_tasks"), F.size("deps").cast("long").alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"), (F.col("num_tasks") * F.coalesce("readers", zero)).alias("shuffle_parts"))


def drop_map(dag: DataFrame) -> DataFrame:
    """query, producer, drop_stage: the first stage, from the last backwards, that has all consumers of the output at or above it.

    Pairs (stage, stage it depends on, itself included) grow by one level of the graph a round; the rounds are as many as the
    longest path has stages, which is a property of queries, not of their number.
    """
    shared_folder(dag.sparkSession)
    e = edges(dag)
    below = dag.select("query", F.col("stage").alias("top"), F.col("stage").alias("under"))
    reach, new = below, below
    while True:
        new = new.join(e, (new["query"] == e["query"]) & (new["under"] == e["consumer"])).select(new["query"], "top", F.col("producer").alias("under")).distinct()
        new = new.checkpoint()  # a round's plan does not grow with the rounds before
        if new.isEmpty():
            break
        reach = reach.unionByName(new).distinct().checkpoint()
    held = reach.join(e, (reach["query"] == e["query"]) & (reach["under"] == e["consumer"])).select(reach["query"], "top", "producer", "consumer").distinct()
    counts = held.groupBy("query", "producer", "top").agg(F.count("*").alias("n"))
    full = e.groupBy("query", "producer").agg(F.count("*").alias("all"))
    return counts.join(full, ["query", "producer"]).where("n = all").groupBy("query", "producer").agg(F.min("top").cast("long").alias("drop_stage")).withColumn("producer", F.col("producer").cast("long"))


#: A small graph table for tests and queries.
EXAMPLE = [
    ("a", 0, 8, [], []), ("a", 1, 4, [0], []), ("a", 2, 1, [1], []), ("b", 0, 72, [], []), ("b", 1, 17, [], []), ("b", 2, 16, [0, 1], []),
    ("b", 3, 3, [], []), ("b", 4, 16, [2, 3], []), ("b", 5, 16, [2, 4], [2]), ("b", 6, 1, [5], []),
]


def example(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE, SCHEMA)
