"""Synthetic workloads by hash, so that a row is the same wherever and however often it is made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.workload.demand import demand


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) for a key: the first 52 bits of an MD5, which other engines have too."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def uniform_sql(seed: int, *keys: str | int) -> str:
    return f"(cast('0x' || substring(md5(concat_ws(':', {', '.join(map(str, (seed, *keys)))})), 1, 13) AS bigint) / 4503599627370496e0)"


#: Points of the inverse distribution function that are interpolated between.
GRID = 256


def inverse_cosine(u: float) -> float:
    """x with x - sin(2 pi x) / (2 pi) = u, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(50):
        x = (low + high) / 2
        low, high = (x, high) if x - math.sin(2 * math.pi * x) / (2 * math.pi) < u else (low, x)
    return low


def cosine_share(u: Column) -> Column:
    """A uniform number to one whose density is 1 - cos(2 pi x)."""
    table = F.array(*[F.lit(inverse_cosine(k / GRID)) for k in range(GRID + 1)])
    k = F.floor(u * GRID).cast("int")
    return table[k] + (table[k + 1] - table[k]) * (u * GRID - k)


def workload(spark: SparkSession, queries: int, length: int = 3600, baseline: float = 0.3, period: int = 1200, kinds: int = 22, seed: int = 42) -> DataFrame:
    """id, start_s, query: a baseline share evenly over the length, the rest in peaks of a cosine, one to a period."""
    i, n = F.col("id"), max(1, length // period)
    rows = spark.range(queries).withColumns({"even": uniform(seed, i, F.lit(0)) < baseline, "u": uniform(seed, i, F.lit(1)), "which": F.floor(uniform(seed, i, F.lit(2)) * n), "q": F.floor(uniform(seed, i, F.lit(3)) * kinds) + 1})
    rows = rows.withColumn("peak", cosine_share(F.col("u")))
    start = F.when(F.col("even"), F.floor(F.col("u") * length)).otherwise(F.floor((F.col("which") + F.col("peak")) * period))
    return rows.select("id", F.least(start, F.lit(length - 1)).cast("long").alias("start_s"), F.concat(F.lit("q"), F.col("q")).alias("query"))


def workload_sql(queries: int, length: int = 3600, baseline: float = 0.3, period: int = 1200, kinds: int = 22, seed: int = 42) -> str:
    """The same as a SQL text."""
    u, n = (lambda k: uniform_sql(seed, "id", k)), max(1, length // period)
    table = f"[{', '.join(f'{inverse_cosine(k / GRID)!r}::double' for k in range(GRID + 1))}]"
    return f"""SELECT id, cast(least(CASE WHEN even THEN floor(u * {length}) ELSE floor((which + cs[k] + (cs[k + 1] - cs[k]) * (u * {GRID} - (k - 1))) * {period}) END, {length - 1}) AS bigint) AS start_s, 'q' || q AS query
FROM (SELECT *, cast(floor(u * {GRID}) AS bigint) + 1 AS k, {table} AS cs FROM (SELECT id, {u(0)} < {baseline} AS even, {u(1)} AS u, floor({u(2)} * {n}) AS which, cast(floor({u(3)} * {kinds}) AS bigint) + 1 AS q FROM range({queries}) t(id)) x) y"""


def stage_chains(queries: DataFrame, stages: int = 6, workers: int = 64, seconds: int = 20, most_bytes: int = 1 << 28, seed: int = 42) -> DataFrame:
    """id, stage, start, end, tasks, bytes (log-uniform), consumers, release: a chain for each query, a stage begins when the one before ends."""
    from pyspark.sql import Window

    i, s = F.col("id"), F.col("stage")
    rows = queries.withColumn("count", F.floor(uniform(seed, i, F.lit(9)) * stages).cast("int") + 1).select("id", "start_s", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("stage"))
    pick = lambda k, n: (F.floor(uniform(seed, i, s, F.lit(k)) * n) + 1).cast("long")
    rows = rows.withColumns({"tasks": pick(10, workers), "seconds": pick(11, seconds), "bytes": F.exp(1 + uniform(seed, i, s, F.lit(12)) * (math.log(most_bytes) - 1)).cast("long")})
    w = Window.partitionBy("id").orderBy("stage")
    end = F.col("start_s") + F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("seconds"))
    return rows.select("id", "stage", "start", "end", "tasks", "bytes", F.coalesce(F.lead("tasks").over(w), F.lit(0)).alias("consumers"), F.coalesce(F.lead("end").over(w), F.col("end")).alias("release"))


def synthetic_demand(spark: SparkSession, stages: int, length: int = 3600, baseline: float = 0.3, tasks: int = 20, most: int = 60, seed: int = 42) -> DataFrame:
    """trace, t, demand of random stages whose tasks' lengths scatter normally (a tenth) around the stage's mean."""
    q = workload(spark, stages, length, baseline, seed=seed)
    i, k = F.col("id"), F.col("task")
    rows = q.withColumns({"n": F.floor(uniform(seed, i, F.lit(20)) * tasks).cast("int") + 1, "mean": F.floor(uniform(seed, i, F.lit(21)) * most) + 1}).withColumn("task", F.explode(F.sequence(F.lit(1), F.col("n"))))
    normal = F.sqrt(-2 * F.log(1 - uniform(seed, i, k, F.lit(22)))) * F.cos(2 * math.pi * uniform(seed, i, k, F.lit(23)))
    size = F.greatest(F.floor(F.col("mean") * (1 + normal / 10)), F.lit(1)).cast("long")
    return demand(rows.select(F.lit("synthetic").alias("trace"), F.col("start_s").alias("start"), F.least(F.col("start_s") + size, F.lit(length)).alias("end")))


def expand_profile(trace: DataFrame, profile: DataFrame) -> DataFrame:
    """trace: id, start_s, query; profile: query, stage, start_s (after the stage before), output_bytes, deps, runtimes. A row per stage that runs."""
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    p = profile.select("query", "stage", F.sum("start_s").over(w).alias("offset"), F.size("runtimes").cast("long").alias("tasks"), F.element_at("runtimes", -1).alias("seconds"), "output_bytes", "deps", "runtimes")
    start = F.col("start_s") + F.col("offset")
    return trace.join(p, "query").select("id", "query", "stage", start.alias("start"), (start + F.col("seconds")).alias("end"), "tasks", F.greatest(F.floor(F.col("output_bytes") / F.col("tasks")), F.lit(1)).alias("bytes"), "deps", "runtimes")
