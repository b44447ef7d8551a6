"""Provisioning targets and their costs, by windows over demand curves.

Costs are whole numbers, in units of 1 / (3600 * 10^5) dollars, so that equal costs are equal and the first strategy wins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prices and sizes that results depend on.
VM_PER_HOUR, SERVERLESS_PER_SECOND = 0.04, 0.00005
VM_UNITS, SERVERLESS_UNITS = 4000, 18000
LOOKBACKS = (180, 300, 600, 900, 1200, 1800)
COLD_LOOKBACK, COLD_PERCENTILE = 300, 99
FREQ, STARTUP_STEPS = 5, 36
CACHE_NODE_BYTES, CACHE_LOOKBACK, CACHE_PERCENTILE = 3.5 * 1024**3, 2400, 0.98

#: (percentile, multiplier): each percentile, then the 80th at 1.1 .. 2.0, then at 1 .. 20.
STRATEGIES = [(p, 1.0) for p in range(101)] + [(80, 1 + k / 10) for k in range(1, 11)] + [(80, float(k)) for k in range(1, 21)]


def last(n: int):
    """The last n points of a trace up to now."""
    return Window.partitionBy("trace").orderBy("t").rowsBetween(1 - n, 0)


def lookback_mean(curve: DataFrame, n: int, multiplier: float = 1.0) -> DataFrame:
    return curve.withColumn("target", F.floor(F.avg("demand").over(last(n)) * multiplier))


def percentile(column: str, shares: list[float]) -> Column:
    """Interpolated percentiles; the array is a literal, as a window needs it."""
    return F.expr(f"percentile({column}, array({', '.join(f'{s}D' for s in shares)}))")


def lookback_percentiles(curve: DataFrame, n: int, shares: list[float]) -> DataFrame:
    """trace, t, demand, and p: the percentiles of the last n points. Points before a trace's first count as zero if the curve is padded by n."""
    return curve.withColumn("p", percentile("demand", shares).over(last(n)))


#: Points of a chunk of a trace; a multiple of FREQ. A task holds a chunk and what its look-backs need of the points before.
CHUNK = 4000


def _chunks(curve: DataFrame, before: int, size: int) -> DataFrame:
    """curve with n (the point's number from 1) and chunk: each point goes to its own chunk and to the next ones that look back to it."""
    ends = curve.groupBy("trace").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    rows = curve.select("trace", "t", "demand").join(ends, "trace").withColumn("n", F.col("t") - F.col("a") + 1)
    of = lambda x: F.floor(x / size)
    chunks = F.sequence(of(F.col("n") - 1), F.least(of(F.col("n") - 1 + before), of(F.col("b") - F.col("a"))))
    return rows.select("trace", "t", "demand", "n", F.explode(chunks).alias("chunk"))


class _Steps:
    """The targets, allocations and step costs of a chunk's decision points: arrays by step, then look-back and strategy."""

    def __init__(self, rows: pd.DataFrame, chunk: int, lookbacks: tuple[int, ...], startup_steps: int, size: int) -> None:
        last, early = int(rows["n"].max()), max(lookbacks) + startup_steps * FREQ
        base = chunk * size - early  # the array's first point is number base + 1; what lies before the trace is zero
        demand = np.zeros(last - base, np.int64)
        demand[rows["n"].to_numpy() - base - 1] = rows["demand"].to_numpy()
        self.k = np.arange(chunk * size // FREQ + 1, last // FREQ + 1)
        steps = np.arange(chunk * size // FREQ + 1 - startup_steps, last // FREQ + 1)
        ends = steps * FREQ - base
        found = []
        for n in lookbacks:
            seen = np.sort(np.lib.stride_tricks.sliding_window_view(demand, n)[ends - n], axis=1) if len(ends) else np.zeros((0, n), np.int64)
            at = [(n - 1) * (p / 100) for p in range(101)]
            low = np.array([int(x) for x in at])
            low_value, high_value = seen[:, low], seen[:, np.minimum(low + 1, n - 1)]
            p = low_value + (high_value - low_value) * (np.array(at) - low)
            found.append(np.floor(p[:, [i for i, _ in STRATEGIES]] * np.array([m for _, m in STRATEGIES])).astype(np.int64))
        all_targets = np.stack(found, axis=1)
        all_targets[steps < 1] = 0
        self.target, self.alloc = all_targets[startup_steps:], all_targets[: len(steps) - startup_steps]
        points = demand[early : early + len(self.k) * FREQ].reshape(-1, FREQ)
        over = sum(np.maximum(points[:, j, None, None] - self.alloc, 0) for j in range(FREQ))
        self.cost = self.alloc * FREQ * VM_UNITS + over * SERVERLESS_UNITS


def chunk_costs(curve: DataFrame, lookbacks: tuple[int, ...] = LOOKBACKS, startup_steps: int = STARTUP_STEPS, size: int = CHUNK) -> DataFrame:
    """trace, chunk, costs: the cost of each (look-back, strategy) over a chunk, VM time and serverless time for what is over the allocation.

    The strategies' arrays are in the order of lookbacks, then STRATEGIES. Percentiles are taken at decision points only.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = int(rows["chunk"].iloc[0])
        x = _Steps(rows, chunk, lookbacks, startup_steps, size)
        return pd.DataFrame([{"trace": rows["trace"].iloc[0], "chunk": chunk, "costs": x.cost.sum(axis=0).ravel()}])

    return _chunks(curve, max(lookbacks) + startup_steps * FREQ, size).groupBy("trace", "chunk").applyInPandas(run, "trace string, chunk long, costs array<long>")


def strategy_costs(curve: DataFrame, lookbacks: tuple[int, ...] = LOOKBACKS, startup_steps: int = STARTUP_STEPS, size: int = CHUNK) -> DataFrame:
    """trace, lookback, strategy, cost: over the whole trace."""
    order = F.array(*(F.struct(F.lit(n).cast("long").alias("lookback"), F.lit(s).cast("long").alias("strategy")) for n in lookbacks for s in range(len(STRATEGIES))))
    each = chunk_costs(curve, lookbacks, startup_steps, size).select("trace", F.posexplode("costs").alias("at", "cost")).groupBy("trace", "at").agg(F.sum("cost").alias("cost"))
    return each.withColumn("x", order[F.col("at")]).select("trace", "x.lookback", "x.strategy", "cost")


def cheapest(curve: DataFrame, lookbacks: tuple[int, ...] = LOOKBACKS, startup_steps: int = STARTUP_STEPS, size: int = CHUNK) -> DataFrame:
    """trace, t, k, target, cost, lookback, strategy at each FREQ-th point: of the least cost so far; of equal ones the first lookback's
    first strategy. While nothing is allocated yet anywhere, the 99th percentile of the cold lookback.

    The costs of the chunks before come by a sum over a trace's chunks, which are few; then each chunk is worked through on its own.
    """
    cold = lookbacks.index(COLD_LOOKBACK) if COLD_LOOKBACK in lookbacks else None

    def before(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        sums = np.cumsum(np.stack(rows["costs"].to_list()), axis=0)
        return pd.DataFrame({"trace": rows["trace"], "chunk": rows["chunk"], "costs": [np.zeros_like(sums[0]), *sums[:-1]]})

    def run(key: tuple, rows: pd.DataFrame, spent: pd.DataFrame) -> pd.DataFrame:
        x = _Steps(rows, int(key[1]), lookbacks, startup_steps, size)
        n, width = len(x.k), len(lookbacks) * len(STRATEGIES)
        total = np.cumsum(x.cost.reshape(n, width), axis=0) + np.asarray(spent["costs"].iloc[0])
        best = total.argmin(axis=1) if n else np.zeros(0, np.int64)
        target = x.target.reshape(n, width)[np.arange(n), best]
        if cold is not None:
            target = np.where((x.alloc == 0).all(axis=(1, 2)), x.target[:, cold, COLD_PERCENTILE], target)
        at = rows["t"].iloc[0] - rows["n"].iloc[0] + x.k * FREQ
        return pd.DataFrame({"trace": key[0], "t": at, "k": x.k, "target": target, "cost": total[np.arange(n), best], "lookback": np.array(lookbacks)[best // len(STRATEGIES)], "strategy": best % len(STRATEGIES)})

    spent = chunk_costs(curve, lookbacks, startup_steps, size).groupBy("trace").applyInPandas(before, "trace string, chunk long, costs array<long>")
    points = _chunks(curve, max(lookbacks) + startup_steps * FREQ, size).groupBy("trace", "chunk")
    return points.cogroup(spent.groupBy("trace", "chunk")).applyInPandas(run, "trace string, t long, k long, target long, cost long, lookback long, strategy long")


def fixed_cost(curve: DataFrame, vms: int) -> DataFrame:
    return curve.groupBy("trace").agg(F.sum(F.greatest(F.col("demand") - vms, F.lit(0))).alias("small"), (F.count("*") * vms).alias("large"))


def static_percentile_cost(curve: DataFrame, share: float) -> DataFrame:
    """The curve's own percentile, kept throughout. One row per trace is joined back."""
    level = curve.groupBy("trace").agg(F.floor(F.percentile("demand", F.lit(share))).alias("vms"))
    return curve.join(level, "trace").groupBy("trace", "vms").agg(F.sum(F.greatest(F.col("demand") - F.col("vms"), F.lit(0))).alias("small"), (F.count("*") * F.col("vms")).alias("large"))


def usable_capacity(curve: DataFrame) -> DataFrame:
    """trace, t, demand, running to the same and usable: what new demand has taken up of running, less what has stopped."""
    w = Window.partitionBy("trace").orderBy("t")
    rise = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    zero = F.lit(0)
    gain = F.greatest(F.least(F.greatest(rise("demand"), zero), F.col("running")) + F.least(rise("running"), zero), zero)
    rows = curve.withColumn("gain", gain)
    return rows.withColumn("usable", F.least("running", F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("gain")


def cache_nodes(bytes_curve: DataFrame, lookback: int = CACHE_LOOKBACK) -> DataFrame:
    """trace, t, demand, nodes: twice the 98th percentile of the bytes in flight, in nodes, and one more; two at least."""
    p = F.floor(F.expr(f"percentile(demand, {CACHE_PERCENTILE}D)").over(last(lookback)))
    return bytes_curve.withColumn("nodes", F.greatest(F.floor(p * 2 / CACHE_NODE_BYTES) + 1, F.lit(2)))


def dollars(reads: Column, writes: Column, node_seconds: Column) -> Column:
    """What an object store's requests and cache nodes cost."""
    return F.round(reads * 0.0004 / 1000 + writes * 0.010 / 1000 + node_seconds * 0.08 / 3600, 6)
