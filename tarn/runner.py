"""Replays a timed trace of queries and reports how each went."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

REPORT = "query string, start_s double, duration_s double, attempts int, rows long, error string"


def run_statements(spark: SparkSession, statements: list[str]) -> DataFrame | None:
    """Runs a query's statements in turn; the last one that returns rows is the result."""
    out = None
    for s in statements:
        df = spark.sql(s)
        out = df if df.columns else out
    return out


def replay(spark: SparkSession, trace: list[tuple[int, str]], queries: dict[str, Callable[[], DataFrame | None]], speed: float = 1.0, threads: int = 8, attempts: int = 5, wait_s: float = 5.0) -> DataFrame:
    """Starts each query at its second (over speed) in a thread of a FAIR pool; a failed one is tried again. A report row per query of the trace."""
    began = time.monotonic()

    def one(item: tuple[int, str]) -> tuple:
        second, name = item
        time.sleep(max(0.0, second / speed - (time.monotonic() - began)))
        start, rows, error, n = time.monotonic(), None, None, 0
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        while n < attempts:
            n += 1
            try:
                df = queries[name]()
                rows, error = (df.count() if df is not None else 0), None
                break
            except Exception as e:  # a report of failures is what is asked for
                error = f"{type(e).__name__}: {str(e)[:200]}"
                if n < attempts:
                    time.sleep(wait_s)
        return name, start - began, time.monotonic() - start, n, rows, error

    with ThreadPoolExecutor(threads) as pool:
        return spark.createDataFrame(list(pool.map(one, sorted(trace))), REPORT)
