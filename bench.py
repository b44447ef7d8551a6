"""Times the suite's queries and prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    from pyspark.sql import SparkSession

    from tarn import catalog

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    names = os.environ.get("BENCH_QUERIES", "").split() or [n for n in queries if n[0] == "q" or n in ("scanagg", "joinagg", "demand_curve", "lookback_percentiles", "strategy_choice")]
    queries["q1"](spark, sf).write.format("noop").mode("overwrite").save()  # compiles the common code
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
