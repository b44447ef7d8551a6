"""The workload part against plain Python."""

import gzip
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn import runner
from tarn.sources import traces
from tarn.sources.tables import Tables
from tarn.streaming import gauges
from tarn.workload import dag, generate, simulate, strategies
from tarn.workload.demand import demand


def rows_of(seed, n=40):
    r = random.Random(seed)
    return [(r.choice("ab"), s := r.randint(0, 60), s + r.randint(0, 25), r.randint(1, 9)) for _ in range(n)]


def test_demand_against_counting(spark):
    rows = rows_of(1)
    got = {(r.trace, r.t): r.demand for r in demand(spark.createDataFrame(rows, "trace string, start long, end long, bytes long"), "bytes", pad=2).collect()}
    for (trace, t), v in got.items():
        assert v == sum(b for x, s, e, b in rows if x == trace and s <= t < e)
    for trace in "ab":
        own = [r for r in rows if r[0] == trace]
        assert {t for x, t in got if x == trace} == set(range(min(r[1] for r in own) - 2, max(r[2] for r in own)))


def test_percentiles_are_interpolated_over_zero_padding(spark):
    values = [3, 8, 1, 9, 4, 4, 7]
    curve = spark.createDataFrame([("a", k, v) for k, v in enumerate([0] * 4 + values)], "trace string, t long, demand long")
    got = sorted((r.t, r.p) for r in strategies.lookback_percentiles(curve, 4, [0.25, 0.98]).where("t >= 4").collect())
    for k, (_, p) in enumerate(got):
        assert p == pytest.approx(np.percentile(([0] * 4 + values)[k + 1 : k + 5], [25, 98]))


@pytest.mark.parametrize("chunk", [4000, 20, 5])
def test_choice_against_brute_force(spark, chunk):
    r = random.Random(2)
    values, looks, lag = [r.randint(0, 30) for _ in range(63)], (10, 20), 3
    curve = spark.createDataFrame([("a", 1000 + k, v) for k, v in enumerate(values)], "trace string, t long, demand long")
    got = {x.k: x for x in strategies.cheapest(curve, looks, lag, chunk).collect()}
    assert sorted(got) == list(range(1, 13)) and all(x.t == 999 + 5 * k for k, x in got.items())
    cost, past = {}, {}
    for k in range(1, len(values) // 5 + 1):
        best = None
        for i, n in enumerate(looks):
            seen = ([0] * n + values[: 5 * k])[-n:]
            seen = sorted(seen)
            at = [(n - 1) * (q / 100) for q in range(101)]
            p = [seen[int(x)] + (seen[min(int(x) + 1, n - 1)] - seen[int(x)]) * (x - int(x)) for x in at]
            assert p == pytest.approx(np.percentile(seen, range(101)))
            for s, (q, m) in enumerate(strategies.STRATEGIES):
                target = int(p[q] * m)
                past.setdefault((i, s), []).append(target)
                alloc = past[i, s][-1 - lag] if len(past[i, s]) > lag else 0
                cost[i, s] = cost.get((i, s), 0) + alloc * 5 * strategies.VM_UNITS + sum(max(0, d - alloc) for d in values[5 * k - 5 : 5 * k]) * strategies.SERVERLESS_UNITS
                if best is None or cost[i, s] < best[0]:
                    best = cost[i, s], target, n, s
        assert got[k].cost == best[0] and (k <= lag or (got[k].target, got[k].lookback, got[k].strategy) == best[1:])
    whole = {(x.lookback, x.strategy): x.cost for x in strategies.strategy_costs(curve, looks, lag, chunk).collect()}
    assert whole == {(looks[i], s): v for (i, s), v in cost.items()}


def test_provisioning_machine():
    d = np.array([0] * 5 + [10] * 40 + [0] * 40)
    r = simulate.provision(d, lambda t, _: 10 if t < 40 else 0, startup=7, min_billing=20)
    assert r[11] == 0 and r[12] == 10 and r[30] == 10 and r[44] == 10 and r[46] == 0 and r.max() == 10
    assert simulate.costs(d, np.zeros_like(d)) == (400, 0)
    steady = np.full(30, 4)
    assert simulate.costs(steady, simulate.provision(steady, simulate.perfect_target(steady, horizon=6), 0, 6, 1))[0] <= 4


def test_usable_as_windows(spark):
    r = random.Random(3)
    d, n = [r.randint(0, 9) for _ in range(50)], [r.randint(0, 9) for _ in range(50)]
    curve = spark.createDataFrame([("a", k, x, y) for k, (x, y) in enumerate(zip(d, n, strict=True))], "trace string, t long, demand long, running long")
    assert [x.usable for x in strategies.usable_capacity(curve).orderBy("t").collect()] == simulate.usable(np.array(d), np.array(n)).tolist()


def test_schedule_by_hand():
    stages = [("q", 0, 0, [], [3, 3]), ("q", 0, 1, [0], [2]), ("r", 1, 0, [], [1])]
    assert simulate.schedule(stages, 2) == ({"q": 5, "r": 3}, 5, 10)
    assert simulate.schedule(stages, 3) == ({"q": 5, "r": 1}, 5, 15)
    assert simulate.schedule(stages, 1)[0] == {"q": 8, "r": 8}
    assert simulate.schedule(stages, [0, 0, 2])[0] == {"q": 7, "r": 5}
    assert simulate.schedule(stages, [2, 1, 1, 1, 2])[1:] == (5, 2 * 3 + 1 + 2)  # none leaves while both work


def by_the_clock(stages, wanted):
    """Second by second: ends, executors, then tasks to idle executors in order of arrival, stage and task."""
    state = {}
    for q, arrival, stage, deps, tasks in sorted(stages, key=lambda s: (s[1], s[0], s[2])):
        state.setdefault((arrival, q), {})[stage] = {"deps": set(deps), "todo": list(tasks), "running": 0}
    busy, idle, t, latency, spent = [], 0, 0, {}, 0
    while True:
        for end, x in [b for b in busy if b[0] == t]:
            busy.remove((end, x))
            x["running"] -= 1
            idle += 1
        want = wanted[min(t, len(wanted) - 1)]
        total = idle + len(busy)
        idle = idle + want - total if total < want else max(0, idle - (total - want))
        for (arrival, q), own in sorted(state.items(), key=lambda x: x[0]):
            done = {s for s, x in own.items() if not x["todo"] and not x["running"]}
            if arrival <= t and len(done) == len(own) and q not in latency:
                latency[q] = t - arrival
            for stage in sorted(own):
                x = own[stage]
                while arrival <= t and x["deps"] <= done and x["todo"] and idle:
                    busy.append((t + max(1, x["todo"].pop(0)), x))
                    x["running"] += 1
                    idle -= 1
        if len(latency) == len(state) and t >= len(wanted) - 1:
            return latency, spent
        spent += idle + len(busy)
        t += 1


def test_schedule_as_by_the_clock():
    r = random.Random(11)
    for _ in range(60):
        stages = []
        for q in range(r.randint(1, 6)):
            arrival = r.randint(0, 12)
            stages += [(f"q{q}", arrival, k, [d for d in range(k) if r.random() < 0.5], [r.randint(1, 6) for _ in range(r.randint(1, 4))]) for k in range(r.randint(1, 4))]
        wanted = [r.randint(0, 4) for _ in range(r.randint(1, 20))] + [r.randint(1, 4)]
        for series in (wanted, wanted[-1:]):
            latency, end, spent = simulate.schedule(stages, series if len(series) > 1 else series[0])
            want, clock = by_the_clock(stages, series)
            assert latency == want
            if end >= len(series) - 1:
                assert spent == clock


def test_cache_by_hand():
    stages = [(0, 2, 2, 100, 3, 5), (2, 5, 3, 0, 0, 5)]
    free = dict(startup=0, min_billing=0)
    assert simulate.simulate_cache(stages, "fixed", 1, 1000, **free) == (0, 0, 6, 200)
    assert simulate.simulate_cache(stages, "fixed", 0, 1000, **free)[:2] == (6, 2)
    # a node for so few bytes costs more than the store's requests, unless these are many
    assert simulate.simulate_cache(stages, "perfect", 0, 1000)[:3] == (6, 2, 0)
    many = [(0, 2, 2000, 100, 3, 5), (2, 5, 3, 0, 0, 5)]
    assert simulate.simulate_cache(many, "perfect", 0, 1 << 20)[:3] == (0, 0, 5)
    assert simulate.simulate_cache(stages, "mean", 1, 1000, least=2, **free) == (0, 0, 12, 200)


def test_cache_nodes_start_late_leave_late_and_come_back():
    cache = simulate._Cache(100, startup=3, min_billing=5)
    cache.want(2, 0)
    cache.tick(2)
    assert cache.billed() == 0 and cache.starting == [(3, 2)]
    cache.tick(3)
    assert [n.since for n in cache.active] == [3, 3]
    cache.active[0].held[0, 0], cache.active[0].room = 40, 60
    cache.want(0, 4)  # both are billed still: one for its data, both for their first seconds
    assert not cache.active and len(cache.leaving) == 2
    cache.tick(8)
    assert [n.number for n in cache.leaving] == [0]
    cache.want(1, 9)
    assert [n.number for n in cache.active] == [0] and not cache.leaving and not cache.starting
    cache.want(0, 10)
    cache.leaving[0].drop((0, 0))
    cache.tick(11)
    assert cache.billed() == 0


def test_cache_evicts_the_largest_share():
    # three nodes full of two large shares each; a small stage then finds room on its third node only by eviction
    stages = [(0, 9, 6, 100, 6, 9), (1, 9, 2, 30, 2, 9), (9, 9, 1, 0, 0, 9)]
    plain = simulate.simulate_cache(stages, "fixed", 3, 200, startup=0, min_billing=0)
    evicted = simulate.simulate_cache(stages, "fixed", 3, 200, startup=0, min_billing=0, evict=True)
    assert plain[:2] == (4, 2)
    assert evicted[0] < plain[0] and evicted[1] == evicted[0]  # what is evicted is written, and read, once


def test_generators(spark):
    w = generate.workload(spark, 4000)
    assert w.where("start_s < 0 or start_s >= 3600").count() == 0 and w.select("query").distinct().count() == 22
    assert w.exceptAll(generate.workload(spark, 4000)).count() == 0
    middle = w.where("pmod(start_s, 1200) between 400 and 799").count() / 4000
    assert middle > 0.45  # a third of the even ones, and what a cosine has in its middle third
    chains = generate.stage_chains(w)
    assert chains.where("start >= end or release < end or (consumers = 0) <> (release = end)").count() == 0


def test_drop_map_and_summary(spark):
    d = dag.example(spark)
    got = {(r["query"], r.producer): r.drop_stage for r in dag.drop_map(d).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("b", 0): 2, ("b", 1): 2, ("b", 2): 5, ("b", 3): 4, ("b", 4): 5, ("b", 5): 6}
    b2 = next(r for r in dag.stage_summary(d).collect() if (r["query"], r.stage) == ("b", 2))
    assert (b2.fan_in, b2.fan_out, b2.shuffle_parts) == (2, 2, 16 * 32)


def test_text_formats(spark, tmp_path):
    (tmp_path / "t.queries").write_text("4,q21\n4,q3\n9,q1\n")
    assert {(r.start_s, tuple(r.queries)) for r in traces.by_second(traces.read_trace(spark, str(tmp_path / "t.queries"))).collect()} == {(4, ("q21", "q3")), (9, ("q1",))}
    dags = tmp_path / "dags"
    dags.mkdir()
    (dags / "q3.query_data").write_text("PARTS=64\nCONSTANTS=64,64\n0:17::\n1:72::\n2:64:0,1:1\n")
    (dags / "long_name.query_data").write_text("0:1::\n")
    got = {r.stage: (r["query"], r.num_tasks, r.deps, r.no_drop) for r in traces.read_dags(spark, str(dags)).collect()}
    assert got == {0: ("q3", 17, [], []), 1: ("q3", 72, [], []), 2: ("q3", 64, [0, 1], [1])}
    assert {(r.name, r.value) for r in traces.read_constants(spark, str(dags)).collect()} == {("PARTS", 64)}
    (tmp_path / "p.txt").write_text("1,0,0,4000,,3,4,5\n1,1,5,100,0,2\n2,0,0,9,0:1,6\n")
    p = traces.read_profile(spark, str(tmp_path / "p.txt")).orderBy("query", "stage").collect()
    assert p[0].runtimes == [3, 4, 5] and p[0].deps == [] and p[2].deps == [0, 1]
    with gzip.open(tmp_path / "d.gz", "wt") as f:
        f.write("a\nb\nc\n3\n5\n6\n7\n")
    assert [(r.t, r.demand) for r in traces.read_demand(spark, str(tmp_path / "d.gz")).orderBy("t").collect()] == [(0, 5), (1, 6), (2, 7)]
    (tmp_path / "i.csv").write_text("1,5\n2,3\n")
    assert demand(traces.read_intervals(spark, str(tmp_path / "i.csv"))).count() == 4
    traces.write_trace(generate.workload(spark, 20), str(tmp_path / "w"))
    assert traces.read_trace(spark, str(tmp_path / "w")).count() == 20
    traces.write_stages(dag.example(spark), str(tmp_path / "s"))
    traces.write_result(spark.range(3).withColumn("x", F.lit("y")), str(tmp_path / "r"))
    assert {r.value for r in spark.read.text(str(tmp_path / "r")).collect()} == {"0|y", "1|y", "2|y"}
    traces.write_demand(demand(spark.createDataFrame(rows_of(4), "trace string, start long, end long, bytes long")), str(tmp_path / "c"))
    assert set(spark.read.csv(str(tmp_path / "c")).columns) >= {"trace"}


def test_statements_and_replay(spark, sf, tmp_path):
    (tmp_path / "q1.sql").write_text("-- a comment; with a mark\ncreate or replace temporary view v as select 1 as x;\nselect x from v;\n\n;")
    (tmp_path / "bad.sql").write_text("select nothing from nowhere")
    found = traces.read_statements(spark, str(tmp_path))
    assert len(found["q1"]) == 2
    report = runner.replay(spark, [(0, "q1"), (1, "q1"), (0, "bad")], {k: lambda v=v: runner.run_statements(spark, v) for k, v in found.items()}, speed=10, attempts=2, wait_s=0).collect()
    by = {r["query"]: r for r in report}
    assert len(report) == 3 and by["q1"].rows == 1 and by["q1"].error is None and by["bad"].attempts == 2 and by["bad"].error


def test_streams_equal_batches(spark, sf, tmp_path):
    events = Tables(spark, sf).events
    events.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    for name, f in (("gauge", gauges.max_gauge), ("load", gauges.sliding_load)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        got, want = spark.table(name), f(events)
        assert got.count() == want.count() > 0 and got.select(F.round("value", 6)).exceptAll(want.select(F.round("value", 6))).count() == 0


def test_streams_close_windows_and_drop_what_is_too_late(spark, tmp_path):
    import shutil

    path = tmp_path / "events.parquet"
    path.mkdir()
    rows = lambda *items: spark.createDataFrame([(k, v, h) for k, v, h in items], "event_type string, value double, h int").selectExpr("event_type", "value", "timestamp_ntz'2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, h) as ts")
    (tmp_path / "events.parquet_old").mkdir()
    rows(("a", 99.0, 0)).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet_old"))
    schema = rows(("a", 1.0, 0)).schema
    empty = spark.readStream.schema(schema).parquet(f"{tmp_path}/[e]vents.parquet")
    assert gauges.settled(gauges.max_gauge, empty, spark.createDataFrame([], schema)).collect() == []
    for k, part in enumerate((rows(("a", 1.0, 0), ("a", 5.0, 9)), rows(("b", 3.0, 10)), rows(("a", 7.0, 0), ("a", 2.0, 11)))):
        part.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"part{k}"))
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            shutil.copy(f, path / f"{k}.parquet")
        time.sleep(0.05)  # files are read in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/[e]vents.parquet")
    got = {(r.event_type, r.start.hour): r.value for r in gauges.settled(gauges.max_gauge, stream, spark.read.parquet(str(path))).collect()}
    # the third file's row of hour 0 comes ten hours late and its window is closed
    assert got == {("a", 0): 1.0, ("a", 9): 5.0, ("b", 10): 3.0, ("a", 11): 2.0}
