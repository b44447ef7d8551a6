"""Queries of the workload part over events, and their SQL. A trace is an event type, a point of time an hour."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.columns import money
from tarn.operators.relational import with_scalar
from tarn.sources.tables import Tables
from tarn.streaming import gauges
from tarn.workload import dag, generate, simulate, strategies
from tarn.workload.demand import demand, event_intervals, max_gauge

c = F.col
QUERIES, SQL = {}, {}
MEAN_LOOKBACK, PERCENTILES, NODE_BYTES = 24, [0.5, 0.8, 0.99], 1 << 20

INTERVALS = """iv AS (SELECT event_type AS trace, cast(floor(epoch(ts) / 3600) AS bigint) AS s, cast(floor(epoch(ts) / 3600) AS bigint) + cast(greatest(ceil(coalesce(value, 0) / 10), 1) AS bigint) AS e,
  cast(greatest(ceil(coalesce(value, 0) / 10), 1) AS bigint) * 1000 AS b FROM events WHERE ts IS NOT NULL)"""


def curve_sql(pad: int = 0, weight: str = "1") -> str:
    return f"""{INTERVALS}, sp AS (SELECT trace, unnest(range(a - {pad}, z)) AS t FROM (SELECT trace, min(s) AS a, max(e) AS z FROM iv GROUP BY trace) x),
dl AS (SELECT trace, t, sum(d) AS d FROM (SELECT trace, s AS t, {weight} AS d FROM iv UNION ALL SELECT trace, e, -{weight} FROM iv) y GROUP BY trace, t),
cv AS (SELECT sp.trace, sp.t, cast(sum(coalesce(d, 0)) OVER (PARTITION BY sp.trace ORDER BY sp.t) AS bigint) AS demand FROM sp LEFT JOIN dl ON sp.trace = dl.trace AND sp.t = dl.t)"""


def add(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def curve(spark: SparkSession, sf: str, pad: int = 0) -> DataFrame:
    return demand(event_intervals(spark, sf), pad=pad)


@add(f"WITH {curve_sql()} SELECT trace, t, demand FROM cv")
def demand_curve(spark: SparkSession, sf: str) -> DataFrame:
    return curve(spark, sf)


@add("SELECT event_type AS trace, cast(floor(epoch(ts) / 3600) AS bigint) AS t, max(value) AS value FROM events GROUP BY 1, 2")
def max_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return max_gauge(Tables(spark, sf).events.withColumnRenamed("event_type", "trace"))


@add(f"WITH {curve_sql()} SELECT trace, t, cast(floor(avg(demand) OVER (PARTITION BY trace ORDER BY t ROWS BETWEEN {MEAN_LOOKBACK - 1} PRECEDING AND CURRENT ROW) * 1.5) AS bigint) AS target FROM cv")
def lookback_mean(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.lookback_mean(curve(spark, sf), MEAN_LOOKBACK, 1.5).select("trace", "t", "target")


@add(f"""WITH {curve_sql(pad=180)} SELECT trace, t, round(quantile_cont(demand, 0.5) OVER w, 6) AS p50, round(quantile_cont(demand, 0.8) OVER w, 6) AS p80, round(quantile_cont(demand, 0.99) OVER w, 6) AS p99
FROM cv WINDOW w AS (PARTITION BY trace ORDER BY t ROWS BETWEEN 179 PRECEDING AND CURRENT ROW)""")
def lookback_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = strategies.lookback_percentiles(curve(spark, sf, pad=180), 180, PERCENTILES)
    return rows.select("trace", "t", *(money(c("p")[k], 6).alias(n) for k, n in enumerate(("p50", "p80", "p99"))))


@add(f"WITH {curve_sql()} SELECT trace, cast(sum(greatest(demand - 20, 0)) AS bigint) AS small, cast(count(*) * 20 AS bigint) AS large FROM cv GROUP BY trace")
def fixed_provisioning(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.fixed_cost(curve(spark, sf), 20)


@add(f"""WITH {curve_sql()}, lv AS (SELECT trace, cast(floor(quantile_cont(demand, 0.8)) AS bigint) AS vms FROM cv GROUP BY trace)
SELECT cv.trace, vms, cast(sum(greatest(demand - vms, 0)) AS bigint) AS small, cast(count(*) * vms AS bigint) AS large FROM cv JOIN lv ON cv.trace = lv.trace GROUP BY cv.trace, vms""")
def static_percentile_provisioning(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.static_percentile_cost(curve(spark, sf), 0.8)


LOOKS = strategies.LOOKBACKS


def _strategy_values() -> str:
    return ", ".join(f"({i}, {p}, {m}::double)" for i, (p, m) in enumerate(strategies.STRATEGIES))


def costs_sql(lookbacks: tuple[int, ...]) -> str:
    shares = "[" + ", ".join(str(p / 100) for p in range(101)) + "]"
    wide = " UNION ALL ".join(f"SELECT trace, t, n, {i} AS lookback_idx, {n} AS lookback, quantile_cont(demand, {shares}) OVER (PARTITION BY trace ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS p FROM nb" for i, n in enumerate(lookbacks))
    return f"""{curve_sql(pad=max(lookbacks))}, nb AS (SELECT cv.trace, t, demand, greatest(t - a + 1, 0) AS n FROM cv JOIN (SELECT trace, min(s) AS a FROM iv GROUP BY trace) f ON cv.trace = f.trace),
st(strategy, i, m) AS (VALUES {_strategy_values()}), wd AS ({wide}),
tg AS (SELECT trace, t, cast(n // 5 AS bigint) AS k, lookback_idx, lookback, strategy, cast(floor(p[i + 1] * m) AS bigint) AS target FROM wd, st WHERE n >= 5 AND n % 5 = 0),
al AS (SELECT *, coalesce(lag(target, 36) OVER (PARTITION BY trace, lookback_idx, strategy ORDER BY k), 0) AS alloc FROM tg),
sc AS (SELECT al.trace, al.t, al.k, al.lookback_idx, al.lookback, al.strategy, al.target, al.alloc, al.alloc * 5 * 4000 + sum(greatest(demand - alloc, 0)) * 18000 AS step_cost
  FROM al JOIN nb ON al.trace = nb.trace AND nb.n > 0 AND (nb.n - 1) // 5 + 1 = al.k GROUP BY al.trace, al.t, al.k, al.lookback_idx, al.lookback, al.strategy, al.target, al.alloc),
cs AS (SELECT *, cast(sum(step_cost) OVER (PARTITION BY trace, lookback_idx, strategy ORDER BY k) AS bigint) AS cost FROM sc)"""


@add(f"WITH {costs_sql(LOOKS)} SELECT trace, cast(lookback AS bigint) AS lookback, cast(strategy AS bigint) AS strategy, max(cost) AS cost FROM cs GROUP BY 1, 2, 3")
def strategy_costs(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.strategy_costs(curve(spark, sf))


CHOICE_SQL = f"""WITH {costs_sql(LOOKS)}, mn AS (SELECT trace, t, k, max(alloc) AS most, max(CASE WHEN lookback = 300 AND strategy = 99 THEN target END) AS cold,
  arg_min((target, lookback, strategy), (cost, lookback_idx, strategy)) AS x, min(cost) AS cost FROM cs GROUP BY trace, t, k)
SELECT trace, t, k, CASE WHEN most = 0 THEN cold ELSE x[1] END AS target, cost, cast(x[2] AS bigint) AS lookback, cast(x[3] AS bigint) AS strategy FROM mn"""


@add(CHOICE_SQL)
def allocator_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The choice over all six lookbacks, with what was chosen."""
    return strategies.cheapest(curve(spark, sf))


@add(f"SELECT trace, t, k, target, cost FROM ({CHOICE_SQL}) c")
def strategy_choice(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.cheapest(curve(spark, sf)).select("trace", "t", "k", "target", "cost")


@add()
def provisioning(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, cost-based (over all six lookbacks) and perfect provisioning: serverless and machine time."""
    points = curve(spark, sf).join(strategies.cheapest(curve(spark, sf)).select("trace", "t", "target"), ["trace", "t"], "left")
    return simulate.provisioning(points, lookback=60, startup=3, min_billing=6).drop("running")


@add(f"""WITH {curve_sql()}, rn AS (SELECT trace, t, demand, cast(floor(avg(demand) OVER (PARTITION BY trace ORDER BY t ROWS BETWEEN {MEAN_LOOKBACK - 1} PRECEDING AND CURRENT ROW)) AS bigint) AS running FROM cv),
gn AS (SELECT *, greatest(least(greatest(demand - lag(demand, 1, 0) OVER w, 0), running) + least(running - lag(running, 1, 0) OVER w, 0), 0) AS gain FROM rn WINDOW w AS (PARTITION BY trace ORDER BY t))
SELECT trace, t, demand, running, cast(least(running, sum(gain) OVER (PARTITION BY trace ORDER BY t)) AS bigint) AS usable FROM gn""")
def usable_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.usable_capacity(strategies.lookback_mean(curve(spark, sf), MEAN_LOOKBACK).withColumnRenamed("target", "running"))


@add(f"WITH {curve_sql(weight='b')} SELECT trace, t, demand FROM cv")
def inflight_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return demand(event_intervals(spark, sf), "bytes")


@add(f"""WITH {curve_sql(weight='b * 1000000')} SELECT trace, t, cast(greatest(floor(floor(quantile_cont(demand, 0.98) OVER (PARTITION BY trace ORDER BY t ROWS BETWEEN 2399 PRECEDING AND CURRENT ROW)) * 2 / 3758096384.0) + 1, 2) AS bigint) AS nodes FROM cv""")
def cache_nodes(spark: SparkSession, sf: str) -> DataFrame:
    heavy = event_intervals(spark, sf).withColumn("bytes", c("bytes") * 1000000)
    return strategies.cache_nodes(demand(heavy, "bytes")).select("trace", "t", "nodes")


@add(f"""WITH {INTERVALS} SELECT trace, cast(sum(b) AS bigint) AS bytes, round(count(*) * 3 * 0.0004 / 1000 + count(*) * 0.010 / 1000 + sum(e - s) * 3600 * 0.08 / 3600, 6) AS dollars FROM iv GROUP BY trace""")
def run_cost(spark: SparkSession, sf: str) -> DataFrame:
    n, seconds = F.count("*"), F.sum(c("end") - c("start")) * 3600
    return event_intervals(spark, sf).groupBy("trace").agg(F.sum("bytes").alias("bytes"), strategies.dollars(n * 3, n, seconds).alias("dollars"))


CHAIN_SQL = f"""w AS ({generate.workload_sql(60, 600, period=200)}), n AS (SELECT id, start_s, unnest(range(1, cast(floor({generate.uniform_sql(42, "id", 9)} * 6) AS bigint) + 2)) AS stage FROM w),
p AS (SELECT *, cast(floor({generate.uniform_sql(42, "id", "stage", 10)} * 64) + 1 AS bigint) AS tasks, cast(floor({generate.uniform_sql(42, "id", "stage", 11)} * 20) + 1 AS bigint) AS seconds,
  cast(floor(exp(1 + {generate.uniform_sql(42, "id", "stage", 12)} * {math.log(1 << 28) - 1!r}::double)) AS bigint) AS bytes FROM n),
e AS (SELECT *, start_s + sum(seconds) OVER (PARTITION BY id ORDER BY stage) AS fin FROM p)"""


@add(generate.workload_sql(1000))
def workload_generator(spark: SparkSession, sf: str) -> DataFrame:
    return generate.workload(spark, 1000)


@add(f"""WITH {CHAIN_SQL} SELECT id, cast(stage AS integer) AS stage, cast(fin - seconds AS bigint) AS start, cast(fin AS bigint) AS "end", tasks, bytes, coalesce(lead(tasks) OVER v, 0) AS consumers, cast(coalesce(lead(fin) OVER v, fin) AS bigint) AS release
FROM e WINDOW v AS (PARTITION BY id ORDER BY stage)""")
def stage_chain_generator(spark: SparkSession, sf: str) -> DataFrame:
    return generate.stage_chains(generate.workload(spark, 60, 600, period=200))


@add(f"""WITH w AS ({generate.workload_sql(200)}), x AS (SELECT *, floor({generate.uniform_sql(42, "id", 21)} * 60) + 1 AS mean, unnest(range(1, cast(floor({generate.uniform_sql(42, "id", 20)} * 20) AS bigint) + 2)) AS task FROM w),
z AS (SELECT *, sqrt(-2 * ln(1 - {generate.uniform_sql(42, "id", "task", 22)})) * cos({2 * math.pi!r}::double * {generate.uniform_sql(42, "id", "task", 23)}) AS normal FROM x),
iv AS (SELECT start_s AS s, least(start_s + cast(greatest(floor(mean * (1 + normal / 10)), 1) AS bigint), 3600) AS e FROM z),
dl AS (SELECT t, sum(d) AS d FROM (SELECT s AS t, 1 AS d FROM iv UNION ALL SELECT e, -1 FROM iv) y GROUP BY t), sp AS (SELECT unnest(range((SELECT min(s) FROM iv), (SELECT max(e) FROM iv))) AS t)
SELECT 'synthetic' AS trace, sp.t, cast(sum(coalesce(d, 0)) OVER (ORDER BY sp.t) AS bigint) AS demand FROM sp LEFT JOIN dl ON sp.t = dl.t""")
def synthetic_demand(spark: SparkSession, sf: str) -> DataFrame:
    return generate.synthetic_demand(spark, 200)


TRACE_SQL = "tr AS (SELECT event_id AS id, (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) // 600000000 AS start_s, 'q' || (event_id % 22 + 1) AS query FROM events WHERE ts IS NOT NULL)"
PROFILE_SQL = """ln AS (SELECT l_orderkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS stage, l_linenumber, cast(ceil(l_quantity / 10) AS bigint) AS seconds, cast(floor(l_extendedprice) AS bigint) * 1000 AS bytes FROM lineitem WHERE l_orderkey < 22),
pr AS (SELECT 'q' || (l_orderkey + 1) AS query, stage, max(l_linenumber) AS start_s, sum(bytes) AS output_bytes, count(*) AS tasks, max(seconds) AS seconds, string_agg(cast(seconds AS varchar), ',' ORDER BY seconds) AS runtimes FROM ln GROUP BY l_orderkey, stage)"""


def event_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is a query of one of 22 kinds; ten minutes are a second."""
    events = Tables(spark, sf).events.where("ts is not null").select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("s"))
    start = F.expr("(s - first) div 600000000")
    return with_scalar(events, events.agg(F.min("s").alias("first"))).select(c("event_id").alias("id"), start.alias("start_s"), F.concat(F.lit("q"), c("event_id") % 22 + 1).alias("query"))


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of 22 kinds of queries, from the lines of as many orders; start_s counts from the stage before, a stage needs that."""
    lines = Tables(spark, sf).lineitem.where("l_orderkey < 22")
    stage = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    rows = lines.select("l_orderkey", stage.alias("stage"), "l_linenumber", F.ceil(c("l_quantity") / 10).cast("int").alias("seconds"), (F.floor("l_extendedprice") * 1000).alias("bytes"))
    grouped = rows.groupBy("l_orderkey", "stage").agg(F.max("l_linenumber").cast("long").alias("start_s"), F.sum("bytes").alias("output_bytes"), F.sort_array(F.collect_list("seconds")).alias("runtimes"))
    deps = F.when(c("stage") > 0, F.array(c("stage") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return grouped.select(F.concat(F.lit("q"), c("l_orderkey") + 1).alias("query"), "stage", "start_s", "output_bytes", deps.alias("deps"), "runtimes")


@add(f"""WITH {TRACE_SQL}, {PROFILE_SQL}, o AS (SELECT *, sum(start_s) OVER (PARTITION BY query ORDER BY stage) AS off FROM pr)
SELECT id, tr.query, cast(stage AS integer) AS stage, cast(tr.start_s + off AS bigint) AS start, cast(tr.start_s + off + seconds AS bigint) AS "end", cast(tasks AS bigint) AS tasks, cast(greatest(floor(output_bytes / tasks), 1) AS bigint) AS bytes, runtimes FROM tr JOIN o ON tr.query = o.query""")
def profile_expansion(spark: SparkSession, sf: str) -> DataFrame:
    rows = generate.expand_profile(event_trace(spark, sf), profile(spark, sf))
    return rows.drop("deps").withColumn("runtimes", F.array_join(c("runtimes").cast("array<string>"), ","))


@add()
def cache_simulation(spark: SparkSession, sf: str) -> DataFrame:
    """All four policies over the stages of the events' queries, with start-up, minimum billing, two nodes at least and eviction."""
    # queries of a trace that are of one kind and start together have the same stages
    alike = event_trace(spark, sf).groupBy(F.concat(F.lit("w"), c("id") % 4).alias("trace"), "start_s", "query").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy("stage")
    stages = generate.expand_profile(alike.withColumn("id", F.struct("trace", "start_s", "query", "n")), profile(spark, sf)).drop("deps", "runtimes")
    stages = stages.withColumns({"consumers": F.coalesce(F.lead("tasks").over(w), F.lit(0)), "release": F.coalesce(F.lead("end").over(w), c("end")), "trace": c("id.trace"), "n": c("id.n")})
    found = simulate.cache_policies(stages, [("perfect", 0), ("fixed", 4), ("mean", 2), ("percentile", 80)], 1 << 28, least=2, evict=True)
    return found.withColumn("dollars", strategies.dollars(c("reads"), c("writes"), c("node_seconds")))


#: Few executors, and the reference's.
SETTINGS = [*range(4, 33, 4), *range(100, 451, 5)]


def arriving(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The stages of each kind of query (kind, stage, deps, runtimes), and the queries (trace, query, arrival, kind)."""
    queries = event_trace(spark, sf).select(F.lit("all").alias("trace"), F.concat("query", F.lit("-"), "id").alias("query"), c("start_s").alias("arrival"), c("query").alias("kind"))
    return profile(spark, sf).select(c("query").alias("kind"), "stage", "deps", "runtimes"), queries


@add()
def executor_sweep(spark: SparkSession, sf: str) -> DataFrame:
    kinds, queries = arriving(spark, sf)
    return simulate.executor_sweep(kinds, SETTINGS, queries)


@add()
def given_executors(spark: SparkSession, sf: str) -> DataFrame:
    """The same queries under as many executors as tasks would run at each second if none had to wait, and one more."""
    stages = generate.expand_profile(event_trace(spark, sf), profile(spark, sf))
    tasks = stages.select(F.lit("all").alias("trace"), "start", F.explode("runtimes").alias("s")).select("trace", "start", (c("start") + c("s")).alias("end"))
    series = demand(tasks).select("trace", "t", (c("demand") + 1).alias("executors"))
    early = with_scalar(F.broadcast(spark.range(1)).select(F.lit("all").alias("trace")), series.agg(F.min("t").alias("a")))
    early = early.where("a > 0").select("trace", F.explode(F.sequence(F.lit(0).cast("long"), c("a") - 1)).alias("t"), F.lit(1).cast("long").alias("executors"))
    kinds, queries = arriving(spark, sf)
    return simulate.given_executors(kinds, series.unionByName(early), queries)


GRAPH = "dag(query, stage, num_tasks, deps) AS (VALUES " + ", ".join(f"('{q}', {s}, {n}, {d}::integer[])" for q, s, n, d, _ in dag.EXAMPLE) + """),
ed AS (SELECT query, unnest(deps) AS producer, stage AS consumer FROM dag)"""


@add(f"""WITH {GRAPH}, o AS (SELECT e.query, e.producer, count(*) AS n, sum(d.num_tasks) AS readers FROM ed e JOIN dag d ON d.query = e.query AND d.stage = e.consumer GROUP BY 1, 2)
SELECT d.query, d.stage, cast(d.num_tasks AS bigint) AS num_tasks, cast(len(d.deps) AS bigint) AS fan_in, coalesce(o.n, 0) AS fan_out, cast(d.num_tasks * coalesce(o.readers, 0) AS bigint) AS shuffle_parts
FROM dag d LEFT JOIN o ON o.query = d.query AND o.producer = d.stage""")
def dag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dag.stage_summary(dag.example(spark))


@add(f"""WITH RECURSIVE {GRAPH}, reach(query, top, under) AS (SELECT query, stage, stage FROM dag UNION SELECT r.query, r.top, e.producer FROM reach r JOIN ed e ON e.query = r.query AND e.consumer = r.under),
held AS (SELECT r.query, r.top, e.producer, count(DISTINCT e.consumer) AS n FROM reach r JOIN ed e ON e.query = r.query AND e.consumer = r.under GROUP BY 1, 2, 3)
SELECT h.query, cast(h.producer AS bigint) AS producer, cast(min(h.top) AS bigint) AS drop_stage FROM held h
WHERE h.n = (SELECT count(*) FROM ed WHERE ed.query = h.query AND ed.producer = h.producer) GROUP BY 1, 2""")
def dag_drop_map(spark: SparkSession, sf: str) -> DataFrame:
    return dag.drop_map(dag.example(spark))


def since_epoch(seconds: int) -> Column:
    return (F.unix_seconds("start") / seconds).cast("long")


@add("SELECT event_type, cast(floor(epoch(ts) / 3600) AS bigint) AS hour, max(value) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_max_gauge(spark: SparkSession, sf: str) -> DataFrame:
    found = gauges.settled(gauges.max_gauge, gauges.stream_table(spark, sf, "events"), Tables(spark, sf).events)
    return found.select("event_type", since_epoch(3600).alias("hour"), "value")


@add("""SELECT event_type, cast(floor(epoch(ts) / 900) AS bigint) * 15 - back AS minute, count(*) AS n, round(sum(value), 2) AS value
FROM events, (VALUES (0), (15), (30), (45)) b(back) WHERE ts IS NOT NULL GROUP BY 1, 2""")
def stream_sliding_load(spark: SparkSession, sf: str) -> DataFrame:
    found = gauges.settled(gauges.sliding_load, gauges.stream_table(spark, sf, "events"), Tables(spark, sf).events)
    return found.select("event_type", since_epoch(60).alias("minute"), "n", money(c("value")).alias("value"))
