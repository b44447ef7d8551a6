"""Queries through each reader and writer: files made from the tables are read again. And a replayed trace's report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn import runner
from tarn.functions.columns import money
from tarn.session import shared_folder
from tarn.sources import traces
from tarn.sources.tables import Tables
from tarn.workload import dag, queries
from tarn.workload.demand import demand, event_intervals

c = F.col
QUERIES, SQL = {}, {}


def add(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


@add(f"WITH {queries.TRACE_SQL} SELECT start_s, string_agg(query, ',' ORDER BY query) AS queries FROM tr GROUP BY start_s")
def trace_files(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "trace")
    traces.write_trace(queries.event_trace(spark, sf), path)
    return traces.by_second(traces.read_trace(spark, path)).withColumn("queries", F.array_join("queries", ","))


def nation_dag(spark: SparkSession, sf: str) -> DataFrame:
    """A query for each region, a stage for each of its nations: it needs the one before, and each third stage the first one too."""
    stage = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    rows = Tables(spark, sf).nation.select(F.concat(F.lit("r"), "n_regionkey").alias("query"), stage.alias("stage"), (c("n_nationkey") + 1).alias("num_tasks"))
    deps = F.when(c("stage") == 0, F.array()).when((c("stage") % 3 == 0), F.array(F.lit(0), c("stage") - 1)).otherwise(F.array(c("stage") - 1))
    return rows.select("query", "stage", "num_tasks", deps.cast("array<int>").alias("deps"), F.when(c("stage") % 3 == 0, F.array(F.lit(0))).otherwise(F.array()).cast("array<int>").alias("no_drop"))


@add("""SELECT 'r' || n_regionkey AS query, cast(stage AS integer) AS stage, n_nationkey + 1 AS num_tasks, CASE WHEN stage = 0 THEN '' WHEN stage % 3 = 0 THEN '0,' || (stage - 1) ELSE cast(stage - 1 AS varchar) END AS deps,
  CASE WHEN stage % 3 = 0 THEN '0' ELSE '' END AS no_drop FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS stage FROM nation) x""")
def dag_files(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "dags")
    traces.write_dags(nation_dag(spark, sf), path)
    return traces.read_dags(spark, path).withColumns({k: F.array_join(c(k).cast("array<string>"), ",") for k in ("deps", "no_drop")})


@add("SELECT 'r' || n_regionkey AS query, 'TASKS' AS name, cast(max(n_nationkey) + 1 AS bigint) AS value FROM nation GROUP BY n_regionkey")
def dag_file_constants(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "dags")
    traces.write_dags(nation_dag(spark, sf), path)
    return traces.read_constants(spark, path)


@add("""WITH RECURSIVE s AS (SELECT n_regionkey AS q, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS stage, n_nationkey + 1 AS num_tasks FROM nation),
ed AS (SELECT q, stage - 1 AS producer, stage AS consumer FROM s WHERE stage > 0 UNION SELECT q, 0, stage FROM s WHERE stage > 0 AND stage % 3 = 0),
reach(q, top, under) AS (SELECT q, stage, stage FROM s UNION SELECT r.q, r.top, e.producer FROM reach r JOIN ed e ON e.q = r.q AND e.consumer = r.under),
held AS (SELECT r.q, r.top, e.producer, count(DISTINCT e.consumer) AS n FROM reach r JOIN ed e ON e.q = r.q AND e.consumer = r.under GROUP BY 1, 2, 3)
SELECT 'r' || h.q AS query, cast(h.producer AS bigint) AS producer, cast(min(h.top) AS bigint) AS drop_stage FROM held h WHERE h.n = (SELECT count(*) FROM ed WHERE ed.q = h.q AND ed.producer = h.producer) GROUP BY 1, 2""")
def dag_file_drop_map(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "dags")
    traces.write_dags(nation_dag(spark, sf), path)
    return dag.drop_map(traces.read_dags(spark, path))


@add(f"WITH {queries.PROFILE_SQL} SELECT query, cast(stage AS integer) AS stage, cast(start_s AS bigint) AS start_s, cast(output_bytes AS bigint) AS output_bytes, CASE WHEN stage > 0 THEN cast(stage - 1 AS varchar) ELSE '' END AS deps, runtimes FROM pr")
def profile_files(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "profile")
    traces.write_profile(queries.profile(spark, sf), path)
    return traces.read_profile(spark, path).withColumns({k: F.array_join(c(k).cast("array<string>"), ",") for k in ("deps", "runtimes")})


@add(f"""WITH {queries.INTERVALS}, dl AS (SELECT t, sum(d) AS d FROM (SELECT s AS t, 1 AS d FROM iv UNION ALL SELECT e, -1 FROM iv) y GROUP BY t), sp AS (SELECT unnest(range((SELECT min(s) FROM iv), (SELECT max(e) FROM iv))) AS t)
SELECT sp.t, cast(sum(coalesce(d, 0)) OVER (ORDER BY sp.t) AS bigint) AS demand FROM sp LEFT JOIN dl ON sp.t = dl.t""")
def interval_files(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "intervals")
    traces.write_intervals(event_intervals(spark, sf), path)
    return demand(traces.read_intervals(spark, path).withColumn("trace", F.lit("all"))).select("t", "demand")


@add(f"WITH {queries.INTERVALS}, b AS (SELECT trace || '-' || (s % 7) AS executor, s, e FROM iv) SELECT count(DISTINCT executor) AS executors, count(*) AS n, cast(sum(e - s) AS bigint) AS seconds, min(s) AS first, max(e) AS last FROM b")
def busy_files(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "busy")
    rows = event_intervals(spark, sf)
    traces.write_busy(rows.select(F.concat_ws("-", "trace", c("start") % 7).alias("executor"), "start", "end"), path)
    found = traces.read_busy(spark, path)
    return found.agg(F.countDistinct("executor").alias("executors"), F.count("*").alias("n"), F.sum(c("end") - c("start")).alias("seconds"), F.min("start").alias("first"), F.max("end").alias("last"))


@add(f"WITH {queries.curve_sql()} SELECT trace, cast(t - min(t) OVER (PARTITION BY trace) AS bigint) AS t, demand FROM cv")
def demand_files(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "demand")
    traces.write_demand(queries.curve(spark, sf), path)
    return traces.read_demand(spark, path)


@add("SELECT cast(n_nationkey AS bigint) AS nation, n_name AS name, cast(n_regionkey AS bigint) AS region FROM nation")
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """A result as text with bars, then as a client's CSV with a header."""
    bars, client = folder(spark, "bars"), folder(spark, "csv")
    traces.write_result(Tables(spark, sf).nation.select("n_nationkey", "n_name", "n_regionkey"), bars)
    again = spark.read.option("sep", "|").schema("nation long, name string, region long").csv(bars)
    traces.write_result(again, client, sep=",", header=True)
    return spark.read.option("header", True).schema("nation long, name string, region long").csv(client)


TEXTS = {
    "returned": "-- what came back; a comment\nCREATE OR REPLACE TEMPORARY VIEW back AS SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> ';';\nSELECT l_orderkey FROM back /* ; */;",
    "open": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT LIKE '%;%'",
    "wrong": "SELECT nothing FROM no_such_table",
}


def write_texts(spark: SparkSession, path: str) -> None:
    spark.createDataFrame(list(TEXTS.items()), "stem string, value string").write.partitionBy("stem").text(path)


@add("SELECT 'returned' AS query, count(*) AS rows FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'")
def statement_files(spark: SparkSession, sf: str) -> DataFrame:
    """SQL texts read from files; semicolons in literals and comments end nothing."""
    path = folder(spark, "sql")
    write_texts(spark, path)
    Tables(spark, sf).views("lineitem", "orders")
    found = {stem: traces.read_statements(spark, f"{path}/stem={stem}") for stem in ("returned", "open")}
    counts = [runner.run_statements(spark, next(iter(texts.values()))).agg(F.lit(stem).alias("query"), F.count("*").alias("rows")) for stem, texts in found.items()]
    return counts[0].unionByName(counts[1])


@add("""SELECT 'returned' AS query, cast(1 AS integer) AS attempts, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS rows, false AS failed
UNION ALL SELECT 'open', 1, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O'), false UNION ALL SELECT 'open', 1, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O'), false UNION ALL SELECT 'wrong', 2, NULL, true""")
def replay_report(spark: SparkSession, sf: str) -> DataFrame:
    """A timed trace of the texts, replayed a hundred times as fast; a query that fails is tried again, and the report says so."""
    Tables(spark, sf).views("lineitem", "orders")
    run = {stem: (lambda own=traces.statements(text): runner.run_statements(spark, own)) for stem, text in TEXTS.items()}
    report = runner.replay(spark, [(0, "returned"), (1, "open"), (2, "wrong"), (4, "open")], run, speed=100, attempts=2, wait_s=0)
    return report.select("query", "attempts", "rows", c("error").isNotNull().alias("failed"))


@add("SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag")
def stage_files(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate whose rows go through a writer of stages: gzip text with semicolons."""
    path = folder(spark, "stages")
    traces.write_stages(Tables(spark, sf).lineitem.groupBy("l_returnflag").agg(money(F.sum("l_quantity")).alias("quantity")), path)
    return spark.read.option("sep", ";").schema("l_returnflag string, quantity double").csv(path)
