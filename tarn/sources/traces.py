"""Text formats around workloads: traces, stage graphs, profiles, demand curves, and SQL files. Gzip is transparent to Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Lines second,query: start_s, query."""
    return spark.read.csv(path, schema="start_s long, query string")


def by_second(trace: DataFrame) -> DataFrame:
    return trace.groupBy("start_s").agg(F.sort_array(F.collect_list("query")).alias("queries"))


def read_dags(spark: SparkSession, path: str) -> DataFrame:
    """Files of NAME=n lines, a CONSTANTS= line, then stage:tasks:deps:no_drop lines (lists by commas): query, stage, num_tasks, deps, no_drop.

    The query is the file's name up to its first point; files whose stem has more than three characters are skipped.
    """
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("query"))
    parts = lines.where(F.length("query") <= 3).where(F.col("value").rlike(r"^\d+:")).select("query", F.split("value", ":").alias("p"))
    ints = lambda k: F.transform(F.filter(F.split(F.coalesce(F.get("p", F.lit(k)), F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    return parts.select("query", F.col("p")[0].cast("int").alias("stage"), F.col("p")[1].cast("int").alias("num_tasks"), ints(2).alias("deps"), ints(3).alias("no_drop"))


def read_constants(spark: SparkSession, path: str) -> DataFrame:
    """The NAME=n lines of the same files: query, name, value."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("query"), F.regexp_extract("value", r"^([A-Za-z_]\w*)=(\d+)$", 1).alias("name"), F.regexp_extract("value", r"=(\d+)$", 1).alias("v"))
    return lines.where("name <> ''").select("query", "name", F.col("v").cast("long").alias("value"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Lines query,stage,start,output_bytes,dep:dep,rt,rt,...: query (qN), stage, start_s, output_bytes, deps, runtimes."""
    p = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", ",").alias("p"))
    deps = F.transform(F.filter(F.split(F.col("p")[4], ":"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    times = F.transform(F.filter(F.slice("p", 6, F.greatest(F.size("p") - 5, F.lit(0))), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    return p.select(F.concat(F.lit("q"), F.trim(F.col("p")[0])).alias("query"), F.col("p")[1].cast("int").alias("stage"), F.col("p")[2].cast("long").alias("start_s"), F.col("p")[3].cast("long").alias("output_bytes"), deps.alias("deps"), times.alias("runtimes"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Lines start,end: the file's name as trace, start, end."""
    return spark.read.csv(path, schema="start long, end long").select(F.col("_metadata.file_name").alias("trace"), "start", "end")


def read_demand(spark: SparkSession, path: str) -> DataFrame:
    """Three lines of head and one with the length, then a value a line: trace (that of a folder trace=..., else the file's name), t, demand. The
    line order comes from a whole-file read, a curve being short."""
    rows = spark.read.text(path, wholetext=True)
    name = F.col("trace").cast("string") if "trace" in rows.columns else F.col("_metadata.file_name")
    files = rows.select(name.alias("trace"), F.slice(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n"), 5, (1 << 31) - 1).alias("v"))
    return files.select("trace", F.posexplode("v").alias("t", "d")).select("trace", F.col("t").cast("long").alias("t"), F.trim("d").cast("long").alias("demand"))


def read_busy(spark: SparkSession, path: str) -> DataFrame:
    """An executor a line, as a list of its busy times: [(start, end), ...] or [[start, end], ...]. executor (numbered by file and line), start, end."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).where("trim(value) <> ''")
    pairs = F.expr(r"regexp_extract_all(value, '[(\\[]\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*[)\\]]', 0)")
    part = lambda k: F.regexp_extract("p", r"(-?\d+)\s*,\s*(-?\d+)", k).cast("long")
    return rows.select(F.concat_ws(":", "file", "line").alias("executor"), F.explode(pairs).alias("p")).select("executor", part(1).alias("start"), part(2).alias("end"))


def write_trace(trace: DataFrame, path: str) -> None:
    trace.select("start_s", "query").write.mode("overwrite").option("compression", "gzip").csv(path)


def write_stages(stages: DataFrame, path: str) -> None:
    """One line per stage, fields by semicolons, lists by commas."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in stages.schema]
    stages.select(*flat).write.mode("overwrite").option("compression", "gzip").option("sep", ";").csv(path)


def write_demand(curve: DataFrame, path: str) -> None:
    """A gzip file for each trace in a folder trace=...: what read_demand reads. A curve is a row of its own, as long as the time covered."""
    lines = curve.groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("t", "demand"))).alias("v"))
    text = F.concat_ws("\n", F.size("v").cast("string"), F.lit("trace,t,demand"), F.lit("demand"), F.size("v").cast("string"), F.array_join(F.transform("v", lambda x: x["demand"].cast("string")), "\n"))
    lines.select("trace", text.alias("value")).write.mode("overwrite").partitionBy("trace").option("compression", "gzip").text(path)


def write_intervals(intervals: DataFrame, path: str) -> None:
    intervals.select("start", "end").write.mode("overwrite").csv(path)


def write_busy(busy: DataFrame, path: str) -> None:
    """busy: executor, start, end. A line for each executor, by its name."""
    lines = busy.groupBy("executor").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("v"))
    pair = lambda x: F.concat(F.lit("("), x["start"].cast("string"), F.lit(", "), x["end"].cast("string"), F.lit(")"))
    lines.select(F.concat(F.lit("["), F.array_join(F.transform("v", pair), ", "), F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def write_profile(profile: DataFrame, path: str) -> None:
    """profile: query (qN), stage, start_s, output_bytes, deps, runtimes. What read_profile reads."""
    join = lambda c, sep: F.array_join(F.col(c).cast("array<string>"), sep)
    profile.select(F.concat_ws(",", F.substring("query", 2, 9), "stage", "start_s", "output_bytes", join("deps", ":"), join("runtimes", ",")).alias("value")).write.mode("overwrite").text(path)


def write_dags(dag: DataFrame, path: str) -> None:
    """dag: query (up to three characters), stage, num_tasks, deps, no_drop. A file QUERY.query_data for each query, as read_dags reads them.

    The names of the files are the queries', so the driver writes them; queries are few and their stages too.
    """
    spark, join = dag.sparkSession, lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    line = F.concat_ws(":", "stage", "num_tasks", join("deps"), join("no_drop"))
    rows = dag.groupBy("query").agg(F.max("num_tasks").alias("n"), F.sort_array(F.collect_list(F.struct("stage", line.alias("line")))).alias("v")).toLocalIterator()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in rows:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{r['query']}.query_data")
        out = where.getFileSystem(conf).create(where, True)
        out.write(bytearray("\n".join([f"TASKS={r.n}", "CONSTANTS=", *(x.line for x in r.v), ""]).encode()))
        out.close()


def write_result(df: DataFrame, path: str, sep: str = "|", header: bool = False) -> None:
    """Rows as text, fields by a bar; with a comma and a header, the CSV that a client gets."""
    df.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


#: A literal, a quoted name, a comment, the end of a statement, or any other character.
LEXEMES = re.compile(r"('(?:[^']|'')*(?:'|$)|\"(?:[^\"]|\"\")*(?:\"|$)|`[^`]*(?:`|$))|(--[^\n]*|/\*.*?(?:\*/|$))|(;)|(.)", re.S)


def statements(text: str) -> list[str]:
    """A text cut at the semicolons that are in no literal, name or comment; comments go, blank statements too."""
    found = [""]
    for quoted, comment, end, other in LEXEMES.findall(text):
        if end:
            found.append("")
        else:
            found[-1] += quoted + other + (" " if comment else "")
    return [s.strip() for s in found if s.strip()]


def read_statements(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """SQL files of a folder by stem, each cut into statements. The texts come to the driver, which is to run them."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(\.[^.]*)?$", 1).alias("stem"), "value").collect()
    return {r.stem: statements(r.value) for r in files}
