"""One small query for each operator of the survey, beside the suite that combines them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.columns import between_days, count_if, day, hash_partition, money, ratio, year
from tarn.operators.relational import combine, distinct_count, exists, not_exists, not_in, split_join, top_k, top_k_per_key, with_scalar
from tarn.session import shared_folder
from tarn.sources.tables import Tables, to_orc

c = F.col
QUERIES, SQL = {}, {}


def micro(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@micro("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01'")
def scan_filter_project(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).lineitem.where((c("l_quantity") >= 49) & between_days("l_shipdate", "1996-01-01", "1997-01-01")).select("l_orderkey", "l_linenumber", "l_quantity")


@micro("SELECT cast((o_custkey % 91397) % 16 AS bigint) AS part, count(*) AS n FROM orders GROUP BY 1")
def hash_partition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).orders.groupBy(hash_partition(c("o_custkey"), 16).alias("part")).agg(F.count("*").alias("n"))


@micro("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def combiner(spark: SparkSession, sf: str) -> DataFrame:
    return combine(Tables(spark, sf).orders.repartition(16, "o_orderkey"), 2).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@micro("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_small_small(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@micro("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50 AND l_shipdate > o_orderdate)")
def join_semi_residual(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return exists(t.orders, t.lineitem.where(c("l_quantity") == 50), (c("l_orderkey") == c("o_orderkey")) & (c("l_shipdate") > c("o_orderdate"))).select("o_orderkey", "o_custkey")


@micro("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)")
def join_anti_residual(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return not_exists(t.orders, t.lineitem, (c("l_orderkey") == c("o_orderkey")) & (c("l_shipdate") > c("o_orderdate"))).select("o_orderkey", "o_custkey")


@micro("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity = 1)")
def join_not_in(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return not_in(t.supplier, "s_suppkey", t.lineitem.where((c("l_discount") == 0.1) & (c("l_quantity") == 1)), "l_suppkey").select("s_suppkey")


@micro("SELECT s_suppkey FROM supplier WHERE nullif(s_nationkey, 3) NOT IN (SELECT nullif(n_nationkey, 99) FROM nation WHERE n_regionkey = 1)")
def join_not_in_null_key(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    sellers, nations = t.supplier.withColumn("k", F.nullif("s_nationkey", F.lit(3))), t.nation.where(c("n_regionkey") == 1)
    return not_in(sellers, "k", nations, "n_nationkey").select("s_suppkey")


@micro("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 6) FROM nation WHERE n_nationkey IN (6, 7))")
def join_not_in_null_list(spark: SparkSession, sf: str) -> DataFrame:
    """The list holds a null, so no row is known not to be in it."""
    t = Tables(spark, sf)
    nations = t.nation.where(c("n_nationkey").isin(6, 7)).withColumn("k", F.nullif("n_nationkey", F.lit(6)))
    return not_in(t.supplier, "s_nationkey", nations, "k").select("s_suppkey")


@micro("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN (VALUES ('F', 1), ('O', 2)) s(status, k) ON o_orderstatus = status GROUP BY 1")
def join_split(spark: SparkSession, sf: str) -> DataFrame:
    """Three keys hold all rows; each is dealt over 8 parts."""
    t = Tables(spark, sf)
    status = t.orders.select(c("o_orderstatus").alias("status"), "o_custkey", "o_orderkey")
    names = spark.createDataFrame([("F", 1), ("O", 2)], "status string, k int")
    rows = split_join(status, names.hint("merge"), ["status"], 8)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@micro("SELECT cast((cast('0x' || substring(md5(c_name), 1, 13) AS bigint) % 91397) % 16 AS bigint) AS part, count(*) AS n FROM customer GROUP BY 1")
def hash_partition_text_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).customer.groupBy(hash_partition(c("c_name"), 16, text=True).alias("part")).agg(F.count("*").alias("n"))


@micro("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate < date '1996-01-01' GROUP BY l_returnflag")
def orc_scan(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem written as ORC, then read like any base table."""
    t = to_orc(Tables(spark, sf), f"{shared_folder(spark)}/orc-{uuid.uuid4().hex}", "lineitem")
    return t.lineitem.where(c("l_shipdate") < day("1996-01-01")).groupBy("l_returnflag").agg(F.count("*").alias("n"), money(F.sum("l_quantity")).alias("quantity"))


@micro("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_theta(spark: SparkSession, sf: str) -> DataFrame:
    n = Tables(spark, sf).nation
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("a_name"), c("b.n_name").alias("b_name"))


@micro("SELECT r_name, n_name FROM region, nation WHERE r_regionkey + n_nationkey = 9")
def join_cross_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides are of fixed size: the regions and nations there are."""
    t = Tables(spark, sf)
    return t.region.crossJoin(t.nation).where(c("r_regionkey") + c("n_nationkey") == 9).select("r_name", "n_name")


@micro("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY c_custkey")
def join_left_count(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return t.customer.join(t.orders.where(c("o_totalprice") > 400000), c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@micro("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def join_scalar(spark: SparkSession, sf: str) -> DataFrame:
    p = Tables(spark, sf).part
    return with_scalar(p, p.agg(F.avg("p_retailprice").alias("least"))).where(c("p_retailprice") > c("least")).select("p_partkey", "p_retailprice")


@micro("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_count(Tables(spark, sf).lineitem, ["l_returnflag"], "l_suppkey", "suppliers")


@micro("SELECT n, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) x GROUP BY n")
def agg_two_level(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("orders"))


@micro("SELECT count(*) AS n, sum(l_quantity) AS q, max(-l_tax) AS m FROM lineitem WHERE l_quantity < 0")
def agg_global_empty(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).lineitem.where(c("l_quantity") < 0).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max(-c("l_tax")).alias("m"))


@micro("SELECT s_nationkey, min(-s_acctbal) AS low, max(-s_acctbal) AS high, round(avg(s_acctbal), 4) AS mean FROM supplier GROUP BY s_nationkey")
def agg_min_max_avg(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).supplier.groupBy("s_nationkey").agg(F.min(-c("s_acctbal")).alias("low"), F.max(-c("s_acctbal")).alias("high"), money(F.avg("s_acctbal"), 4).alias("mean"))


@micro("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def agg_having(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where(c("n") > 15)


@micro("SELECT DISTINCT p_brand, p_type FROM part")
def agg_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).part.select("p_brand", "p_type").distinct()


@micro("SELECT o_orderpriority, cast(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS done, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS share FROM orders GROUP BY 1")
def agg_conditional_ratio(spark: SparkSession, sf: str) -> DataFrame:
    done = c("o_orderstatus") == "F"
    return Tables(spark, sf).orders.groupBy("o_orderpriority").agg(count_if(done).alias("done"), ratio(F.sum(F.when(done, c("o_totalprice")).otherwise(0.0)), F.sum("o_totalprice")).alias("share"))


@micro("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(Tables(spark, sf).orders.select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), c("o_orderkey"))


@micro("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 2")
def sort_top_k_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return top_k_per_key(Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 2, F.desc("o_totalprice"), c("o_orderkey"))


@micro("SELECT p_partkey, p_name LIKE 'hot%' AS starts, p_name LIKE '%ring' AS ends, p_name LIKE '%nv%' AS has, p_name LIKE '%o%r%' AS ordered, p_type NOT LIKE '%SMALL%' AS lacks FROM part")
def expr_like(spark: SparkSession, sf: str) -> DataFrame:
    n = c("p_name")
    return Tables(spark, sf).part.select("p_partkey", n.startswith("hot").alias("starts"), n.endswith("ring").alias("ends"), n.contains("nv").alias("has"), n.like("%o%r%").alias("ordered"), (~c("p_type").like("%SMALL%")).alias("lacks"))


@micro("SELECT c_custkey, substring(c_name, 17, 2) AS code FROM customer WHERE substring(c_name, 17, 2) IN ('13', '31', '07')")
def expr_substring_in(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).customer.select("c_custkey", F.substring("c_name", 17, 2).alias("code")).where(c("code").isin("13", "31", "07"))


@micro("SELECT cast(extract(year FROM o_orderdate) AS bigint) AS y, count(*) AS n FROM orders WHERE o_orderdate >= date '1996-01-31' - INTERVAL '1' MONTH AND o_orderdate < date '1996-01-31' + INTERVAL '1' YEAR GROUP BY 1")
def expr_dates(spark: SparkSession, sf: str) -> DataFrame:
    anchor = day("1996-01-31")
    rows = Tables(spark, sf).orders.where((c("o_orderdate") >= anchor - F.expr("interval 1 month")) & (c("o_orderdate") < anchor + F.expr("interval 1 year")))
    return rows.groupBy(year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@micro("SELECT l_linenumber, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_quantity * 2), 3) AS v, round(sum(least(l_quantity, 10.0)), 2) AS low, round(sum(greatest(l_quantity, 10.0)), 2) AS high FROM lineitem GROUP BY l_linenumber")
def expr_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    v = c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax")) - c("l_quantity") * 2
    return Tables(spark, sf).lineitem.groupBy("l_linenumber").agg(money(F.sum(v), 3).alias("v"), money(F.sum(F.least("l_quantity", F.lit(10.0)))).alias("low"), money(F.sum(F.greatest("l_quantity", F.lit(10.0)))).alias("high"))
