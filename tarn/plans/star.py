"""The decision-support suite over the star schema, through the DataFrame API.

Small dimensions are not hinted: Spark broadcasts them while their size is under its threshold and shuffles beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.columns import between_days, count_if, day, money, ratio, revenue, year
from tarn.operators.relational import distinct_count, exists, not_exists, not_in, top_k, with_scalar
from tarn.sources.tables import Tables

c = F.col


def q1(spark: SparkSession, sf: str) -> DataFrame:
    charge = revenue() * (1 + c("l_tax"))
    return (
        Tables(spark, sf).lineitem.where(c("l_shipdate") <= day("1998-08-06")).groupBy("l_returnflag", "l_linestatus")
        .agg(money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum("l_extendedprice")).alias("sum_base_price"), money(F.sum(revenue()), 4).alias("sum_disc_price"), money(F.sum(charge)).alias("sum_charge"),
             money(F.avg("l_quantity"), 4).alias("avg_qty"), money(F.avg("l_extendedprice"), 4).alias("avg_price"), money(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))
        .orderBy("l_returnflag", "l_linestatus")
    )


def q2(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    place = t.nation.join(t.region.where(c("r_name") == "AFRICA"), c("n_regionkey") == c("r_regionkey"))
    sellers = t.supplier.join(place, c("s_nationkey") == c("n_nationkey"))
    parts = t.part.where((c("p_size") <= 15) & c("p_type").endswith("LARGE")).select("p_partkey", "p_type")
    wanted = t.offers(parts, sellers).withColumn("least", F.min("ps_supplycost").over(Window.partitionBy("ps_partkey"))).where(c("ps_supplycost") == c("least"))
    rows = wanted.join(sellers, c("ps_suppkey") == c("s_suppkey")).join(parts, c("ps_partkey") == c("p_partkey"))
    return top_k(rows.select("s_acctbal", "s_name", "n_name", "p_partkey", "p_type"), 100, F.desc("s_acctbal"), c("n_name"), c("s_name"), c("p_partkey"))


def q3(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    rows = (
        t.customer.where(c("c_mktsegment") == "BUILDING").join(t.orders.where(c("o_orderdate") < day("1995-03-01")), c("c_custkey") == c("o_custkey"))
        .join(t.lineitem.where(c("l_shipdate") > day("1995-03-01")), c("l_orderkey") == c("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(money(F.sum(revenue()), 4).alias("revenue"))
    )
    return top_k(rows.select("l_orderkey", "revenue", "o_orderdate"), 10, F.desc("revenue"), c("o_orderdate"), c("l_orderkey"))


def q4(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    late = (c("l_orderkey") == c("o_orderkey")) & (c("l_shipdate") > c("o_orderdate") + F.expr("interval 60 days"))
    orders = t.orders.where(between_days("o_orderdate", "1996-01-01", "1996-04-01"))
    return exists(orders, t.lineitem.select("l_orderkey", "l_shipdate"), late).groupBy("o_orderpriority").agg(F.count("*").alias("order_count")).orderBy("o_orderpriority")


def q5(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    local = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region.where(c("r_name") == "AMERICA"), c("n_regionkey") == c("r_regionkey"))
    sold = t.customer.join(t.orders.where(between_days("o_orderdate", "1996-01-01", "1997-01-01")), c("c_custkey") == c("o_custkey")).join(t.lineitem, c("l_orderkey") == c("o_orderkey"))
    rows = sold.join(local, (c("l_suppkey") == c("s_suppkey")) & (c("c_nationkey") == c("s_nationkey")))
    return rows.groupBy("n_name").agg(money(F.sum(revenue()), 4).alias("revenue")).orderBy(F.desc("revenue"), "n_name")


def q6(spark: SparkSession, sf: str) -> DataFrame:
    rows = Tables(spark, sf).lineitem.where(between_days("l_shipdate", "1997-01-01", "1998-01-01") & c("l_discount").between(0.05, 0.07) & (c("l_quantity") < 24))
    return rows.agg(money(F.sum(c("l_extendedprice") * c("l_discount")), 4).alias("revenue"))


def q7(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    n1, n2 = (t.nation.select(c("n_nationkey").alias(f"{k}_key"), c("n_name").alias(k)) for k in ("supp_nation", "cust_nation"))
    pair = lambda a, b: (c("supp_nation") == a) & (c("cust_nation") == b)
    nations = n1.crossJoin(n2).where(pair("NATION_1", "NATION_2") | pair("NATION_2", "NATION_1"))
    sold = t.lineitem.where(c("l_shipdate").between(day("1995-01-01"), day("1996-12-31"))).join(t.supplier, c("s_suppkey") == c("l_suppkey")).join(t.orders, c("o_orderkey") == c("l_orderkey")).join(t.customer, c("c_custkey") == c("o_custkey"))
    rows = sold.join(nations, (c("s_nationkey") == c("supp_nation_key")) & (c("c_nationkey") == c("cust_nation_key")))
    return rows.groupBy("supp_nation", "cust_nation", year("l_shipdate").alias("l_year")).agg(money(F.sum(revenue()), 4).alias("revenue")).orderBy("supp_nation", "cust_nation", "l_year")


def q8(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    buyers = t.customer.join(t.nation.join(t.region.where(c("r_name") == "MIDDLE EAST"), c("n_regionkey") == c("r_regionkey")), c("c_nationkey") == c("n_nationkey")).select("c_custkey")
    sellers = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", c("n_name").alias("nation"))
    rows = (
        t.lineitem.join(t.part.where(c("p_type") == "ECONOMY"), c("p_partkey") == c("l_partkey")).join(sellers, c("s_suppkey") == c("l_suppkey"))
        .join(t.orders.where(c("o_orderdate").between(day("1995-01-01"), day("1996-12-31"))), c("o_orderkey") == c("l_orderkey")).join(buyers, c("c_custkey") == c("o_custkey"))
    )
    own = F.sum(F.when(c("nation") == "NATION_1", revenue()).otherwise(0.0))
    return rows.groupBy(year("o_orderdate").alias("o_year")).agg(ratio(own, F.sum(revenue())).alias("mkt_share")).orderBy("o_year")


def q9(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    rings = t.part.where(c("p_name").contains("ring")).select("p_partkey")
    rows = (
        t.lineitem.join(rings, c("p_partkey") == c("l_partkey")).join(t.offers(rings), (c("ps_suppkey") == c("l_suppkey")) & (c("ps_partkey") == c("l_partkey")))
        .join(t.supplier, c("s_suppkey") == c("l_suppkey")).join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.orders, c("o_orderkey") == c("l_orderkey"))
    )
    profit = F.sum(revenue() - c("ps_supplycost") * c("l_quantity"))
    return rows.groupBy(c("n_name").alias("nation"), year("o_orderdate").alias("o_year")).agg(money(profit, 4).alias("sum_profit")).orderBy("nation", F.desc("o_year"))


def q10(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    rows = (
        t.customer.join(t.orders.where(between_days("o_orderdate", "1996-03-01", "1996-06-01")), c("c_custkey") == c("o_custkey"))
        .join(t.lineitem.where(c("l_returnflag") == "R"), c("l_orderkey") == c("o_orderkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    )
    sums = rows.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(money(F.sum(revenue()), 4).alias("revenue"))
    return top_k(sums.select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name"), 20, F.desc("revenue"), c("c_custkey"))


def q11(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    offers = t.offers(suppliers=t.supplier.join(t.nation.where(c("n_name") == "NATION_3"), c("s_nationkey") == c("n_nationkey")))
    value = F.sum(c("ps_supplycost") * c("ps_availqty"))
    rows = with_scalar(offers.groupBy("ps_partkey").agg(value.alias("value")), offers.agg((value * 0.0001).alias("least")))
    return rows.where(c("value") > c("least")).select("ps_partkey", money(c("value")).alias("value")).orderBy(F.desc("value"), "ps_partkey")


def q12(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    lines = t.lineitem.where(c("l_returnflag").isin("R", "A") & between_days("l_shipdate", "1996-01-01", "1997-01-01"))
    rows = lines.join(t.orders, (c("o_orderkey") == c("l_orderkey")) & (c("o_orderdate") < c("l_shipdate")))
    high = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return rows.groupBy("l_linestatus").agg(count_if(high).alias("high_line_count"), count_if(~high).alias("low_line_count")).orderBy("l_linestatus")


def q13(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    urgent = t.orders.where(c("o_orderpriority") == "1-URGENT").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    per = t.customer.join(urgent, c("c_custkey") == c("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).cast("long").alias("c_count"))
    return per.groupBy("c_count").agg(F.count("*").alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


def q14(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    rows = t.lineitem.where(between_days("l_shipdate", "1996-01-01", "1996-02-01")).join(t.part, c("l_partkey") == c("p_partkey"))
    promo = F.sum(F.when(c("p_type").startswith("PROMO"), revenue()).otherwise(0.0))
    return rows.agg(ratio(100.0 * promo, F.sum(revenue())).alias("promo_revenue"))


def q15(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    sums = t.lineitem.where(between_days("l_shipdate", "1996-02-01", "1996-05-01")).groupBy("l_suppkey").agg(money(F.sum(revenue()), 4).alias("total_revenue"))
    best = with_scalar(sums, sums.agg(F.max("total_revenue").alias("best"))).where(c("total_revenue") == c("best"))
    return t.supplier.join(best, c("s_suppkey") == c("l_suppkey")).select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


def q16(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    parts = t.part.where((c("p_brand") != "Brand#14") & ~c("p_type").startswith("STANDARD") & c("p_size").isin(6, 3, 39, 37, 50, 27, 19, 34))
    lines = exists(t.lineitem.select("l_partkey", "l_suppkey"), parts, c("l_partkey") == c("p_partkey"))
    fine = not_in(lines.distinct(), "l_suppkey", t.supplier.where(c("s_acctbal") < 0), "s_suppkey")
    rows = fine.join(parts, c("l_partkey") == c("p_partkey"))
    return distinct_count(rows, ["p_brand", "p_type", "p_size"], "l_suppkey", "supplier_cnt").orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


def q17(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    parts = t.part.where((c("p_brand") == "Brand#1") & (c("p_size") <= 25)).select("p_partkey")
    rows = t.lineitem.join(parts, c("l_partkey") == c("p_partkey")).select("p_partkey", "l_quantity", "l_extendedprice")
    half = rows.groupBy(c("p_partkey").alias("k")).agg((0.5 * F.avg("l_quantity")).alias("half"))
    return rows.join(half, (c("p_partkey") == c("k")) & (c("l_quantity") < c("half"))).agg(money(F.sum("l_extendedprice") / 7.0).alias("avg_yearly"))


def q18(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    large = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("q")).where(c("q") > 312).select("k")
    rows = exists(t.orders, large, c("o_orderkey") == c("k")).join(t.customer, c("c_custkey") == c("o_custkey")).join(t.lineitem, c("o_orderkey") == c("l_orderkey"))
    sums = rows.groupBy("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice").agg(money(F.sum("l_quantity")).alias("sum_qty"))
    return top_k(sums, 100, F.desc("o_totalprice"), c("o_orderdate"), c("o_orderkey"))


def q19(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    one = lambda brand, size, low: (c("p_brand") == brand) & c("p_size").between(1, size) & c("l_quantity").between(low, low + 10)
    rows = t.lineitem.join(t.part, (c("p_partkey") == c("l_partkey")) & (one("Brand#11", 25, 3) | one("Brand#4", 30, 16) | one("Brand#3", 35, 24)))
    return rows.agg(money(F.sum(revenue()), 4).alias("revenue"))


def q20(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    sold = t.lineitem.where(between_days("l_shipdate", "1996-01-01", "1997-01-01")).groupBy("l_partkey", "l_suppkey").agg((0.5 * F.sum("l_quantity")).alias("half"))
    hot = t.offers(t.part.where(c("p_name").startswith("hot")))
    enough = hot.join(sold, (c("ps_partkey") == c("l_partkey")) & (c("ps_suppkey") == c("l_suppkey")) & (c("ps_availqty") > c("half")))
    sellers = t.supplier.join(t.nation.where(c("n_name").isin("NATION_3", "NATION_4", "NATION_5")), c("s_nationkey") == c("n_nationkey"))
    return exists(sellers, enough, c("s_suppkey") == c("ps_suppkey")).select("s_name").orderBy("s_name")


def q21(spark: SparkSession, sf: str) -> DataFrame:
    """A line waits if its order has another supplier, and no other supplier of the order is late."""
    t = Tables(spark, sf)
    late = t.lineitem.where(c("l_returnflag") == "R").select("l_orderkey", "l_suppkey")
    # one row per order instead of all pairs of its lines
    all_of = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"))
    late_of = late.groupBy(c("l_orderkey").alias("j")).agg(F.min("l_suppkey").alias("late_low"), F.max("l_suppkey").alias("late_high"))
    waits = late.join(all_of, (c("l_orderkey") == c("k")) & (c("low") != c("high"))).join(late_of, (c("l_orderkey") == c("j")) & (c("late_low") == c("late_high")))
    rows = exists(waits, t.orders.where(c("o_orderstatus") == "F").select("o_orderkey"), c("l_orderkey") == c("o_orderkey"))
    sellers = t.supplier.join(t.nation.where(c("n_name").isin("NATION_1", "NATION_2", "NATION_3")), c("s_nationkey") == c("n_nationkey"))
    return top_k(rows.join(sellers, c("s_suppkey") == c("l_suppkey")).groupBy("s_name").agg(F.count("*").alias("numwait")), 100, F.desc("numwait"), c("s_name"))


def q22(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    people = t.customer.select("c_custkey", "c_acctbal", F.substring("c_name", 17, 2).alias("cntrycode")).where(c("cntrycode").isin("13", "31", "23", "29", "30", "18", "17", "03", "05", "07"))
    rich = with_scalar(people, people.where(c("c_acctbal") > 0).agg(F.avg("c_acctbal").alias("mean"))).where(c("c_acctbal") > c("mean"))
    idle = not_exists(rich, t.orders.where(c("o_orderdate") >= day("2000-01-01")).select("o_custkey"), c("o_custkey") == c("c_custkey"))
    return idle.groupBy("cntrycode").agg(F.count("*").alias("numcust"), money(F.sum("c_acctbal")).alias("totacctbal")).orderBy("cntrycode")


def _sums() -> list:
    keys = [F.sum(k).alias(f"sum_{k[2:]}") for k in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    return [*keys, *(money(F.sum(k)).alias(f"sum_{k[2:]}") for k in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), F.min("l_shipdate").alias("min_shipdate")]


def scanagg(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).lineitem.where(c("l_shipdate") <= day("1998-08-06")).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("cnt"), *_sums()).orderBy("l_returnflag", "l_linestatus")


def joinagg(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    rows = t.lineitem.where(c("l_shipdate") < day("1996-06-01")).join(t.orders.where(c("o_orderpriority") == "2-HIGH"), c("o_orderkey") == c("l_orderkey"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("cnt"), *_sums()).orderBy("cnt", "l_returnflag")


QUERIES = {f.__name__: f for f in (q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22, scanagg, joinagg)}
