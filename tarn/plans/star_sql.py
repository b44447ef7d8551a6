"""What plans/star.py computes, as SQL texts in the form of the suite: subqueries where star.py has joins. Both Spark and DuckDB run them."""

from __future__ import annotations

REV = "l_extendedprice * (1 - l_discount)"
PARTSUPP = "partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"
SUMS = """count(*) AS cnt, cast(sum(l_orderkey) AS bigint) AS sum_orderkey, cast(sum(l_partkey) AS bigint) AS sum_partkey, cast(sum(l_suppkey) AS bigint) AS sum_suppkey, cast(sum(l_linenumber) AS bigint) AS sum_linenumber,
  round(sum(l_quantity), 2) AS sum_quantity, round(sum(l_extendedprice), 2) AS sum_extendedprice, round(sum(l_discount), 2) AS sum_discount, round(sum(l_tax), 2) AS sum_tax, min(l_shipdate) AS min_shipdate"""

SQL = {
    "q1": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({REV}), 4) AS sum_disc_price, round(sum({REV} * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= date '1998-08-06' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""",
    "q2": f"""WITH {PARTSUPP} SELECT s_acctbal, s_name, n_name, p_partkey, p_type FROM part, supplier, partsupp, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size <= 15 AND p_type LIKE '%LARGE' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'AFRICA'
  AND ps_supplycost = (SELECT min(ps_supplycost) FROM partsupp, supplier, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'AFRICA')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q3": f"""SELECT l_orderkey, round(sum({REV}), 4) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < date '1995-03-01' AND l_shipdate > date '1995-03-01'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q4": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= date '1996-01-01' AND o_orderdate < date '1996-04-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q5": f"""SELECT n_name, round(sum({REV}), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND r_name = 'AMERICA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1997-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "q6": """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= date '1997-01-01' AND l_shipdate < date '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "q7": f"""SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, cast(extract(year FROM l_shipdate) AS bigint) AS l_year, {REV} AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AND l_shipdate BETWEEN date '1995-01-01' AND date '1996-12-31') AS shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY 1, 2, 3""",
    "q8": f"""SELECT o_year, round(sum(CASE WHEN nation = 'NATION_1' THEN volume ELSE 0 END) / nullif(sum(volume), 0), 6) AS mkt_share FROM (
  SELECT cast(extract(year FROM o_orderdate) AS bigint) AS o_year, {REV} AS volume, n2.n_name AS nation FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'MIDDLE EAST'
    AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN date '1995-01-01' AND date '1996-12-31' AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year ORDER BY o_year""",
    "q9": f"""WITH {PARTSUPP} SELECT nation, o_year, round(sum(amount), 4) AS sum_profit FROM (
  SELECT n_name AS nation, cast(extract(year FROM o_orderdate) AS bigint) AS o_year, {REV} - ps_supplycost * l_quantity AS amount FROM part, supplier, lineitem, partsupp, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') AS profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "q10": f"""SELECT c_custkey, c_name, round(sum({REV}), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= date '1996-03-01' AND o_orderdate < date '1996-06-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11": f"""WITH {PARTSUPP} SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS value FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3'
GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.0001 FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3')
ORDER BY value DESC, ps_partkey""",
    "q12": """SELECT l_linestatus, cast(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS high_line_count,
  cast(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS low_line_count FROM orders, lineitem
WHERE o_orderkey = l_orderkey AND l_returnflag IN ('R', 'A') AND o_orderdate < l_shipdate AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' GROUP BY l_linestatus ORDER BY l_linestatus""",
    "q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14": f"""SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REV} ELSE 0 END) / nullif(sum({REV}), 0), 6) AS promo_revenue FROM lineitem, part
WHERE l_partkey = p_partkey AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-02-01'""",
    "q15": f"""WITH revenue0 AS (SELECT l_suppkey AS supplier_no, round(sum({REV}), 4) AS total_revenue FROM lineitem WHERE l_shipdate >= date '1996-02-01' AND l_shipdate < date '1996-05-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue0 WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue0) ORDER BY s_suppkey""",
    "q16": f"""WITH {PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#14' AND p_type NOT LIKE 'STANDARD%'
  AND p_size IN (6, 3, 39, 37, 50, 27, 19, 34) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "q17": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#1' AND p_size <= 25
  AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 312) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19": f"""SELECT round(sum({REV}), 4) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#11' AND p_size BETWEEN 1 AND 25 AND l_quantity >= 3 AND l_quantity <= 13)
  OR (p_partkey = l_partkey AND p_brand = 'Brand#4' AND p_size BETWEEN 1 AND 30 AND l_quantity >= 16 AND l_quantity <= 26) OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND p_size BETWEEN 1 AND 35 AND l_quantity >= 24 AND l_quantity <= 34)""",
    "q20": f"""WITH {PARTSUPP} SELECT s_name FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'hot%')
  AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01'))
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_3', 'NATION_4', 'NATION_5') ORDER BY s_name""",
    "q21": """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22": """WITH people AS (SELECT c_custkey, c_acctbal, substring(c_name, 17, 2) AS cntrycode FROM customer WHERE substring(c_name, 17, 2) IN ('13', '31', '23', '29', '30', '18', '17', '03', '05', '07'))
SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM people WHERE c_acctbal > (SELECT avg(c_acctbal) FROM people WHERE c_acctbal > 0.00)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= date '2000-01-01') GROUP BY cntrycode ORDER BY cntrycode""",
    "scanagg": f"SELECT l_returnflag, l_linestatus, {SUMS} FROM lineitem WHERE l_shipdate <= date '1998-08-06' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2",
    "joinagg": f"SELECT l_returnflag, {SUMS} FROM lineitem, orders WHERE l_shipdate < date '1996-06-01' AND o_orderpriority = '2-HIGH' AND o_orderkey = l_orderkey GROUP BY l_returnflag ORDER BY cnt, l_returnflag",
}
