"""Edge cases of the relational operators on hand-made rows."""

from pyspark.sql import functions as F

from tarn.functions.columns import between_days, ratio
from tarn.operators.relational import combine, distinct_count, exists, not_exists, top_k, top_k_per_key, with_scalar
from tarn.sources.tables import Tables, to_orc

c = F.col


def test_semi_and_anti_with_nulls_duplicates_and_residuals(spark):
    left = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (None, 5)], "k int, v int")
    right = spark.createDataFrame([(1, 4), (1, 9), (2, 9), (None, 1)], "r int, w int")
    on = (c("k") == c("r")) & (c("w") < c("v"))
    assert [r.k for r in exists(left, right, on).collect()] == [1]
    assert {r.k for r in not_exists(left, right, on).collect()} == {2, 3, None}
    assert exists(left, right, c("k") == c("r")).count() == 2


def test_top_k_ties_and_per_key(spark):
    df = spark.createDataFrame([(k, k % 2, 7) for k in range(10)], "k int, g int, v int")
    assert [r.k for r in top_k(df, 3, F.desc("v"), c("k")).collect()] == [0, 1, 2]
    assert {r.k for r in top_k_per_key(df, ["g"], 2, F.desc("v"), c("k")).collect()} == {0, 1, 2, 3}


def test_distinct_count_ignores_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (1, 2), (1, 3), (2, None)], "g int, v int")
    assert {(r.g, r.n) for r in distinct_count(df, ["g"], "v", "n").collect()} == {(1, 2), (2, 0)}
    assert distinct_count(df, [], "v", "n").first().n == 2


def test_scalar_of_nothing_and_ratio_by_zero(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert with_scalar(df, df.where("false").agg(F.max("v").alias("m"))).where("v > m").count() == 0
    assert df.agg(ratio(F.sum("v"), F.sum(F.lit(0))).alias("r")).first().r is None


def test_dates_are_half_open_and_combine_keeps_rows(spark):
    df = spark.sql("select explode(array(timestamp_ntz'1996-01-01 00:00:00', timestamp_ntz'1996-12-31 23:59:59', timestamp_ntz'1997-01-01 00:00:00')) as d")
    assert df.where(between_days("d", "1996-01-01", "1997-01-01")).count() == 2
    few = combine(spark.range(100).repartition(10), 3)
    assert few.count() == 100 and few.rdd.getNumPartitions() == 3


def test_like_order_and_edge_discounts(spark):
    df = spark.createDataFrame([("special packages", 0.05), ("packages special", 0.07), ("x", 0.0499)], "t string, d double")
    assert df.where(c("t").like("%special%packages%")).count() == 1 and df.where(c("d").between(0.05, 0.07)).count() == 2


def test_orc_as_parquet(spark, sf, tmp_path):
    t = Tables(spark, sf)
    orc = to_orc(t, str(tmp_path), "nation", "region")
    assert orc.nation.exceptAll(t.nation).count() == 0 and orc.region.count() == 5


def test_a_split_join_deals_a_hot_key_over_tasks(spark):
    from tarn.operators.relational import split_join

    left = spark.range(8000).selectExpr("id", "if(id % 100 = 0, id, 7) as k")
    right = spark.createDataFrame([(7, "a"), (100, "b"), (100, "c")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, "k", how)
        got = split_join(left, right, ["k"], 16, how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", False)  # it would put these few rows together
    dealt = split_join(left, right.hint("merge"), ["k"], 16).groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(r["count"] for r in dealt) < 0.6 * sum(r["count"] for r in dealt) and len(dealt) > 1


def test_not_in_with_nulls(spark):
    from tarn.operators.relational import not_in

    left = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id long, k long")
    for values in ([], [10], [None], [10, None], [5, 6]):
        right = spark.createDataFrame([(v,) for v in values], "x long")
        left.createOrReplaceTempView("l"), right.createOrReplaceTempView("r")
        want = spark.sql("select id from l where k not in (select x from r)").collect()
        assert sorted(not_in(left, "k", right, "x").select("id").collect()) == sorted(want)
