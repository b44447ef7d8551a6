from tarn.workload import queries, strategies


def test_the_choice_is_among_all_lookbacks(spark, sf):
    assert {r.lookback for r in queries.strategy_costs(spark, sf).select("lookback").distinct().collect()} == set(strategies.LOOKBACKS)


def test_executor_sweep_runs_the_whole_range(spark, sf):
    got = {r.executors for r in queries.executor_sweep(spark, sf).select("executors").collect()}
    assert got == {*range(4, 33, 4), *range(100, 451, 5)} == set(queries.SETTINGS)
