import pytest
from pyspark.sql import functions as F

from activepool.operators import acquisition as acq, scores as sc


def preds(spark):
    return spark.createDataFrame([("a", 2.0, 0.0), ("b", 0.5, 0.0), ("c", 1.0, 4.0)], "id string, mu double, var double")


def utilities(spark, metric, **options):
    rows = acq.with_utility(preds(spark), metric, acq.UtilityArgs(**options)).collect()
    return {r["id"]: r["utility"] for r in rows}


def test_expected_improvement_without_variance(spark):
    u = utilities(spark, "ei", best=F.lit(1.0), xi=0.01)
    assert u["a"] == pytest.approx(1.01) and u["b"] == pytest.approx(-0.49)


def test_probability_of_improvement_without_variance(spark):
    u = utilities(spark, "pi", best=F.lit(1.0), xi=0.01)
    assert (u["a"], u["b"]) == (1.0, 0.0) and 0.5 < u["c"] < 0.51


def test_bounds(spark):
    assert utilities(spark, "ucb", beta=2)["c"] == 5.0
    assert utilities(spark, "lcb", beta=2)["c"] == -3.0
    assert utilities(spark, "threshold", threshold=3.0) == {"a": -1.0, "b": -1.0, "c": -1.0}


def test_no_helper_columns_left(spark):
    df = acq.with_utility(preds(spark), "ei", acq.UtilityArgs(best=F.lit(0.0)))
    assert df.columns == ["id", "mu", "var", "utility"]


def test_metric_needs():
    assert acq.metric_needs("lcb") == {"means", "vars"} and acq.metric_needs("random") == set()
    with pytest.raises(ValueError):
        acq.check_model("ei", {"means"})
    with pytest.raises(ValueError):
        acq.metric_needs("nope")


def test_tie_goes_to_larger_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, mu double")
    none = spark.createDataFrame([], "id string, score double")
    assert [r["id"] for r in acq.acquire_batch(df, none, 1).collect()] == ["b"]


def pool_of(spark, n):
    return spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("mu"))


def test_batch_skips_scored_rows_and_prefilter_agrees(spark):
    pool = pool_of(spark, 400)
    done = pool.filter("mu = 6").select("id", F.lit(1.0).alias("score"))
    plain = {r["id"] for r in acq.acquire_batch(pool, done, 30).collect()}
    cut = {r["id"] for r in acq.acquire_batch(pool, done, 30, prefilter_from=1).collect()}
    assert plain == cut and len(plain) == 30 and not any(i % 7 == 6 for i in plain)


def test_random_share_is_forced_and_unexplored(spark):
    pool = pool_of(spark, 300)
    done = pool.filter("id < 100").select("id", F.lit(1.0).alias("score"))
    rows = acq.acquire_batch(pool, done, 20, epsilon=0.5, args=acq.UtilityArgs(salt="4")).collect()
    assert len(rows) == 20 and sum(r["utility"] == float("inf") for r in rows) == 10
    assert all(r["id"] >= 100 for r in rows)
    with pytest.raises(ValueError):
        acq.random_share(pool, 5, 1.5, "x")


def test_cluster_quotas_round_up(spark):
    pool = spark.range(100).select("id", F.when(F.col("id") < 33, "x").otherwise("y").alias("cluster_id"))
    got = {r["cluster_id"]: r["quota"] for r in acq.cluster_quotas(pool, 10).collect()}
    assert got == {"x": 4, "y": 7}
    batch = acq.initial_cluster_batch(pool, 10, 1)
    assert {r["cluster_id"]: r["count"] for r in batch.groupBy("cluster_id").count().collect()} == got


def test_retrieval_rate_with_short_list(spark):
    found = spark.createDataFrame([(1,), (2,)], "id long")
    truth = spark.createDataFrame([(2,), (3,), (4,)], "id long")
    assert acq.retrieval_rate(found, truth, 3).first()["rate"] == 0.5


def test_sizes():
    assert sc.resolve_size(0.01, 150, "ceil") == 2 and sc.resolve_size(0.01, 150) == 1
    assert sc.resolve_size(7, 150) == 7
    assert [sc.scheduled_size([10, 20, 30], t) for t in range(5)] == [10, 20, 30, 30, 30]
    for bad in (1.5, -1, -0.1):
        with pytest.raises(ValueError):
            sc.resolve_size(bad, 10)


def test_kth_best_with_few_rows_and_failures(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None)], "id string, score double")
    assert sc.kth_best(df, 3).first()["kth_best"] == 5.0
    assert sc.kth_best(df, 2).first()["kth_best"] == float("-inf")
    assert sc.top_average(df, 2).first()["top_avg"] == 2.5


def test_stop_on_flat_averages(spark):
    log = spark.createDataFrame([(i, 1.0) for i in range(3)], "iter int, top_avg double")
    rows = sc.convergence(log, 3, 0.01).orderBy("iter").collect()
    assert [r["converged"] for r in rows] == [None, None, True]


def test_upsert_takes_new_value_even_when_failed(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, score double")
    new = spark.createDataFrame([("b", None), ("c", 3.0)], "id string, score double")
    got = {r["id"]: r["score"] for r in sc.upsert(old, new).collect()}
    assert got == {"a": 1.0, "b": None, "c": 3.0}


def test_final_averages_of_small_pool(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, score double")
    rows = {r["fraction"]: r["top_avg"] for r in sc.final_averages(df, 1000).collect()}
    assert rows[0.0001] is None and rows[0.001] == 9.0 and rows[0.005] == pytest.approx(7.0)
