import numpy as np
import pytest
from pyspark.sql import functions as F

from activepool.operators.features import cluster_rows, project
from activepool.operators.pool import make_pool
from activepool.operators.vocabulary import build_vocabulary, encode
from activepool.plans.explore import ExploreConfig, Explorer
from activepool.plans.objective import FunctionObjective, LookupObjective
from activepool.surrogates import build_model


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = x @ np.array([2.0, -1.0, 0.0, 0.5, 0.0]) + 0.3
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, features array<double>, score double").cache()
    return df, x, y


def test_linear_model_equals_dot_product_process(spark, data):
    df, x, y = data
    train, alpha, sigma0 = df.filter("id < 40"), 0.05, 1.3
    model = build_model("gp", alpha=alpha, sigma0=sigma0).fit(train)
    got = model.predict(df).orderBy("id").toPandas()
    a, b = x[:40], x
    mean, std = y[:40].mean(), y[:40].std()
    kernel = lambda p, q: sigma0**2 + p @ q.T
    solve = np.linalg.solve(kernel(a, a) + alpha * np.eye(40), np.column_stack([(y[:40] - mean) / std, kernel(a, b)]))
    mu = kernel(b, a) @ solve[:, 0] * std + mean
    var = (np.diag(kernel(b, b)) - np.einsum("ij,ji->i", kernel(b, a), solve[:, 1:])) * std**2
    assert np.allclose(got["mu"], mu, atol=1e-8) and np.allclose(got["var"], var, atol=1e-8)


def test_linear_model_online_equals_whole(spark, data):
    df, _, _ = data
    whole = build_model("gp").fit(df.filter("id < 60"))
    steps = build_model("gp").fit(df.filter("id < 20")).fit(df.filter("id >= 20 and id < 60"), online=True)
    assert np.allclose(whole.weights, steps.weights) and whole.n == steps.n


def test_linear_model_round_trip(spark, data, tmp_path):
    df, _, _ = data
    model = build_model("gp").fit(df)
    again = build_model("gp").load(spark, model.save(str(tmp_path / "gp")))
    assert np.allclose(model.weights, again.weights)


@pytest.mark.parametrize("name,options", [("rf", dict(n_estimators=7, max_depth=4)), ("gbt", dict(n_estimators=5, max_depth=3))])
def test_tree_walk_equals_the_model(spark, data, tmp_path, name, options):
    df, x, _ = data
    model = build_model(name, seed=1, **options).fit(df)
    both = model.predict(df).orderBy("id").toPandas()
    means = model.predict(df, need_var=False).orderBy("id").toPandas()
    assert np.allclose(both["mu"], means["mu"]) and (both["var"] >= 0).all()
    trees, weights = model.model.trees, getattr(model.model, "treeWeights", None)
    from pyspark.ml.linalg import Vectors

    scale = weights if name == "gbt" else [1.0] * len(trees)
    member = np.array([[t.predict(Vectors.dense(v)) * w for v in x[:20]] for t, w in zip(trees, scale)])
    assert np.allclose(both["var"][:20], member.var(axis=0))
    again = build_model(name, **options).load(spark, model.save(str(tmp_path / name)))
    assert np.allclose(again.predict(df).orderBy("id").toPandas()["var"], both["var"])


def test_clusters_and_projection(spark, data):
    df, _, _ = data
    assert cluster_rows(df, k=3).select("cluster_id").distinct().count() == 3
    assert project(df, share=0.5).count() == 200


def test_pool_drops_invalid_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "k long, t string")
    features = F.when(F.length("t") > 1, F.array(F.lit(1)))
    assert [r["id"] for r in make_pool(df, "k", "t", features).collect()] == [1]
    with pytest.raises(ValueError):
        make_pool(df, "k", "t", features, eager=False, clusters=2)


@pytest.mark.parametrize("dict_limit", [1000, 1, 0])
def test_encode_paths_agree(spark, dict_limit):
    """NULL texts, repeated keys and a token that is listed twice are coded alike on both paths."""
    df = spark.createDataFrame([(1, "CCN"), (2, "C"), (2, "NC"), (3, "zz"), (4, None)], "id long, t string")
    words = build_vocabulary(df.filter("id < 2"), "t").filter("token <> 'N'")
    words = words.unionByName(words.filter("token = 'C'").withColumn("token_id", F.lit(40)))
    rows = sorted((r["id"], r["ids"], r["mask"]) for r in encode(df, "t", words, dict_limit=dict_limit).filter("id < 4").collect())
    assert rows == [
        (1, [0, 4, 4, 2, 1], [1] * 5), (2, [0, 2, 4, 1, 2], [1, 1, 1, 1, 0]), (2, [0, 4, 1, 2, 2], [1, 1, 1, 0, 0]),
        (3, [0, 1, 2, 2, 2], [1, 1, 0, 0, 0]),
    ]
    missing = encode(df, "t", words, dict_limit=dict_limit).filter("id = 4").first()
    assert missing["ids"] is None and missing["mask"] is None


# --- the loop ---------------------------------------------------------------------------------


def explorer(spark, data, path, **options):
    df, _, _ = data
    settings = dict(k=10, budget=1.0, max_iters=3, window=10, init_size=0.1, batch_sizes=[15], metric="ucb", retrain=True)
    truth = df.select("id", F.col("score").alias("y"))
    top = df.orderBy(F.col("score").desc()).limit(10).select("id")
    return Explorer(
        spark, df.select("id", "features"), LookupObjective(truth), build_model("gp"),
        ExploreConfig(**{**settings, **options}), str(path), top,
    )


def test_loop_finds_the_best_rows(spark, data, tmp_path):
    run = explorer(spark, data, tmp_path / "a")
    run.explore_initial()
    before = run.retrieval()
    run.run()
    scores = run.scores()
    assert scores.count() == scores.select("id").distinct().count() == 20 + 3 * 15 == run.run_log[-1]["n_acquired"]
    assert run.retrieval() >= before and run.retrieval() == 1.0
    tops = [r["top_avg"] for r in run.run_log]
    assert tops == sorted(tops)


def test_restart_takes_the_same_batch(spark, data, tmp_path):
    whole = explorer(spark, data, tmp_path / "w")
    whole.run()
    part = explorer(spark, data, tmp_path / "p")
    part.explore_initial()
    part.explore_batch()
    again = explorer(spark, data, tmp_path / "p").restore(part.checkpoint())
    again.run()
    pick = lambda e: sorted((r["id"], r["iter"]) for r in e.scores().collect())
    assert pick(again) == pick(whole)


def test_budget_and_exhaustion(spark, data, tmp_path):
    run = explorer(spark, data, tmp_path / "b", budget=40, max_iters=50)
    run.run()
    assert run.scores().count() == 50 and "scored 50/40" in run.status()
    empty = explorer(spark, data, tmp_path / "e", max_iters=50, batch_sizes=[170])
    empty.run()
    assert empty.scores().count() == 200 and empty.run_log[-1]["exhausted"]


def test_warm_start_is_not_charged(spark, data, tmp_path):
    df, _, _ = data
    run = explorer(spark, data, tmp_path / "ws", max_iters=1)
    run.load_scores(df.filter("id < 30").select("id", "score"))
    run.run()
    last = run.run_log[-1]
    assert (last["n_prior"], last["n_acquired"]) == (30, 45)


def test_failures_pruning_and_epsilon(spark, data, tmp_path):
    df, _, _ = data

    def score(value):
        if value % 5 == 0:
            raise RuntimeError
        return float("nan") if value % 7 == 0 else float(value)

    config = ExploreConfig(k=5, budget=1.0, max_iters=2, init_size=30, batch_sizes=[10], metric="ei",
                           epsilon=0.2, prune=True, prune_min_prob=0.0, retrain=False)
    run = Explorer(spark, df.select("id", "features"), FunctionObjective(score), build_model("gp"), config, str(tmp_path / "f"))
    run.run()
    rows = run.scores().collect()
    assert len({r["id"] for r in rows}) == 50
    assert all((r["score"] is None) == (r["id"] % 5 == 0 or r["id"] % 7 == 0) for r in rows)


def test_clustered_loop(spark, data, tmp_path):
    df, _, _ = data
    pool = df.select("id", "features", (F.col("id") % 4).cast("int").alias("cluster_id"))
    truth = df.select("id", F.col("score").alias("y"))
    config = ExploreConfig(k=5, budget=1.0, max_iters=2, init_size=20, batch_sizes=[12], metric="ucb", cluster=True, temp_start=50.0, temp_end=50.0)
    run = Explorer(spark, pool, LookupObjective(truth), build_model("gp"), config, str(tmp_path / "c"))
    run.run()
    assert run.iter == 3 and run.scores().select("id").distinct().count() > 25


def test_model_must_feed_the_metric(spark, data, tmp_path):
    df, _, _ = data
    model = build_model("random")
    model.provides = {"means"}
    with pytest.raises(ValueError):
        Explorer(spark, df, None, model, ExploreConfig(metric="ei"), str(tmp_path))


def user_model():
    from activepool.surrogates import BatchFunctionSurrogate

    def fit(rows):
        mean = rows.agg(F.avg("score")).first()[0]

        def make():
            def predict(x):
                return np.stack([2 * x[:, 0] - x[:, 1] + mean, np.ones(len(x))], axis=1)

            return predict

        return make

    return BatchFunctionSurrogate(None, width=5, fit_fn=fit)


def user_explorer(spark, data, path, objective=None, **options):
    df, _, _ = data
    settings = dict(k=10, budget=1.0, max_iters=2, window=10, init_size=0.1, batch_sizes=[15], metric="ucb")
    truth = df.select("id", F.col("score").alias("y"))
    return Explorer(
        spark, df.select("id", "features"), objective or LookupObjective(truth), user_model(),
        ExploreConfig(**{**settings, **options}), str(path),
    )


def picks(run):
    return sorted((r["id"], r["iter"]) for r in run.scores().collect())


def test_loop_with_a_user_model_restarts(spark, data, tmp_path):
    whole = user_explorer(spark, data, tmp_path / "w")
    whole.run()
    part = user_explorer(spark, data, tmp_path / "p")
    part.explore_initial()
    part.explore_batch()
    again = user_explorer(spark, data, tmp_path / "p").restore(part.checkpoint())
    again.run()
    assert picks(again) == picks(whole) and len(picks(whole)) == 50


def test_restart_after_a_round_that_failed_as_a_whole(spark, data, tmp_path):
    class Failing(LookupObjective):
        def score(self, batch, batch_rows=None):
            rows = super().score(batch, batch_rows)
            return rows if batch_rows == 20 else rows.withColumn("score", F.lit(None).cast("double"))

    df, _, _ = data
    truth = df.select("id", F.col("score").alias("y"))
    run = user_explorer(spark, data, tmp_path / "f", Failing(truth))
    run.explore_initial()
    run.explore_batch()
    run.explore_batch()  # fits on nothing new: the predictions of the round before are used again
    again = user_explorer(spark, data, tmp_path / "f", LookupObjective(truth), max_iters=3).restore(run.checkpoint())
    again.run()
    assert len(picks(again)) == 65 and picks(again)[0][1] >= 0


def test_rescue_checkpoint_of_the_first_batch_round(spark, data, tmp_path):
    class Broken(LookupObjective):
        def score(self, batch, batch_rows=None):
            if batch_rows != 20:
                raise RuntimeError("scorer is down")
            return super().score(batch, batch_rows)

    df, _, _ = data
    truth = df.select("id", F.col("score").alias("y"))
    run = user_explorer(spark, data, tmp_path / "r", Broken(truth))
    with pytest.raises(RuntimeError, match="scorer is down"):
        run.run()
    again = user_explorer(spark, data, tmp_path / "r", LookupObjective(truth)).restore(f"{tmp_path}/r/chkpts/iter_1/state")
    again.run()
    whole = user_explorer(spark, data, tmp_path / "r2")
    whole.run()
    assert picks(again) == picks(whole)


def test_failed_checkpoint_does_not_hide_the_error(spark, data, tmp_path, monkeypatch):
    run = user_explorer(spark, data, tmp_path / "h")
    monkeypatch.setattr(run, "explore_initial", lambda: (_ for _ in ()).throw(ValueError("first")))
    monkeypatch.setattr(run, "checkpoint", lambda: (_ for _ in ()).throw(OSError("second")))
    with pytest.raises(ValueError, match="first"):
        run.run()


def test_warm_start_is_an_upsert_without_rewind(spark, data, tmp_path):
    df, _, _ = data
    run = user_explorer(spark, data, tmp_path / "u")
    prior = df.filter("id < 30").select("id", "score")
    run.load_scores(prior.union(prior.filter("id < 5").withColumn("score", F.lit(-9.0))))
    assert (run.n_prior, run.scores().count()) == (30, 30)
    run.explore_batch()
    before = run.iter
    taken = [r["id"] for r in run.scores().filter("NOT is_prior").collect()]
    fresh = [i for i in range(100, 200) if i not in taken][:2]
    run.load_scores(spark.createDataFrame([(fresh[0], 7.0), (fresh[1], 8.0), (taken[0], 99.0)], "id long, score double"))
    assert run.iter == before and run.n_prior == 32
    got = {r["id"]: r["score"] for r in run.scores().collect()}
    assert len(got) == 47 and got[taken[0]] == 99.0 and got[fresh[1]] == 8.0
    again = user_explorer(spark, data, tmp_path / "u").restore(run.checkpoint())
    assert {r["id"]: r["score"] for r in again.scores().collect()} == got


def test_online_model_keeps_earlier_rounds(spark, data, tmp_path):
    run = explorer(spark, data, tmp_path / "on", retrain=False, max_iters=2)
    run.run()
    assert run.model.n == run.scores().filter("iter < 2").count()


def test_rounds_leave_no_scratch_and_few_jobs(spark, data, tmp_path):
    import os

    from activepool.session import scratch_root

    root = f"{scratch_root(spark)}/activepool"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    run = explorer(spark, data, tmp_path / "s", metric="ucb")
    run.explore_initial()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("round", "round")
    run.explore_batch()
    jobs = len(tracker.getJobIdsForGroup("round"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 16, jobs
    assert (set(os.listdir(root)) if os.path.isdir(root) else set()) <= before


def test_scoring_is_spread_and_failures_are_told(spark):
    batch = spark.range(200).coalesce(1)

    def task_of(i):
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    scored = FunctionObjective(task_of).score(batch, 200)
    assert scored.select("score").distinct().count() >= 8
    assert FunctionObjective(lambda i: 1.0).score(batch.limit(0), 0).count() == 0

    def broken(i):
        raise ImportError("no module")

    with pytest.raises(RuntimeError, match="no module"):
        FunctionObjective(broken).score(batch, 200)
    assert FunctionObjective(broken, raise_if_all_fail=False).score(batch, 200).filter("score IS NULL").count() == 200
