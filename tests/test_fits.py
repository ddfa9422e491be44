"""Mini-batch clusters and the fitted noise and bias of the linear process, against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from activepool.operators import features as ft
from activepool.surrogates import build_model
from activepool.surrogates.linear import Evidence


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (400, 6)) for c in (0.0, 3.0, -4.0, 8.0)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>").repartition(5)


def brute(blobs, k, seed, size, count, group):
    """The rule in plain numpy over the same batches and first centres."""
    dealt = {}
    for r in ft.mini_batches(blobs, size, count, seed).collect():
        dealt.setdefault(r["batch"], []).append(r["features"])
    centres, taken = ft.first_centres(blobs, k, seed).copy(), np.zeros(k)
    for start in range(0, count, group):
        x = np.concatenate([np.array(dealt[b]) for b in range(start, min(start + group, count)) if b in dealt])
        near = np.argmin(((x[:, None, :] - centres) ** 2).sum(axis=2), axis=1)
        for c in range(k):
            for row in x[near == c]:
                taken[c] += 1
                centres[c] += 0
            if (near == c).any():
                n = (near == c).sum()
                centres[c] += n / taken[c] * (x[near == c].mean(axis=0) - centres[c])
    return centres


@pytest.mark.parametrize("k, size, count, group", [(4, 100, 12, 1), (7, 64, 30, 5), (4, 5_000, 3, 2)])
def test_mini_batches_against_numpy(blobs, k, size, count, group):
    found = ft.mini_batch_centres(blobs, k, 2, size, count, group)
    assert np.allclose(found, brute(blobs, k, 2, size, count, group), atol=1e-9)


def test_batches_have_their_size_and_are_dealt_anew(blobs):
    rows = ft.mini_batches(blobs, 100, 40, 1).collect()  # 1,600 rows: 16 batches an epoch
    sizes = np.bincount([r["batch"] for r in rows], minlength=40)
    assert (sizes > 60).all() and (sizes < 145).all()
    first = {r["id"]: r["batch"] for r in rows if r["batch"] < 16}
    second = {r["id"]: r["batch"] - 16 for r in rows if 16 <= r["batch"] < 32}
    assert len(first) == len(second) == 1_600
    assert sum(first[i] == second[i] for i in first) < 200
    assert {r["batch"] for r in ft.mini_batches(blobs, 100, 3, 1).collect()} == {0, 1, 2}


def test_mini_batches_find_the_clusters(blobs):
    centres = ft.mini_batch_centres(blobs, 4, 5, 128, 40, 8)
    rows = ft.assign_centres(blobs, centres).collect()
    x = np.array([r["features"] for r in blobs.orderBy("id").collect()])
    near = np.argmin(((x[:, None, :] - centres) ** 2).sum(axis=2), axis=1)
    assert {r["id"]: r["cluster_id"] for r in rows} == dict(enumerate(near.tolist()))
    loss = ((x - centres[near]) ** 2).sum() / ((x - x.mean(axis=0)) ** 2).sum()
    assert loss < 0.3
    assert len(ft.mini_batch_centres(blobs.limit(0), 4)) == 0


def dense(x, t, alpha, sigma0):
    c = alpha * np.eye(len(x)) + sigma0**2 + x @ x.T
    return -0.5 * (t @ np.linalg.solve(c, t) + np.linalg.slogdet(c)[1] + len(x) * np.log(2 * np.pi))


def case(n=60, d=5, noise=0.4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0.4, 1, (n, d))
    y = x @ rng.normal(0, 1, d) + 3 + noise * rng.normal(size=n)
    z = np.column_stack([np.ones(n), x, y])
    return x, y, z.T @ z


@pytest.mark.parametrize("n, d", [(60, 5), (8, 20), (30, 1)])
def test_evidence_against_a_dense_solver(n, d):
    x, y, gram = case(n, d)
    t = (y - y.mean()) / y.std()
    evidence = Evidence(gram)
    for alpha in (1e-3, 0.1, 2.0):
        for sigma0 in (1e-2, 1.0, 30.0):
            assert float(evidence(alpha, sigma0)) == pytest.approx(dense(x, t, alpha, sigma0), rel=1e-7, abs=1e-6)


def test_the_best_pair_is_the_top_of_the_dense_likelihood():
    x, y, gram = case()
    t = (y - y.mean()) / y.std()
    alpha, sigma0 = Evidence(gram).best()
    top = dense(x, t, alpha, sigma0)
    grid = np.exp(np.linspace(np.log(1e-5), np.log(1e5), 60))
    assert top >= max(dense(x, t, a, s) for a in grid[::2] for s in grid[::2]) - 1e-6
    for fa, fs in ((1.02, 1), (0.98, 1), (1, 1.02), (1, 0.98)):
        assert top >= dense(x, t, alpha * fa, sigma0 * fs) - 1e-9


def test_constant_scores_have_an_evidence():
    x = np.random.default_rng(0).normal(size=(20, 3))
    z = np.column_stack([np.ones(20), x, np.full(20, 5.0)])
    alpha, sigma0 = Evidence(z.T @ z).best()
    assert np.isfinite([alpha, sigma0]).all()


def test_a_tuned_process(spark, tmp_path):
    x, y, gram = case(400, 5, noise=0.5)
    rows = spark.createDataFrame([(i, [float(v) for v in r], float(s)) for i, (r, s) in enumerate(zip(x, y))], "id long, features array<double>, score double")
    model = build_model("gp", tune=True, alpha=50.0, sigma0=7.0).fit(rows)
    assert (model.alpha, model.sigma0) == pytest.approx(Evidence(gram).best(), rel=1e-3)
    assert model.alpha * y.var() == pytest.approx(0.25, rel=0.2)  # the noise that was put in
    t = (y - y.mean()) / y.std()
    c = model.alpha * np.eye(400) + model.sigma0**2 + x @ x.T
    k = model.sigma0**2 + x @ x.T
    want = k @ np.linalg.solve(c, t) * y.std() + y.mean()
    var = np.diag(k - k @ np.linalg.solve(c, k)) * y.var()
    got = {r["id"]: r for r in model.predict(rows).collect()}
    assert np.allclose([got[i]["mu"] for i in range(400)], want, atol=1e-6)
    assert np.allclose([got[i]["var"] for i in range(400)], var, atol=1e-6)
    # Two online steps end at the same settings, and a saved model goes on tuning.
    steps = build_model("gp", tune=True).fit(rows.filter("id % 3 = 0"))
    steps = build_model("gp").load(spark, steps.save(f"{tmp_path}/model"))
    steps.fit(rows.filter("id % 3 <> 0"), online=True)
    assert (steps.alpha, steps.sigma0) == pytest.approx((model.alpha, model.sigma0), rel=1e-3)
    assert steps.predict(rows).filter(F.col("mu").isNull()).count() == 0


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_variance_over_the_trees(spark, tmp_path, kind):
    """Mean and variance beside the predictions of each tree by itself; no row leaves the JVM for them."""
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    y = x[:, 0] * 2 - np.abs(x[:, 1]) + 0.1 * rng.normal(size=300)
    rows = spark.createDataFrame([(i, [float(v) for v in r], float(s)) for i, (r, s) in enumerate(zip(x, y))], "id long, features array<double>, score double")
    model = build_model(kind, n_estimators=7, max_depth=4, seed=3).fit(rows)
    plan = model.predict(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
    got = {r["id"]: r for r in model.predict(rows).collect()}
    weights = model.model.treeWeights if kind == "gbt" else [1.0] * 7
    for i in range(0, 300, 17):
        each = [w * t.predict(Vectors.dense(x[i])) for w, t in zip(weights, model.model.trees)]
        assert got[i]["mu"] == pytest.approx(np.sum(each) if kind == "gbt" else np.mean(each), abs=1e-9)
        assert got[i]["var"] == pytest.approx(np.var(each), abs=1e-9)
    again = build_model(kind).load(spark, model.save(f"{tmp_path}/model"))
    assert sorted(map(tuple, again.predict(rows).collect())) == sorted(map(tuple, model.predict(rows).collect()))


def plain_min_hashes(pieces, length):
    """The rule of the minimum hashes, bin by bin."""
    import hashlib

    bins = {}
    for g in pieces:
        h = hashlib.md5(g.encode()).hexdigest()
        at, v = int(h[:8], 16) % length, int(h[8:16], 16)
        bins[at] = min(v, bins.get(at, v))
    out = []
    for b in range(length if bins else 0):
        d = next(d for d in range(length) if (b + d) % length in bins)
        out.append(bins[(b + d) % length] + d * 40_503)
    return sorted(out)


def test_one_permutation_hashes(spark):
    from activepool.functions.tokens import min_hashes

    cases = [[], ["a"], ["a", "a"], [f"g{i}" for i in range(5)], [f"x{i}" for i in range(200)]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id long, g array<string>")
    for length in (1, 16, 64):
        got = {r["id"]: sorted(r["m"]) for r in rows.select("id", min_hashes(F.col("g"), length).alias("m")).collect()}
        assert got == {i: plain_min_hashes(c, length) for i, c in enumerate(cases)}


def test_like_texts_share_minimum_hashes(spark):
    from activepool.functions.tokens import min_hashes

    base = [f"g{i}" for i in range(300)]
    near, far = base[:270] + [f"n{i}" for i in range(30)], [f"f{i}" for i in range(300)]
    rows = spark.createDataFrame([(0, base), (1, near), (2, far)], "id long, g array<string>")
    m = {r["id"]: r["m"] for r in rows.select("id", min_hashes(F.col("g"), 512).alias("m")).collect()}
    share = lambda a, b: np.mean([x == y for x, y in zip(m[a], m[b])])
    assert abs(share(0, 1) - 270 / 330) < 0.1 and share(0, 2) < 0.02
