import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from activepool.operators import curves as cv, evaluate as ev, prepare as prep, prune as pr


def heap_curve(scores, k):
    """The rule as a plain loop over one run."""
    heap, out = [], []
    for s in scores[:k]:
        if s is not None:
            heapq.heappush(heap, s)
    out += [sum(heap) / k] * len(scores[:k])
    for s in scores[k:]:
        if s is not None:
            heapq.heappushpop(heap, s)
        out.append(sum(heap) / k)
    return out


@pytest.mark.parametrize("k,block,few", [(5, 50, 10**6), (1, 10, 10**6), (30, 400, 10**6), (7, 20, 0), (40, 16, 10**6)])
def test_top_average_curve_per_row(spark, monkeypatch, k, block, few):
    monkeypatch.setattr(cv, "FEW_EVENTS", few)
    monkeypatch.setattr(cv, "BLOCK", 33)
    rnd = random.Random(1)
    runs = {"hot": 300, "cold": 40, "short": 3, "rising": 90, "failed": 12}
    rows, want = [], {}
    for run, n in runs.items():
        scores = [None if rnd.random() < 0.2 else float(rnd.randint(0, 50)) for _ in range(n)]
        if run == "rising":  # every row enters
            scores = [float(i) for i in range(n)]
        if run == "failed":
            scores = [None] * n
        rows += [(run, i + 1, f"{run}{i}", s) for i, s in enumerate(scores)]
        want[run] = heap_curve(scores, k)
    df = spark.createDataFrame(rows, "run_id string, seq long, id string, score double")
    got = cv.top_average_curve(df.repartition(7), k, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["reward"] == pytest.approx(want[r["run_id"]][r["n_sampled"] - 1])


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_best_upto_is_a_prefix_scan(spark, fan):
    rnd = random.Random(2)
    lists = {(g, i + 1): sorted((float(rnd.randint(0, 99)) for _ in range(rnd.randint(0, 4))), reverse=True) for g, n in (("a", 23), ("b", 1), ("c", 9)) for i in range(n)}
    rows = [(g, i, x or None) for (g, i), x in lists.items()]
    df = spark.createDataFrame(rows, "g string, at long, _best array<double>")
    got = {(r["g"], r["at"]): r["_upto"] for r in cv.best_upto(df, ["g"], "at", 4, fan).collect()}
    for g, i in lists:
        assert got[g, i] == sorted((x for j in range(1, i + 1) for x in lists[g, j]), reverse=True)[:4]


def test_hit_curve_counts_only_as_many_ties_as_wanted(spark):
    rows = [("r", i, str(i), s) for i, s in enumerate([1.0, 5.0, 3.0, 3.0, None, 3.0, 9.0])]
    df = spark.createDataFrame(rows, "run_id string, seq long, id string, score double")
    truth = spark.createDataFrame([("x", 9.0), ("y", 5.0), ("z", 3.0), ("w", 3.0)], "id string, score double")
    got = [r["reward"] for r in cv.hit_curve_scores(df, truth, block=2).orderBy("n_sampled").collect()]
    assert got == [0.0, 0.25, 0.5, 0.75, 0.75, 0.75, 1.0]


def test_multiset_reward(spark):
    runs = spark.createDataFrame(
        [("r", 0, "a", 3.0), ("r", 0, "b", 2.0), ("r", 1, "c", 1.0), ("r", 2, "d", 3.0)],
        "run_id string, iter int, id string, score double",
    )
    truth = spark.createDataFrame([("a", 3.0), ("d", 3.0), ("e", 2.0)], "id string, score double")
    row = ev.rewards(runs, truth, 1, 3).first()
    assert row["f_scores"] == pytest.approx(2 / 3) and row["f_keys"] == pytest.approx(1 / 3)
    assert row["f_avg"] == pytest.approx(2 / (8 / 3))


def test_ranking_metrics_against_pairs(spark):
    rnd = random.Random(5)
    data = [(float(rnd.random() < 0.4), round(rnd.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(data, "target double, pred double")
    pos = [p for t, p in data if t]
    neg = [p for t, p in data if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert ev.ranking_metrics(df).first()["roc_auc"] == pytest.approx(auc)


def test_ranking_metrics_of_one_class_are_nan(spark):
    df = spark.createDataFrame([("a", 1.0, 0.2), ("a", 1.0, 0.4), ("b", 1.0, 0.9), ("b", 0.0, 0.1)], "g string, target double, pred double")
    got = {r["g"]: r["roc_auc"] for r in ev.ranking_metrics(df, by=["g"]).collect()}
    assert math.isnan(got["a"]) and got["b"] == 1.0


def test_metrics_skip_missing_targets(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 5.0), (float("nan"), 5.0), (3.0, 3.0)], "target double, pred double")
    row = ev.model_metrics(df, ["mae", "mse", "r2"]).first()
    assert (row["mae"], row["mse"], row["r2"]) == (0.5, 0.5, 0.5)
    with pytest.raises(ValueError):
        ev.model_metrics(df, ["nope"])


def test_density_grid_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 0.5)], "x double, y double")
    assert sorted(map(tuple, ev.density_grid(df, "x", "y", 2).collect())) == [(0, 0, 1), (1, 1, 2)]


def test_scaler_rules(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (None, 5.0, None)], "a double, b double, c double")
    scaler = prep.fit_scaler(df, ["a", "b", "c"])
    assert tuple(scaler.first()) == (2.0, 1.0, 5.0, 1.0, 0.0, 1.0)
    rows = prep.scale(df, scaler, ["a", "b", "c"], replace_nan=0.5).select("a_scaled", "b_scaled", "c_scaled").collect()
    assert sorted(map(tuple, rows)) == [(-1.0, 0.0, 0.5), (0.5, 0.0, 0.5), (1.0, 0.0, 0.5)]


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_splits_have_exact_sizes(spark, partitions):
    df = spark.range(103).repartition(partitions)
    counts = {r["split"]: r["count"] for r in prep.random_split(df, "id", 1).groupBy("split").count().collect()}
    assert counts == {"train": 82, "val": 10, "test": 11}
    folds = prep.kfold_split(df, "id", 7, 5).groupBy("fold", "split").count().collect()
    assert sorted(r["count"] for r in folds) == [19, 21, 21, 21, 21]
    assert {r["split"] for r in folds if r["fold"] == 2} == {"test"}
    assert {r["split"] for r in folds if r["fold"] == 3} == {"val"}


def test_balanced_sample_interleaves(spark):
    df = spark.range(50)
    rows = prep.balanced_sample(df, "id", F.col("id") < 6).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(1, 13))
    assert [r["active"] for r in rows] == [True, False] * 6


def test_prune_without_variance_is_a_hard_cut(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id long, mu double")
    assert [r["id"] for r in pr.prune(df, 1.0).collect()] == [2]
    assert pr.expected_pruned(df, 1.0).first()["n_pruned"] == 1


def test_observed_threshold_with_few_scores(spark):
    scores = spark.createDataFrame([("a", 5.0), ("b", 2.0), ("c", None)], "id string, score double")
    assert pr.prune_threshold(None, scores, 10, observed=True).first()["kth_best"] == 2.0
    assert pr.prune_threshold(None, scores, 1, observed=True).first()["kth_best"] == 5.0
