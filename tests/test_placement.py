"""Tables by key, positions by file, the journal of paid scores and the kept best rows."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from activepool.operators import scores as sc
from activepool.operators.acquisition import acquire_batch, unexplored
from activepool.plans.explore import ExploreConfig, Explorer
from activepool.plans.objective import FunctionObjective, LookupObjective, paid_scores
from activepool.sources.colocated import is_written, read_colocated, write_colocated
from activepool.sources.offsets import RowOffsets, draw_positions, draw_stored
from activepool.surrogates import build_model, training_rows


@pytest.fixture
def no_broadcast(spark):
    """Every table counts as too large to be sent."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moved(df):
    """For each shuffle of the plan as first made, the columns of the scan below it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange hashpartitioning", plan)), plan


def pool_rows(spark, n=500):
    return spark.range(n).select("id", F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("features"))


def test_joins_of_colocated_tables_move_nothing(spark, tmp_path, no_broadcast):
    pool = write_colocated(pool_rows(spark), f"{tmp_path}/pool", 8)
    preds = pool.select("id", (F.col("id") * 0.5).alias("mu"), F.lit(1.0).alias("var"))
    preds = write_colocated(preds, f"{tmp_path}/preds", 8, moved=False)
    zipped = pool.join(preds, "id")
    assert moved(zipped)[0] == 0 and zipped.count() == 500
    scores = spark.range(0, 500, 9).select("id", F.lit(1.0).alias("score"), F.lit(0).alias("iter"))
    # Only the side of the scores is moved.
    for df, n in ((unexplored(pool, scores), 500 - 56), (unexplored(preds, scores), 500 - 56), (training_rows(pool, scores, True), 56)):
        exchanges, plan = moved(df)
        assert exchanges == 1 and df.count() == n, plan
    plain = unexplored(pool_rows(spark).withColumn("x", F.lit(1)), scores)
    assert moved(plain)[0] == 2


def test_colocated_tables_are_read_again(spark, tmp_path, no_broadcast):
    path = f"{tmp_path}/it's a pool"
    assert not is_written(spark, path)
    rows = sorted(map(repr, write_colocated(pool_rows(spark, 90), path, 8).collect()))
    assert is_written(spark, path)
    again = read_colocated(spark, path, 8)
    assert sorted(map(repr, again.collect())) == rows
    assert moved(again.join(read_colocated(spark, path, 8).select("id"), "id"))[0] == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("colocated_")]


def test_colocated_edges(spark, tmp_path):
    rows = [(None, 1), (None, 2), (3, 1), (3, 1)]
    table = write_colocated(spark.createDataFrame(rows, "id long, v int"), f"{tmp_path}/nulls", 8)
    assert sorted(map(tuple, table.collect()), key=repr) == sorted(rows, key=repr)
    empty = write_colocated(spark.createDataFrame([], "id long, v int"), f"{tmp_path}/none", 8)
    assert empty.count() == 0


def _loop(spark, path, **options):
    pool = pool_rows(spark)
    oracle = spark.range(500).select("id", ((F.col("id") * 37) % 101).cast("double").alias("y"))
    settings = dict(k=20, max_iters=3, init_size=30, batch_sizes=[25, 40], metric="ucb", seed=3)
    return Explorer(spark, pool, LookupObjective(oracle), build_model("gp"), ExploreConfig(**{**settings, **options}), path)


@pytest.mark.parametrize("prune", [False, True])
def test_loop_on_a_colocated_pool(spark, tmp_path, prune, no_broadcast):
    """The same rows in the same rounds, and a restart that finds the pool in its place."""
    more = dict(prune=True, prune_min_prob=0.001) if prune else {}
    plain = _loop(spark, f"{tmp_path}/plain", **more)
    plain.run()
    placed = _loop(spark, f"{tmp_path}/placed", buckets=8, **more)
    placed.explore_initial()
    placed.explore_batch()
    state = placed.checkpoint()
    again = _loop(spark, f"{tmp_path}/placed", buckets=8, **more).restore(state)
    open_rows = unexplored(again._preds.select("id", "mu"), again.scores())
    assert moved(open_rows)[0] == 1
    assert moved(again.full_pool.join(again._preds, "id"))[0] == 0
    again.run()
    rows = lambda run: sorted(map(tuple, run.scores().select("id", "iter", "score").collect()))
    assert rows(again) == rows(plain)
    assert again.run_log == plain.run_log


# --- positions ----------------------------------------------------------------------------------


@pytest.fixture
def stored(spark, tmp_path):
    """A table of eleven files of different sizes; the position of each row is told by the files' order."""
    path = f"{tmp_path}/table"
    rows = spark.range(3_000).select("id", (F.col("id") * F.col("id") % 11).alias("part"), F.concat(F.lit("n"), "id").alias("name"))
    rows.repartitionByRange(11, "part", "id").sortWithinPartitions("part", "id").drop("part").write.parquet(path)
    order = []
    for f in sorted(Path(path).glob("*.parquet")):
        order += [r["id"] for r in spark.read.parquet(str(f)).collect()]
    return path, order


def read_files(df, path):
    """Files of ``path`` that the scans read, by their own figures."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if node.metrics().contains("numFiles") and f"[file:{path}]" in node.toString():
            found.append(node.metrics().apply("numFiles").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    assert found
    return sum(found)


def test_slices(spark, stored):
    path, order = stored
    table = RowOffsets(spark, path)
    assert table.n == 3_000
    for a, b in ((0, 1), (0, 3_000), (10, 10), (17, 1_200), (2_999, 5_000), (-5, 4), (500, 100), (4_000, 5_000)):
        got = sorted(r["id"] for r in table.slice(a, b).collect())
        assert got == sorted(order[max(a, 0) : max(b, 0)]) if a < b else got == []
    assert table.slice(0, 5).columns == ["id", "name"]
    plan = table.slice(100, 900)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_positions(spark, stored):
    path, order = stored
    rows = RowOffsets(spark, path).positions()
    assert sorted((r["_pos"], r["id"]) for r in rows.collect()) == list(enumerate(order))
    assert "Exchange hash" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most_files, most_sent", [(1_000, 1_000_000), (2, 1_000_000), (1_000, 0), (0, 0)])
def test_take(spark, stored, monkeypatch, most_files, most_sent):
    from activepool.sources import offsets

    monkeypatch.setattr(offsets, "MOST_FILES", most_files)
    monkeypatch.setattr(offsets, "MOST_SENT", most_sent)
    path, order = stored
    rng = random.Random(1)
    wanted = [(k, rng.randrange(-20, 3_020)) for k in range(400)] + [(400, 7), (401, 7)]
    rows = RowOffsets(spark, path).take(spark.createDataFrame(wanted, "draw int, pos long")).collect()
    assert sorted((r["draw"], r["pos"], r["id"]) for r in rows) == [(d, p, order[p]) for d, p in wanted if 0 <= p < 3_000]


def test_only_wanted_files_are_read(spark, stored):
    path, order = stored
    table = RowOffsets(spark, path)
    assert read_files(table.table, path) == 11
    near = spark.createDataFrame([(k, k) for k in range(20)], "draw int, pos long")
    assert read_files(table.take(near), path) == 1
    assert read_files(table.slice(3, 9), path) == 1
    plan = table.take(near)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan


def test_draws_repeat_and_cover(spark, stored):
    path, order = stored
    table = RowOffsets(spark, path)
    rows = draw_stored(table, 500, 3, "s").collect()
    positions = {(r["rep"], r["draw"]): r["pos"] for r in draw_positions(spark, 3_000, 500, 3, "s").collect()}
    assert len(rows) == 1_500 and all(order[positions[r["rep"], r["draw"]]] == r["id"] for r in rows)
    assert rows != draw_stored(table, 500, 3, "t").collect()


def test_an_empty_table_has_no_positions(spark, tmp_path):
    spark.createDataFrame([], "id long").write.parquet(f"{tmp_path}/none")
    table = RowOffsets(spark, f"{tmp_path}/none")
    assert table.n == 0 and table.slice(0, 5).collect() == []
    assert table.take(spark.createDataFrame([(1, 0)], "draw int, pos long")).collect() == []


# --- paid scores --------------------------------------------------------------------------------


def _seller(folder, dies_at=None, fails_at=()):
    """Sells 10 * id and leaves a mark for every call."""

    def score(i):
        import time
        import uuid
        from pathlib import Path

        if i == dies_at:
            time.sleep(2)  # the other tasks of the batch end meanwhile
            raise type("Killed", (BaseException,), {})
        Path(folder, f"{i}-{uuid.uuid4().hex}").touch()
        if i in fails_at:
            raise ValueError("no score")
        return 10.0 * i

    return score


def _calls(folder):
    found = {}
    for f in Path(folder).iterdir():
        i = int(f.name.split("-")[0])
        found[i] = found.get(i, 0) + 1
    return found


def test_a_killed_batch_is_not_paid_twice(spark, tmp_path):
    calls, journal = tmp_path / "calls", f"{tmp_path}/journal"
    calls.mkdir()
    batch = spark.range(40)
    with pytest.raises(Exception):
        FunctionObjective(_seller(calls, dies_at=33), journal=journal, journal_rows=2).score(batch, 40)
    first = _calls(calls)
    kept = {r["id"] for r in paid_scores(spark, journal, "bigint").collect()}
    assert 33 not in first and 0 < len(kept) < 40
    rows = FunctionObjective(_seller(calls), journal=journal, journal_rows=2).score(batch, 40).collect()
    assert sorted((r["id"], r["score"]) for r in rows) == [(i, 10.0 * i) for i in range(40)]
    bought = _calls(calls)
    # What the journal holds was bought once; what was lost with its task is bought again.
    assert all(bought[i] == 1 for i in kept) and set(bought) == set(range(40))
    assert all(bought[i] == first.get(i, 0) + (i not in kept) for i in range(40))
    # A third time nothing is bought, also for a part of the batch and other rows beside it.
    more = FunctionObjective(_seller(calls), journal=journal).score(spark.range(30, 50), 20).collect()
    assert sorted((r["id"], r["score"]) for r in more) == [(i, 10.0 * i) for i in range(30, 50)]
    assert all(n == bought.get(i, 1) for i, n in _calls(calls).items())


def test_errors_are_tried_again_and_failed_scores_are_not(spark, tmp_path):
    calls, journal = tmp_path / "calls", f"{tmp_path}/journal"
    calls.mkdir()
    rows = FunctionObjective(_seller(calls, fails_at={2, 3}), maximize=False, journal=journal).score(spark.range(6), 6).collect()
    assert sorted((r["id"], r["score"]) for r in rows if r["score"] is not None) == [(0, 0.0), (1, -10.0), (4, -40.0), (5, -50.0)]
    rows = FunctionObjective(_seller(calls), maximize=False, journal=journal).score(spark.range(6), 6).collect()
    assert sorted((r["id"], r["score"]) for r in rows) == [(i, -10.0 * i) for i in range(6)]
    assert _calls(calls) == {0: 1, 1: 1, 2: 2, 3: 2, 4: 1, 5: 1}
    nan = f"{tmp_path}/nan"
    for _ in range(2):
        rows = FunctionObjective(lambda i: float("nan"), journal=nan).score(spark.range(3), 3).collect()
        assert [r["score"] for r in rows] == [None] * 3
    assert paid_scores(spark, nan, "bigint").count() == 3


def test_the_loop_keeps_a_journal(spark, tmp_path):
    """A batch that dies in the second round: the restarted run pays for the rest of it."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def explorer(dies_at=None):
        pool = pool_rows(spark, 120)
        objective = FunctionObjective(_seller(calls, dies_at), payload="id", journal_rows=1)
        settings = dict(k=5, max_iters=1, init_size=10, batch_sizes=[20], metric="greedy", seed=2)
        return Explorer(spark, pool, objective, build_model("random"), ExploreConfig(**settings), f"{tmp_path}/run")

    whole = explorer()
    whole.explore_initial()
    state = whole.checkpoint()
    second = [r["id"] for r in acquire_batch(whole._predict(whole.scores()), whole.scores(), 20).collect()]
    with pytest.raises(Exception):
        explorer(dies_at=second[7]).restore(state).explore_batch()
    before = _calls(calls)
    done = explorer().restore(state)
    done.run()
    assert len(before) > 10 and done.scores().count() == 30
    kept = {r["id"] for r in paid_scores(spark, f"{tmp_path}/run/journal/iter=1", "bigint").collect()}
    assert set(second) <= kept and _calls(calls)[second[7]] == 1
    assert sum(n > 1 for n in _calls(calls).values()) <= 8  # at most the rows whose tasks were running


# --- best rows ----------------------------------------------------------------------------------


def test_merged_best_rows_are_those_of_all(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, float(rng.randrange(30))]), rng.randrange(6)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, iter int")
    for k in (1, 25, 390, 1000):
        best = None
        for it in range(6):
            new = df.filter(F.col("iter") == it)
            best = sc.best_rows(new, k) if best is None else sc.merge_best(best, new, k)
            best = spark.createDataFrame(best.collect(), "id long, score double")
            seen = df.filter(F.col("iter") <= it)
            assert sc.progress_of(best, k).first() == sc.progress(seen, k).first()
            assert sorted(r["id"] for r in best.collect()) == sorted(r["id"] for r in sc.top_explored(seen, k).collect())


def test_a_round_reads_the_best_rows_and_its_batch(spark, tmp_path):
    run = _loop(spark, f"{tmp_path}/run", max_iters=5)
    run.explore_initial()
    for _ in range(3):
        run.explore_batch()
        merged = sc.merge_best(run._read_best(), run._round(run.iter - 1), run.k)
        kinds = {f.split("/run/")[1].split("/")[0] + "/" + f.split("/run/")[1].split("/")[1] for f in merged.inputFiles()}
        assert kinds == {f"best/iter={run.iter}-0", f"scores/iter={run.iter - 1}"}
        assert run._read_best().count() == run.k
        assert sc.progress(run.scores(), run.k).first()["kth_best"] == run.run_log[-1]["kth_best"]


def test_loaded_scores_end_the_kept_best_rows(spark, tmp_path):
    """Scores loaded later replace better ones; the best rows are those of the table as it is then."""
    run = _loop(spark, f"{tmp_path}/run")
    run.explore_initial()
    run.explore_batch()
    worse = run.best().select("id", F.lit(-1.0).alias("score"))
    run.load_scores(worse)
    assert run._best_path is None
    want = sorted(map(tuple, sc.best_rows(run.scores(), run.k).collect()), key=repr)
    assert sorted(map(tuple, run.best().collect()), key=repr) == want
    run.explore_batch()
    want = sc.progress(run.scores(), run.k).first()
    assert run.run_log[-1]["kth_best"] == want["kth_best"] and run.run_log[-1]["top_avg"] == pytest.approx(want["top_avg"])
    state = run.checkpoint()
    again = _loop(spark, f"{tmp_path}/run").restore(state)
    assert again._best_path == run._best_path
