"""The exploration loop, its checkpoints and the jobs around finished runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from activepool.operators.acquisition import initial_batch
from activepool.operators.ordering import top_n
from activepool.plans.explore import ExploreConfig, Explorer
from activepool.plans.extract import first_scored
from activepool.plans.objective import FunctionObjective, LookupObjective
from activepool.plans.retrospect import read_runs, reward_matrix
from activepool.session import pinned
from activepool.sources.files import read_ordered_scores
from activepool.surrogates import BatchFunctionSurrogate, build_model

from .features import vector_truth, vectors
from .registry import BASE, oracle, pool, query, u_sql
from .sources import run_directory


def _explorer(t, path, **options) -> Explorer:
    """Pool ``part``, known scores, a random model: every pick can be told in SQL."""
    settings = dict(
        k=50, budget=1.0, max_iters=2, window=10, init_size=0.01, batch_sizes=[40, 60], seed="s"
    )
    config = ExploreConfig(**{**settings, **options})
    true_top = top_n(oracle(t), 50, "y", "id").select("id")
    rows = pool(t).select("id", F.array("price").alias("features"))
    return Explorer(
        t.spark, rows, LookupObjective(oracle(t)), build_model("random"), config, path, true_top
    )


PICKS = f"""picks AS (
  SELECT p.id, row_number() OVER (ORDER BY {u_sql('p.id', 'mean/0')} DESC, p.id DESC) AS r FROM pool p
  WHERE p.id NOT IN (SELECT id FROM explored)),
  taken AS (SELECT id, 0 AS iter FROM explored UNION ALL SELECT id, CASE WHEN r <= 40 THEN 1 ELSE 2 END FROM picks WHERE r <= 100)"""


@query(
    "lop1_exploration_loop",
    f"{BASE}, {PICKS} SELECT t.id, t.iter, o.y AS score FROM taken t LEFT JOIN truth o ON o.id = t.id",
)
def lop1(t):
    """Initial batch and two greedy rounds until the round limit."""
    explorer = _explorer(t, t.scratch("explore"))
    explorer.run()
    return explorer.scores().select("id", "iter", "score")


@query(
    "lop1_colocated_loop",
    f"{BASE}, {PICKS} SELECT t.id, t.iter, o.y AS score FROM taken t LEFT JOIN truth o ON o.id = t.id",
)
def lop1_colocated(t):
    """The same loop over a pool and predictions in files by key."""
    explorer = _explorer(t, t.scratch("explore"), buckets=max(8, int(t.spark.conf.get("spark.sql.shuffle.partitions"))))
    explorer.run()
    return explorer.scores().select("id", "iter", "score")


@query(
    "lop1_loop_final_ranking",
    f"""{BASE}, {PICKS} SELECT t.id::varchar AS id, round(o.y, 6) AS score,
        row_number() OVER (ORDER BY o.y DESC NULLS LAST, t.id DESC) AS pos
        FROM taken t LEFT JOIN truth o ON o.id = t.id""",
)
def lop1_final(t):
    """The final score file of the loop, best first."""
    path = t.scratch("explore")
    _explorer(t, path).run()
    ranked = read_ordered_scores(t.spark, f"{path}/data/all_explored_final.csv")
    return first_scored(ranked, 10**9).withColumn("score", F.round("score", 6))


@query("snk4_checkpoint", f"{BASE} SELECT id, score FROM explored")
def snk4(t):
    """State after the initial batch, written and read back by a new session object."""
    path = t.scratch("explore")
    first = _explorer(t, path)
    first.explore_initial()
    state = first.checkpoint()
    return _explorer(t, path).restore(state).scores().select("id", "score")


@query(
    "snk5_restored_run_continues",
    f"{BASE}, {PICKS} SELECT t.id, t.iter, o.y AS score FROM taken t LEFT JOIN truth o ON o.id = t.id",
)
def snk5(t):
    """A run stopped after round 1 and restored takes the batch the whole run would have taken."""
    path = t.scratch("explore")
    first = _explorer(t, path)
    first.explore_initial()
    first.explore_batch()
    state = first.checkpoint()
    again = _explorer(t, path).restore(state)
    again.run()
    return again.scores().select("id", "iter", "score")


@query(
    "lop1_surrogate_loop",
    """SELECT 0 AS iter, ceil(count(*) * 0.05)::bigint AS n, true AS looked_up, true AS once FROM embeddings
    UNION ALL SELECT i, ceil(count(*) * 0.03)::bigint, true, true FROM embeddings, range(1, 4) r(i) GROUP BY i""",
)
def lop1_surrogate(t):
    """The whole engine on feature vectors: linear Gaussian model, UCB, pruning.

    Every round takes its batch, no row twice, with the scores of the oracle.
    """
    config = ExploreConfig(
        k=20, budget=0.5, max_iters=3, window=10, delta=0.0, init_size=0.05, batch_sizes=[0.03],
        metric="ucb", seed=1, retrain=True, prune=True, prune_min_prob=0.001,
    )
    explorer = Explorer(
        t.spark, vectors(t), LookupObjective(vector_truth(t)), build_model("gp"), config, t.scratch("explore")
    )
    explorer.run()
    rows = explorer.scores().join(vector_truth(t), "id", "left")
    times = rows.groupBy("id").agg(F.count("*").alias("times"))
    return rows.join(times, "id").groupBy("iter").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("score").eqNullSafe(F.col("y"))).alias("looked_up"),
        F.bool_and(F.col("times") == 1).alias("once"),
    )


USER_PICKS = f"""{BASE}, picks AS (
  SELECT p.id, row_number() OVER (ORDER BY p.price DESC, p.id DESC) AS r FROM pool p
  WHERE p.id NOT IN (SELECT id FROM explored)),
  taken AS (SELECT id, 0 AS iter FROM explored UNION ALL SELECT id, CASE WHEN r <= 40 THEN 1 ELSE 2 END FROM picks WHERE r <= 100)"""
USER_ROWS = f"{USER_PICKS} SELECT t.id, t.iter, o.y AS score FROM taken t LEFT JOIN truth o ON o.id = t.id"


def _user_explorer(t, path, objective=None, **options) -> Explorer:
    """A user's model that ranks by price, fitted anew every round, checkpointed every round."""

    def fit(rows):
        assert rows.count() > 0

        def make():
            import numpy as np

            return lambda x: np.stack([x[:, 0], np.ones(len(x))], axis=1).astype("float64")

        return make

    settings = dict(k=50, budget=1.0, max_iters=2, window=10, init_size=0.01, batch_sizes=[40, 60], seed="s")
    rows = pool(t).select("id", F.array("price").alias("features"))
    model = BatchFunctionSurrogate(None, width=1, fit_fn=fit)
    return Explorer(
        t.spark, rows, objective or LookupObjective(oracle(t)), model, ExploreConfig(**{**settings, **options}), path
    )


@query("lop1_user_model_loop", USER_ROWS)
def lop1_user(t):
    explorer = _user_explorer(t, t.scratch("explore"))
    explorer.run()
    return explorer.scores().select("id", "iter", "score")


class _FailsAfter(LookupObjective):
    """Scores the first batch; later ones fail as rows, or with an error."""

    def __init__(self, table, first, error=False):
        super().__init__(table)
        self.first, self.error = first, error

    def score(self, batch, batch_rows=None):
        if batch_rows == self.first:
            return super().score(batch, batch_rows)
        if self.error:
            raise RuntimeError("scorer is down")
        return super().score(batch, batch_rows).withColumn("score", F.lit(None).cast("double"))


@query(
    "snk5_restart_after_failed_round",
    f"""{USER_PICKS} SELECT t.id, t.iter, CASE WHEN t.iter = 0 THEN o.y END AS score
    FROM taken t LEFT JOIN truth o ON o.id = t.id""",
)
def snk5_failed(t):
    """Both batches fail as a whole; the second is taken after a restart with the predictions that are there."""
    path, first = t.scratch("explore"), math.ceil(t.part.count() * 0.01)
    run = _user_explorer(t, path, _FailsAfter(oracle(t), first))
    run.explore_initial()
    run.explore_batch()
    again = _user_explorer(t, path, _FailsAfter(oracle(t), first)).restore(run.checkpoint())
    again.run()
    return again.scores().select("id", "iter", "score")


@query("snk5_restart_from_rescue", USER_ROWS)
def snk5_rescue(t):
    """The scorer breaks in the first batch round; the checkpoint written then is where the run goes on."""
    path, first = t.scratch("explore"), math.ceil(t.part.count() * 0.01)
    run = _user_explorer(t, path, _FailsAfter(oracle(t), first, error=True))
    try:
        run.run()
    except RuntimeError:
        pass
    again = _user_explorer(t, path).restore(f"{path}/chkpts/iter_1/state")
    again.run()
    return again.scores().select("id", "iter", "score")


@query(
    "snk4_journal_of_a_killed_batch",
    f"""{BASE}, b AS (SELECT id, payload FROM pool WHERE id IN (SELECT id FROM explored))
    SELECT id, length(payload)::double AS score, 1::bigint AS times_paid FROM b""",
)
def snk4_journal(t):
    """A batch dies with one of its tasks; scoring it again buys what is left, and the journal has each row once."""
    n = math.ceil(t.part.count() * 0.01)
    batch = pinned(initial_batch(pool(t).select("id", "payload"), n, "s"), "batch")
    journal, last = t.scratch("journal"), batch.agg(F.max(F.struct("id", "payload")).alias("m")).first()["m"]["payload"]

    def score(stops_at=None):
        def price(name):
            if name == stops_at:  # ends the task the way a lost worker does: no row of it comes back
                raise type("Stopped", (BaseException,), {})
            return float(len(name))

        return FunctionObjective(price, payload="payload", journal=journal, journal_rows=4).score(batch, n)

    try:
        score(stops_at=last)
    except Exception as e:  # the job's error, as Spark reports it
        assert "Stopped" in str(e)
    scored = score()
    rows = t.spark.read.schema("id bigint, score double, error string").option("recursiveFileLookup", "true").parquet(journal)
    return scored.join(rows.groupBy("id").agg(F.count("*").alias("times_paid")), "id").select("id", "score", "times_paid")


@query(
    "lop3_warm_start_of_a_run",
    f"""{BASE}, later AS (SELECT id, y FROM truth WHERE id % 10 = 3),
    early AS (SELECT id, y AS score FROM truth WHERE id % 20 = 1)
    SELECT coalesce(l.id, e.id) AS id, coalesce(l.y + 100, e.score) AS score, true AS is_prior, 2 * count(*) FILTER (WHERE e.id IS NOT NULL) OVER () AS loaded
    FROM early e FULL JOIN later l ON l.id = e.id""",
)
def lop3_explorer(t):
    """Earlier results with repeated keys before the run, more of them later: an upsert, nothing rewound."""
    run = _user_explorer(t, t.scratch("explore"))
    truth = oracle(t).withColumnRenamed("y", "score")
    early = truth.filter("id % 20 = 1")
    run.load_scores(early.unionByName(early))
    loaded = 2 * run.n_prior
    run.load_scores(truth.filter("id % 10 = 3").withColumn("score", F.col("score") + 100))
    return run.scores().select("id", "score", "is_prior", F.lit(loaded).cast("bigint").alias("loaded"))


@query(
    "lop1_run_directory_rewards",
    """WITH c AS (SELECT event_id, value, date_diff('day', DATE '2024-01-01', ts::date) AS iter FROM events WHERE event_type = 'click'),
    top AS (SELECT event_id, value FROM events ORDER BY value DESC, event_id::varchar DESC LIMIT 60),
    f AS (SELECT event_id, value FROM c WHERE iter <= 9 ORDER BY value DESC, event_id::varchar DESC LIMIT 60),
    w AS (SELECT value, count(*) AS w FROM top GROUP BY 1), h AS (SELECT value, count(*) AS h FROM f GROUP BY 1)
    SELECT 'clicks' AS run_id, round((SELECT avg(value) FROM f) / (SELECT avg(value) FROM top), 6) AS f_avg,
      round((SELECT count(*) FROM f WHERE event_id IN (SELECT event_id FROM top)) / 60.0::double, 6) AS f_keys,
      round((SELECT sum(least(w, h)) FROM w JOIN h ON h.value = w.value) / 60.0::double, 6) AS f_scores""",
)
def lop1_rewards(t):
    """Rewards of a run directory against the true scores of all events."""
    runs = read_runs(t.spark, {"clicks": run_directory(t)})
    truth = t.events.select(F.col("event_id").cast("string").alias("id"), F.col("value").alias("y"))
    matrix = reward_matrix(runs, truth, 9, 60)
    return matrix.select("run_id", *[F.round(c, 6).alias(c) for c in ("f_avg", "f_keys", "f_scores")])
