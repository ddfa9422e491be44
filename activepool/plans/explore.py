"""The exploration loop: score a batch, fit, predict the pool, pick the next batch, until a stop rule.

The driver holds one small row per round. Pool, scores and predictions stay tables: every round's
scores are their own directory (never rewritten), so no lineage grows and a restart reads what is
there. The best k rows so far are a table of their own, into which a round merges its batch, so a round's
averages cost k and the batch, not all that was scored. Scores that a function sells are kept in a journal
as they come in.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.acquisition import (
    UtilityArgs,
    acquire_batch,
    acquire_cluster_batch,
    check_model,
    initial_batch,
    initial_cluster_batch,
    metric_needs,
    retrieval_rate,
    with_utility,
)
from ..operators.prune import expected_pruned, prune, prune_threshold
from ..operators.scores import (
    best_rows,
    final_averages,
    merge_best,
    progress_columns,
    progress_of,
    resolve_size,
    scheduled_size,
    status_line,
    stops,
)
from ..session import scratch_scope
from ..sources.colocated import is_written, read_colocated, write_colocated
from ..sources.files import write_final_scores
from ..surrogates import Surrogate, training_rows
from .objective import Objective

log = logging.getLogger(__name__)


# The defaults below are those of the configurations that this loop reproduces.
@dataclass
class ExploreConfig:
    k: int | float = 0.0005
    budget: int | float = 1.0
    max_iters: int = 50
    window: int = 10
    delta: float = 0.01
    init_size: int | float = 0.01
    batch_sizes: list = field(default_factory=lambda: [0.01])
    metric: str = "greedy"
    beta: float = 2.0
    xi: float = 0.01
    threshold: float = float("-inf")
    epsilon: float = 0.0
    seed: int = 0
    retrain: bool = False
    cluster: bool = False
    temp_start: float = 1.0
    temp_end: float = 1.0
    prune: bool = False
    prune_min_prob: float = 0.025
    observed_threshold: bool = False
    checkpoint_every: int = 0
    prefilter_from: int = 1_000_000
    # Files by key of the pool and of all predictions; 0 leaves them as they are.
    buckets: int = 0


class Explorer:
    """``pool(id, features[, cluster_id])``; all output goes below ``path``.

    With ``buckets`` in the configuration (at least ``spark.sql.shuffle.partitions``) the pool is written once
    in files by key and predictions follow it, so their joins with each other move no row and those with the
    scores move the scores only. The pool of a path that holds one is not read again.
    """

    def __init__(
        self,
        spark: SparkSession,
        pool: DataFrame,
        objective: Objective,
        model: Surrogate,
        config: ExploreConfig,
        path: str,
        true_top: DataFrame | None = None,
    ):
        check_model(config.metric, model.provides)
        if config.prune and "vars" not in model.provides:
            raise ValueError("pruning by probability needs a model with variances")
        self.spark, self.objective, self.model = spark, objective, model
        self.config, self.path, self.true_top = config, path.rstrip("/"), true_top
        if config.buckets:
            # Written once; a run that goes on reads what is there.
            placed = f"{self.path}/pool"
            if is_written(spark, placed):
                pool = read_colocated(spark, placed, config.buckets)
            else:
                pool = write_colocated(pool, placed, config.buckets)
        self.pool = self.full_pool = pool
        self.pool_size = pool.count()
        self.k = min(resolve_size(config.k, self.pool_size), self.pool_size)
        self.budget = resolve_size(config.budget, self.pool_size)
        if self.k <= 0 or self.budget <= 0:
            raise ValueError("k and budget must be greater than 0")
        self.init_size = resolve_size(config.init_size, self.pool_size, "ceil")
        self.batch_sizes = [resolve_size(b, self.pool_size, "ceil") for b in config.batch_sizes]
        self.iter = 0
        self.n_prior = self.n_scored = 0
        self.run_log: list[dict] = []
        self._fitted = False
        self._preds: DataFrame | None = None
        self._preds_path: str | None = None
        self.prior_paths: list[str] = []
        self._best_path: str | None = None

    # --- tables ---------------------------------------------------------------------------------

    def scores(self) -> DataFrame:
        """All scored rows of finished rounds (a half-written later round is not seen).

        Results loaded after the first round replace earlier ones of the same key.
        """
        rows = self.spark.read.schema(self._score_schema()).parquet(f"{self.path}/scores")
        rows = rows.filter(F.col("iter") < self.iter)
        if not self.prior_paths:
            return rows
        rows = rows.withColumn("_age", F.lit(0))
        for age, path in enumerate(self.prior_paths, 1):
            loaded = self.spark.read.schema(self._score_schema()).parquet(path)
            rows = rows.unionByName(loaded.withColumn("_age", F.lit(age)))
        # One struct holds the NULLs, too, which max_by over single columns would pass over.
        kept = [c for c in rows.columns if c not in ("id", "_age")]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*kept), "_age").alias("_last"))
        return last.select("id", "_last.*")

    def _score_schema(self) -> str:
        id_type = dict(self.pool.dtypes)["id"]
        return f"id {id_type}, score double, utility double, is_prior boolean, iter int"

    def _write_round(self, rows: DataFrame, iteration: int) -> dict:
        """Writes one round; its row count and mean are observed during the write."""
        seen = Observation(f"round {iteration}")
        rows.select("id", "score", "utility", "is_prior").observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.count("score").alias("n_valid"),
            F.avg("score").alias("batch_avg"),
        ).write.mode("overwrite").parquet(f"{self.path}/scores/iter={iteration}")
        return seen.get

    def _round(self, iteration: int) -> DataFrame:
        return self.spark.read.schema(self._score_schema()).parquet(f"{self.path}/scores/iter={iteration}")

    # --- rounds ---------------------------------------------------------------------------------

    def load_scores(self, prior: DataFrame) -> None:
        """Earlier results as an upsert: a key counts once, with its largest loaded score.

        Before the first round they replace the initial batch. Later they join the rounds that are
        there, replacing scores of the same keys; nothing is rewound. Loaded rows are not charged.
        """
        rows = prior.groupBy("id").agg(F.max("score").alias("score")).select(
            "id",
            "score",
            F.lit(None).cast("double").alias("utility"),
            F.lit(True).alias("is_prior"),
        )
        if self.iter == 0:
            self.n_prior = self.n_scored = self._write_round(rows, 0)["n"]
            self.iter = 1
            return
        self._best_path = None  # loaded scores may replace rows of the best k, also by worse ones
        path = f"{self.path}/prior/part={len(self.prior_paths)}"
        rows = rows.withColumn("iter", F.lit(self.iter - 1))
        rows.write.mode("overwrite").parquet(path)
        loaded = self.spark.read.schema(self._score_schema()).parquet(path)
        # A key that a round paid for stays charged.
        fresh = loaded.join(self.scores().select("id"), "id", "left_anti").count()
        self.prior_paths.append(path)
        self.n_prior += fresh
        self.n_scored += fresh

    def explore_initial(self) -> float | None:
        """Scores the initial batch; scratch tables of the round are dropped at its end."""
        with scratch_scope(self.spark):
            return self._initial()

    def explore_batch(self) -> float | None:
        """Fits, predicts and scores the next batch; scratch tables of the round are dropped at its end."""
        with scratch_scope(self.spark):
            return self._batch()

    def _initial(self) -> float | None:
        if self.config.cluster:
            batch = initial_cluster_batch(self.pool.select("id", "cluster_id"), self.init_size, self.config.seed)
        else:
            batch = initial_batch(self.pool.select("id"), self.init_size, self.config.seed)
        batch = batch.select("id", F.lit(None).cast("double").alias("utility"))
        return self._score_batch(batch, self.init_size, exhausted_below=1)

    def _batch(self) -> float | None:
        if self.iter == 0:
            raise RuntimeError("score an initial batch first")
        if self.run_log and self.run_log[-1]["exhausted"]:
            log.info("the pool is exhausted")
            return None
        scores = self.scores()
        preds = self._predict(scores)
        if self.config.prune:
            preds = self._prune(preds, scores)
        size = scheduled_size(self.batch_sizes, self.iter - 1)
        best = self._kth_best()
        args = UtilityArgs(
            best=F.lit(best),
            threshold=self.config.threshold,
            beta=self.config.beta,
            xi=self.config.xi,
            salt=f"{self.config.seed}/{self.iter}",
        )
        if self.config.cluster:
            rated = with_utility(preds, self.config.metric, args).join(
                self.pool.select("id", "cluster_id"), "id"
            )
            batch = acquire_cluster_batch(
                rated,
                scores,
                size,
                self.iter - 1,
                self.config.temp_start,
                self.config.temp_end,
                epsilon=self.config.epsilon,
                salt=args.salt,
            )
        else:
            batch = acquire_batch(
                preds,
                scores,
                size,
                self.config.metric,
                args,
                self.config.epsilon,
                prefilter_from=1 if self.n_scored >= self.config.prefilter_from > 0 else 0,
            )
        # Clustered quotas may fall below the batch on purpose, so only an empty batch ends the pool.
        floor = 1 if self.config.cluster else size
        return self._score_batch(batch.select("id", "utility"), size, exhausted_below=floor)

    def _kth_best(self) -> float:
        """The k-th best score so far, as the last round left it unless results were loaded since."""
        if self.run_log and self.run_log[-1]["n_acquired"] == self.n_scored and not self.prior_paths:
            best = self.run_log[-1]["kth_best"]
        else:
            best = progress_of(self.best(), self.k).first()["kth_best"]
        return float("-inf") if best is None else best

    def best(self) -> DataFrame:
        """The best k rows so far, ``(id, score)``: the kept table, or all scores where there is none yet."""
        if self._best_path is None:
            self._keep_best(best_rows(self.scores(), self.k))
        return self._read_best()

    def _read_best(self) -> DataFrame:
        return self.spark.read.schema(f"id {dict(self.pool.dtypes)['id']}, score double").parquet(self._best_path)

    def _keep_best(self, rows: DataFrame) -> dict:
        """Writes the best rows; their averages are observed during the write."""
        path = f"{self.path}/best/iter={self.iter}-{len(self.prior_paths)}"
        seen = Observation(f"best {self.iter}")
        rows.observe(seen, *progress_columns(self.k)).write.mode("overwrite").parquet(path)
        self._best_path = path
        return seen.get

    def _any_valid(self, rows: DataFrame) -> bool:
        """Whether there is a row to fit on, from the run log where it says so."""
        if self.run_log and not self.prior_paths:
            seen = self.run_log if self.config.retrain else self.run_log[-1:]
            if any(r["n_valid"] for r in seen):
                return True
            if not self.config.retrain:
                return False
        return not rows.isEmpty()

    def _predict(self, scores: DataFrame) -> DataFrame:
        """Fits on the new rows (or all), predicts the pool once, keeps the result as a table."""
        need_var = "vars" in metric_needs(self.config.metric) or self.config.prune
        # Results loaded at the start count as the last round of the first fit.
        rows = training_rows(self.pool, scores, self.config.retrain, self.iter - 1)
        if not self._any_valid(rows):
            if self._preds is None:
                raise RuntimeError("no scored rows to fit a model on")
            return self._preds
        if self.model.online and not self.config.retrain:
            # The new rows are added to what earlier rounds taught.
            self.model.fit(rows, online=self._fitted)
        else:
            self.model.fit(rows)
        self._fitted = True
        path = f"{self.path}/preds/iter={self.iter}"
        self._preds, self._preds_path = self._kept(self.model.predict(self.pool, need_var), path), path
        return self._preds

    def _kept(self, rows: DataFrame, path: str) -> DataFrame:
        """Rows of the pool as a table at ``path``; they lie as the pool lies, so none is moved."""
        if self.config.buckets:
            return write_colocated(rows, path, self.config.buckets, moved=False)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _kept_before(self, path: str) -> DataFrame:
        buckets = self.config.buckets
        return read_colocated(self.spark, path, buckets) if buckets else self.spark.read.parquet(path)

    def _prune(self, preds: DataFrame, scores: DataFrame) -> DataFrame:
        row = prune_threshold(preds, scores, self.k, self.config.observed_threshold).first()
        threshold = F.lit(row["kth_best"])
        audit = expected_pruned(preds, threshold, self.config.prune_min_prob).first()
        path = f"{self.path}/retained/iter={self.iter}"
        kept = self._kept(prune(preds, threshold, self.config.prune_min_prob).drop("p_hit"), path)
        self.pool = self.full_pool.join(kept.select("id"), "id", "left_semi")
        log.info("kept %d rows, expected hits pruned: %.2f", audit["n_kept"], audit["expected_hits_pruned"])
        self._preds, self._preds_path = kept, path
        return kept

    def _score_batch(self, batch: DataFrame, size: int, exhausted_below: int) -> float | None:
        path = f"{self.path}/batches/iter={self.iter}"
        taken = Observation(f"batch {self.iter}")
        batch.observe(taken, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        batch = self.spark.read.parquet(path)
        n = taken.get["n"]
        wanted = batch
        if any(c not in batch.columns for c in self.pool.columns):
            payload = getattr(self.objective, "payload", "id")
            if payload != "id":
                wanted = batch.join(self.pool.select("id", payload), "id")
        self.objective.keep_journal(f"{self.path}/journal/iter={self.iter}")
        scored = self.objective.score(wanted, n)
        rows = batch.join(scored, "id", "left").select(
            "id", "score", "utility", F.lit(False).alias("is_prior")
        )
        seen = self._write_round(rows, self.iter)
        average = seen["batch_avg"]
        if seen["n"] > seen["n_valid"]:
            log.warning("%d of %d rows of round %d failed", seen["n"] - seen["n_valid"], seen["n"], self.iter)
        self.iter += 1
        # A batch holds unexplored rows only, so the rows add up.
        self.n_scored += n
        if self._best_path is None:
            reached = self._keep_best(best_rows(self.scores(), self.k))
        else:
            reached = self._keep_best(merge_best(self._read_best(), self._round(self.iter - 1), self.k))
        top = reached["top_avg"] if self.n_scored >= self.k else None
        self.run_log.append(
            {
                "iter": self.iter,
                "n_new": n,
                "n_acquired": self.n_scored,
                "n_prior": self.n_prior,
                "exhausted": n < exhausted_below,
                "batch_avg": average,
                "top_avg": top,
                "kth_best": reached["kth_best"],
                "n_valid": seen["n_valid"],
            }
        )
        every = self.config.checkpoint_every
        if self.iter > every and (every == 0 or self.iter % (every + 1) == 0):
            self.checkpoint()
        return average

    # --- control --------------------------------------------------------------------------------

    def completed(self) -> bool:
        cfg = self.config
        return stops(self.run_log, cfg.max_iters, self.budget, cfg.window, cfg.delta)

    def status(self) -> str:
        if not self.run_log:
            return f"round {self.iter}/{self.config.max_iters} | no scores"
        return status_line(self.run_log[-1], self.config.max_iters, self.k, self.budget)

    def retrieval(self) -> float | None:
        if self.true_top is None:
            return None
        return retrieval_rate(self.best(), self.true_top, self.k).first()["rate"]

    def run(self) -> DataFrame:
        """Explores until a stop rule holds, writes the final scores and returns the final averages."""
        try:
            if self.iter == 0:
                self.explore_initial()
            else:
                self.explore_batch()
            while not self.completed():
                if log.isEnabledFor(logging.INFO):
                    log.info("%s | retrieval %s", self.status(), self.retrieval())
                self.explore_batch()
        except Exception:
            try:
                self.checkpoint()
            except Exception:  # the first error is the one to see
                log.exception("no checkpoint could be written after the failure")
            raise
        log.info("finished: %s", self.status())
        write_final_scores(self.scores(), self.path)
        return final_averages(self.scores(), self.pool_size)

    # --- checkpoints ----------------------------------------------------------------------------

    def checkpoint(self) -> str:
        """Writes the model and, last, the state; the tables of the rounds are already there."""
        base = f"{self.path}/chkpts/iter_{self.iter}"
        model_path = None
        if self._fitted:
            model_path = self.model.save(f"{base}/model")
        state = {
            "iter": self.iter,
            "n_prior": self.n_prior,
            "run_log": self.run_log,
            "model": model_path,
            "preds": self._preds_path,
            "priors": self.prior_paths,
            "best": self._best_path,
            "pruned": self.config.prune and self._preds is not None,
            "config": asdict(self.config),
        }
        rows = self.spark.createDataFrame([(json.dumps(state),)], "value string")
        rows.coalesce(1).write.mode("overwrite").text(f"{base}/state")
        return f"{base}/state"

    def restore(self, state_path: str) -> "Explorer":
        """Continues a run from a checkpoint; the next batch is the one the run would have taken."""
        state = json.loads(self.spark.read.text(state_path).first()["value"])
        self.iter, self.n_prior, self.run_log = state["iter"], state["n_prior"], state["run_log"]
        self.n_scored = self.run_log[-1]["n_acquired"] if self.run_log else self.n_prior
        self.prior_paths = list(state["priors"])
        self._best_path = state.get("best")
        if state["model"]:
            self.model.load(self.spark, state["model"])
            self._fitted = True
        if state["preds"]:
            self._preds_path = state["preds"]
            self._preds = self._kept_before(self._preds_path)
            if state["pruned"]:
                self.pool = self.full_pool.join(self._preds.select("id"), "id", "left_semi")
        return self
