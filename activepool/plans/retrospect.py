"""Retrospective scoring of finished runs against the full table of true scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.curves import first_seen
from ..operators.evaluate import rewards
from ..operators.ordering import top_n
from ..sources.files import read_run_scores


def true_top(oracle: DataFrame, k: int) -> DataFrame:
    """The k best rows of a (signed) oracle ``(id, y)`` as ``(id, score)``."""
    return top_n(oracle.select("id", F.col("y").alias("score")), k, "score", "id")


def read_runs(spark: SparkSession, run_dirs: dict[str, str]) -> DataFrame:
    """New rows per round of many run directories: ``(run_id, iter, id, score)``.

    The files of a run are cumulative, so each key is kept at its first round.
    """
    frames = [
        read_run_scores(spark, path).select(F.lit(name).alias("run_id"), "iter", "id", "score")
        for name, path in run_dirs.items()
    ]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows.groupBy("run_id", "id").agg(
        F.min("iter").alias("iter"), F.max_by("score", "iter").alias("score")
    )


def reward_matrix(runs: DataFrame, oracle: DataFrame, iteration: int, k: int) -> DataFrame:
    """One row per run: the three rewards at a round, all runs in one job."""
    return rewards(runs, true_top(oracle, k), iteration, k)


def new_per_round(runs: DataFrame) -> DataFrame:
    return first_seen(runs).groupBy("run_id", "iter").agg(F.count(F.lit(1)).alias("n_new"))
