"""Pruning by the probability of being a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prob_above
from ..session import pinned
from .scores import kth_best, top_explored


def prune_threshold(
    preds: DataFrame, scores: DataFrame | None, k: int, observed: bool = False
) -> DataFrame:
    """One row ``kth_best``: the k-th best predicted mean, or the worst of the k best observed scores."""
    if observed:
        return top_explored(scores, k).agg(F.min("score").alias("kth_best"))
    return kth_best(preds.select("id", F.col("mu").alias("score")), k)


def with_hit_probability(preds: DataFrame, threshold, name: str = "p_hit") -> DataFrame:
    """Adds P(value > threshold); without a variance column the hard rule mu >= threshold."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if "var" in preds.columns:
        return preds.withColumn(name, prob_above(F.col("mu"), F.col("var"), threshold))
    return preds.withColumn(name, (F.col("mu") >= threshold).cast("double"))


def prune(preds: DataFrame, threshold, p_min: float = 0.025) -> DataFrame:
    """Rows that stay in the pool."""
    return with_hit_probability(preds, threshold).filter(F.col("p_hit") >= p_min)


def expected_pruned(preds: DataFrame, threshold, p_min: float = 0.025) -> DataFrame:
    """One row: rows kept, rows dropped, and the expected number of hits among the dropped."""
    rated = with_hit_probability(preds, threshold)
    kept = F.col("p_hit") >= p_min
    return rated.agg(
        F.count_if(kept).alias("n_kept"),
        F.count_if(~kept).alias("n_pruned"),
        F.coalesce(F.sum(F.when(~kept, F.col("p_hit"))), F.lit(0.0)).alias("expected_hits_pruned"),
    )


def retained_ids(preds: DataFrame, threshold, p_min: float = 0.025) -> DataFrame:
    """The kept ids as a written table, so later rounds do not repeat the predictions."""
    return pinned(prune(preds, threshold, p_min).select("id"), "retained")
