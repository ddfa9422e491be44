"""Fetches the files of the best rows of a finished run from per-node archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import extract_members, extraction_counts, read_archives, read_ordered_scores
from ..sources.text import read_pose_index


def first_scored(ranked: DataFrame, k: int) -> DataFrame:
    """Of the first k rows of a sorted score table, those that have a score."""
    return ranked.filter((F.col("pos") <= k) & F.col("score").isNotNull())


def extract_top(spark: SparkSession, run_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Members of the archives that belong to the best k rows, and their number per node."""
    ranked = read_ordered_scores(spark, f"{run_dir}/data/all_explored_final.csv")
    wanted = read_pose_index(spark, f"{run_dir}/extended.csv", first_scored(ranked, k))
    members = extract_members(read_archives(spark, run_dir), wanted)
    return members, extraction_counts(members)
