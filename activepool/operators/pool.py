"""The candidate pool ``(id, payload, features[, cluster_id])``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import pinned
from .features import cluster_rows


def make_pool(
    df: DataFrame,
    key: str,
    payload: str,
    features: Column,
    eager: bool = True,
    clusters: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Valid rows with their features (NULL features mean an invalid row).

    ``eager`` writes the features once; a lazy pool computes them in every scan and has no clusters.
    ``features`` is any column: the built-in token features or a user's pandas UDF.
    """
    if clusters and not eager:
        raise ValueError("clusters need an eager pool")
    # A filter on the features would be pushed below the projection and compute them twice;
    # exploding a list of at most one drops the invalid rows in the same pass.
    valid = F.filter(F.array(features), lambda f: f.isNotNull())
    rows = df.select(F.col(key).alias("id"), F.col(payload).alias("payload"), F.explode(valid).alias("features"))
    if not eager:
        return rows
    rows = pinned(rows, "pool")
    return rows.join(cluster_rows(rows, clusters, seed), "id") if clusters else rows
