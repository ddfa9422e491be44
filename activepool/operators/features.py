"""Clusters and projections of the feature table."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hash_uniform
from ..functions.tokens import grams, tokenize
from ..session import pinned, scratch_path


def hashed_sample(df: DataFrame, key: str, share: float, salt: str) -> DataFrame:
    """About ``share`` of the rows, the same rows on every run."""
    return df if share >= 1.0 else df.filter(hash_uniform(F.col(key), f"sample/{salt}") < share)


def as_vector(features: DataFrame) -> DataFrame:
    return features.withColumn("_x", array_to_vector(F.col("features").cast("array<double>")))


def cluster_centres(
    features: DataFrame, k: int = 100, seed: int = 0, max_iter: int = 20, share: float = 1.0
):
    """The fitted k-means model, on all rows; a ``share`` below 1 fits on a hashed sample instead."""
    rows = as_vector(features.select("id", "features"))
    sample = pinned(hashed_sample(rows, "id", share, f"kmeans/{seed}").select("_x"), "kmeans")
    estimator = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_x", predictionCol="cluster_id")
    return estimator.fit(sample)


def cluster_rows(
    features: DataFrame, k: int = 100, seed: int = 0, max_iter: int = 20, share: float = 1.0
) -> DataFrame:
    """``(id, cluster_id)``: k-means centres of all rows, every row assigned in the scan."""
    model = cluster_centres(features, k, seed, max_iter, share)
    return model.transform(as_vector(features.select("id", "features"))).select("id", "cluster_id")


def mini_batches(features: DataFrame, size: int = 1024, count: int = 1000, seed: int = 0) -> DataFrame:
    """``(batch, id, features)``: ``count`` batches of about ``size`` rows each, drawn by hashes of the key.

    An epoch deals every row into one of rows / size batches, so a table smaller than all batches together is
    dealt several times, each time anew, and of a larger one only the rows of the first batches are taken.
    """
    rows = features.select("id", F.col("features").cast("array<double>").alias("features"))
    n = rows.count()
    dealt = max(n // size, 1)
    epochs = -(-count // dealt)
    batch = lambda e: F.lit(e * dealt) + F.floor(hash_uniform(F.col("id"), f"batch/{seed}/{e}") * F.lit(dealt))
    one = rows.select("id", "features", F.explode(F.array(*[batch(e) for e in range(epochs)])).alias("batch"))
    return one.filter(F.col("batch") < count).select(F.col("batch").cast("int").alias("batch"), "id", "features")


def first_centres(features: DataFrame, k: int = 100, seed: int = 0):
    """The features of the k rows with the largest hashed uniforms, best first, as one array."""
    import numpy as np

    drawn = features.select("id", F.col("features").cast("array<double>").alias("features"))
    drawn = drawn.withColumn("_u", hash_uniform(F.col("id"), f"centre/{seed}"))
    best = drawn.orderBy(F.col("_u").desc(), F.col("id").desc()).limit(k)  # k rows, whatever the table
    return np.array([r["features"] for r in best.collect()])


def _batch_sums(centres, batches: DataFrame) -> tuple:
    """(rows of each centre, their feature sums) over all rows of ``batches``, by their nearest centres.

    Each task adds up its rows; one row a centre and task is shuffled, and k rows come back.
    """
    import numpy as np

    def partial(frames):
        import pandas as pd

        half = (centres**2).sum(axis=1) / 2
        n, sums = np.zeros(len(centres)), np.zeros_like(centres)
        for frame in frames:
            if len(frame):
                x = np.stack(frame["features"].to_numpy())
                near = np.argmax(x @ centres.T - half, axis=1)
                n += np.bincount(near, minlength=len(centres))
                np.add.at(sums, near, x)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"centre": at, "n": n[at], "total": list(sums[at])})

    parts = batches.select("features").mapInPandas(partial, "centre int, n double, total array<double>")
    summed = parts.groupBy("centre").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("total"))
    n, sums = np.zeros(len(centres)), np.zeros_like(centres)
    for r in summed.collect():  # k rows
        n[r["centre"]], sums[r["centre"]] = r["n"], r["total"].toArray()
    return n, sums


def mini_batch_centres(
    features: DataFrame, k: int = 100, seed: int = 0, size: int = 1024, count: int = 1000, group: int = 25
):
    """k-means centres fitted on mini-batches: each centre moves to the mean of all rows that it ever took.

    A centre that has taken N rows and takes n more goes n / (N + n) of the way to their mean, so its steps
    shrink as its count grows. ``group`` batches in a row see the same centres and are added up in one job
    (1 is the plain rule, a job for every batch). The batches are dealt in one scan and written by group.
    """
    import numpy as np

    centres = first_centres(features, k, seed)
    if not len(centres):
        return centres
    batches = mini_batches(features, size, count, seed)
    path = scratch_path(features.sparkSession, "mini-batches")
    batches.withColumn("grp", F.floor(F.col("batch") / group).cast("int")).write.partitionBy("grp").parquet(path)
    written = features.sparkSession.read.parquet(path)
    taken = np.zeros(len(centres))
    for g in range(-(-count // group)):
        n, sums = _batch_sums(centres, written.filter(F.col("grp") == g))
        taken += n
        moved = n > 0
        mean = sums[moved] / n[moved, None]
        centres[moved] += (n / np.maximum(taken, 1))[moved, None] * (mean - centres[moved])
    return centres


def assign_centres(features: DataFrame, centres) -> DataFrame:
    """``(id, cluster_id)``: the nearest centre of each row, in the scan (ties: the smaller number)."""

    @F.pandas_udf("int")
    def nearest(batch: pd.Series) -> pd.Series:
        import numpy as np

        if len(batch) == 0:
            return pd.Series([], dtype="int32")
        x = np.stack(batch.to_numpy()).astype("float64")
        return pd.Series(np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1).astype("int32"))

    return features.select("id", nearest(F.col("features").cast("array<double>")).alias("cluster_id"))


def components(features: DataFrame, share: float = 1.0, seed: int = 0):
    """The fitted two-component projection, on all rows or a hashed ``share`` of them."""
    sample = hashed_sample(as_vector(features.select("id", "features")), "id", share, f"pca/{seed}")
    return PCA(k=2, inputCol="_x", outputCol="_xy").fit(sample)


def project(features: DataFrame, share: float = 1.0, seed: int = 0) -> DataFrame:
    """``(id, x, y)``: two principal components of all rows, applied to all rows."""
    model = components(features, share, seed)
    xy = vector_to_array("_xy")
    rows = as_vector(features.select("id", "features"))
    return model.transform(rows).select("id", xy[0].alias("x"), xy[1].alias("y"))


def hashed_vectors(
    df: DataFrame, text: Column, kind: str = "pair", radius: int = 2, length: int = 2048, **options
) -> DataFrame:
    """Sparse 0/1 ml vectors of the hashed token pieces (Murmur3, in the JVM)."""
    pieces = df.withColumn("_tokens", tokenize(text, **options)).withColumn(
        "_grams", grams(F.col("_tokens"), kind, radius)
    )
    tf = HashingTF(numFeatures=length, binary=True, inputCol="_grams", outputCol="features_vec")
    return tf.transform(pieces).drop("_grams", "_tokens")
