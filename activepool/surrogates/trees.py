"""Tree ensembles from Spark ml; the variance over the trees from the leaf that each tree gives a row."""

from __future__ import annotations

import re

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import let
from ..session import pinned
from .base import Surrogate, register_model, wide_moments


#: Training rows that a part of the table holds at least, once there are as many.
PART_ROWS = 10_000

_TREE = re.compile(r"^ *Tree \d+", re.M)
_LEAF = re.compile(r"Predict: (\S+)")


def leaf_values(model) -> list[list[float]]:
    """The outputs of each tree's leaves, in the order in which the model numbers them (left to right).

    Read off the model's own description, one string: trees x leaves numbers, set by the model options.
    """
    text = model.toDebugString
    starts = [m.start() for m in _TREE.finditer(text)]
    return [[float(v) for v in _LEAF.findall(text[a:b])] for a, b in zip(starts, [*starts[1:], len(text)])]


def leaf_moments(leaves: Column, values: list[list[float]], weights) -> tuple[Column, Column]:
    """Mean and population variance over the trees' outputs, from the leaf of each tree (an array column).

    All outputs are one constant array, given as one string that the planner turns into an array once, so no
    row leaves the JVM and the plan stays short.
    """
    constant = lambda numbers, kind: F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")
    starts = [0]
    for tree in values[:-1]:
        starts.append(starts[-1] + len(tree))
    flat, first = constant([float(w * v) for w, tree in zip(weights, values) for v in tree], "double"), constant(starts, "int")
    out = F.transform(leaves, lambda leaf, t: F.get(flat, F.get(first, t) + leaf.cast("int")))
    return let(out, lambda x: wide_moments(x)[0]), let(out, lambda x: wide_moments(x)[1])


class _TreeSurrogate(Surrogate):
    model = None

    def save(self, path: str) -> str:
        self.model.write().overwrite().save(path)
        return path

    def _fit(self, rows: DataFrame, estimator):
        data = rows.select(
            array_to_vector(F.col("features").cast("array<double>")).alias("x"),
            F.col("score").cast("double").alias("y"),
        )
        # Read several times by the fit. Every part of the table sends its own counts of all open nodes, which
        # outweigh its rows if these are few, so parts have a least size.
        data = pinned(data, "training")
        self.model = estimator.fit(data.coalesce(max(data.count() // PART_ROWS, 1)))
        return self

    def _means(self, pool: DataFrame) -> DataFrame:
        vector = array_to_vector(F.col("features").cast("array<double>"))
        return self.model.transform(pool.select("id", vector.alias("x"))).select(
            "id", F.col("prediction").alias("mu")
        )

    def _both(self, pool: DataFrame, weights) -> DataFrame:
        vector = array_to_vector(F.col("features").cast("array<double>"))
        leaves = self.model.copy().setLeafCol("leaves").transform(pool.select("id", vector.alias("x")))
        found = leaves.select("id", vector_to_array("leaves").alias("leaves"))
        mean, var = leaf_moments(F.col("leaves"), leaf_values(self.model), weights)
        return found.select("id", mean.alias("_mean"), var.alias("var"))


@register_model("rf")
class ForestSurrogate(_TreeSurrogate):
    """Random forest; mean and population variance over the trees."""

    def __init__(self, n_estimators=100, max_depth=8, min_samples_leaf=1, seed=0, **_):
        self.options = dict(
            numTrees=n_estimators, maxDepth=max_depth, minInstancesPerNode=min_samples_leaf, seed=seed
        )

    def fit(self, rows: DataFrame) -> "ForestSurrogate":
        return self._fit(
            rows,
            RandomForestRegressor(
                featuresCol="x",
                labelCol="y",
                featureSubsetStrategy="all",
                maxMemoryInMB=1024,
                **self.options,
            ),
        )

    def predict(self, pool: DataFrame, need_var: bool = True) -> DataFrame:
        if not need_var:
            return self._means(pool)
        both = self._both(pool, [1.0] * self.model.getNumTrees)
        return both.select("id", F.col("_mean").alias("mu"), "var")

    def load(self, spark, path: str) -> "ForestSurrogate":
        self.model = RandomForestRegressionModel.load(path)
        return self


@register_model("gbt")
class BoostedTreesSurrogate(_TreeSurrogate):
    """Boosted trees; the mean is the model's output, the variance that of the trees' outputs."""

    def __init__(self, n_estimators=100, max_depth=5, seed=0, **_):
        self.options = dict(maxIter=n_estimators, maxDepth=max_depth, seed=seed)

    def fit(self, rows: DataFrame) -> "BoostedTreesSurrogate":
        return self._fit(rows, GBTRegressor(featuresCol="x", labelCol="y", **self.options))

    def predict(self, pool: DataFrame, need_var: bool = True) -> DataFrame:
        if not need_var:
            return self._means(pool)
        weights = self.model.treeWeights
        both = self._both(pool, weights)
        return both.select("id", (F.col("_mean") * F.lit(float(len(weights)))).alias("mu"), "var")

    def load(self, spark, path: str) -> "BoostedTreesSurrogate":
        self.model = GBTRegressionModel.load(path)
        return self
