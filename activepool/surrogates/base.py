"""The model protocol, simple models and the data steps around a fit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import hash_uniform, let

MODELS: dict[str, Callable[..., "Surrogate"]] = {}


def register_model(name: str):
    def add(cls):
        MODELS[name] = cls
        cls.name = name
        return cls

    return add


def build_model(name: str, **options) -> "Surrogate":
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; one of {sorted(MODELS)}")
    return MODELS[name](**options)


class Surrogate:
    """``fit`` takes ``(id, features, score)``; ``predict`` gives ``(id, mu[, var])``.

    ``predict`` stays lazy and adds columns to the pool scan: no join, no shuffle.
    """

    name = "base"
    provides: frozenset = frozenset({"means", "vars"})
    #: Whether ``fit(rows, online=True)`` adds rows to an earlier fit.
    online = False

    def fit(self, rows: DataFrame) -> "Surrogate":
        raise NotImplementedError

    def predict(self, pool: DataFrame, need_var: bool = True) -> DataFrame:
        raise NotImplementedError

    def save(self, path: str) -> str:
        raise NotImplementedError

    def load(self, spark, path: str) -> "Surrogate":
        raise NotImplementedError


@register_model("random")
class RandomSurrogate(Surrogate):
    """Baseline: uniform mean and variance, a function of the key and the seed."""

    def __init__(self, seed=0, **_):
        self.seed = seed

    def fit(self, rows: DataFrame) -> "RandomSurrogate":
        return self

    def predict(self, pool: DataFrame, need_var: bool = True) -> DataFrame:
        columns = [F.col("id"), hash_uniform(F.col("id"), f"mean/{self.seed}").alias("mu")]
        if need_var:
            columns.append(hash_uniform(F.col("id"), f"var/{self.seed}").alias("var"))
        return pool.select(*columns)

    def save(self, path: str) -> str:
        return path

    def load(self, spark, path: str) -> "RandomSurrogate":
        return self


@register_model("batch")
class BatchFunctionSurrogate(Surrogate):
    """A user's model (a network, say): ``fit_fn(rows DataFrame)`` then batched prediction.

    ``make_predict()`` runs once per Python worker and returns ``f(matrix) -> (n, 2)`` array of
    mean and variance. A checkpoint keeps ``make_predict`` as a serialised function in a one-row
    table; a model with files of its own gives ``save_fn(path)`` and ``load_fn(spark, path) ->
    make_predict`` instead. Only load checkpoints that you wrote.
    """

    def __init__(
        self, make_predict, width: int, fit_fn=None, batch_size: int = 4096, save_fn=None, load_fn=None, **_
    ):
        if (save_fn is None) != (load_fn is None):
            raise ValueError("give both save_fn and load_fn, or none")
        self.save_fn, self.load_fn = save_fn, load_fn
        self.make_predict = make_predict
        self.width = width
        self.fit_fn = fit_fn
        self.batch_size = batch_size

    def fit(self, rows: DataFrame) -> "BatchFunctionSurrogate":
        if self.fit_fn is not None:
            self.make_predict = self.fit_fn(rows)
        return self

    def predict(self, pool: DataFrame, need_var: bool = True) -> DataFrame:
        from pyspark.sql.types import ArrayType, DoubleType

        predict = predict_batch_udf(
            self.make_predict,
            return_type=ArrayType(DoubleType()),
            batch_size=self.batch_size,
            input_tensor_shapes=[[self.width]],
        )
        out = pool.select("id", predict("features").alias("_p"))
        columns = [F.col("id"), F.col("_p")[0].alias("mu")]
        if need_var:
            columns.append(F.col("_p")[1].alias("var"))
        return out.select(*columns)

    def save(self, path: str) -> str:
        if self.save_fn is not None:
            self.save_fn(path)
            return path
        spark = SparkSession.getActiveSession()
        row = (bytearray(cloudpickle.dumps(self.make_predict)),)
        spark.createDataFrame([row], "make_predict binary").coalesce(1).write.mode("overwrite").parquet(path)
        return path

    def load(self, spark, path: str) -> "BatchFunctionSurrogate":
        if self.load_fn is not None:
            self.make_predict = self.load_fn(spark, path)
        else:
            self.make_predict = cloudpickle.loads(bytes(spark.read.parquet(path).first()["make_predict"]))
        return self


def training_rows(
    pool: DataFrame, scores: DataFrame, retrain: bool, last_iter: int | None = None
) -> DataFrame:
    """Features and scores of the rows to fit on: all valid rows, or the last round only.

    The scored side is the small one; the pool is scanned once.
    """
    valid = scores.filter(F.col("score").isNotNull())
    if not retrain:
        if last_iter is None:
            last_iter = valid.agg(F.max("iter")).first()[0]
        valid = valid.filter(F.col("iter") == last_iter)
    return pool.select("id", "features").join(valid.select("id", "score"), "id")


def ensemble_moments(members: DataFrame, value: str, by: str = "id") -> DataFrame:
    """Mean and population variance over members in long form: one partial aggregate per task."""
    return members.groupBy(by).agg(F.avg(value).alias("mu"), F.var_pop(value).alias("var"))


def wide_moments(members: Column) -> tuple[Column, Column]:
    """The same over an array column of member predictions, without a shuffle."""
    n = F.size(members).cast("double")
    mean = F.aggregate(members, F.lit(0.0), lambda a, x: a + x) / n
    squares = let(
        mean, lambda m: F.aggregate(members, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    )
    return mean, squares / n


def training_errors(rows: DataFrame, preds: DataFrame) -> DataFrame:
    """One row: MAE and MSE on the training rows."""
    gap = F.col("mu") - F.col("score")
    return rows.select("id", "score").join(preds.select("id", "mu"), "id").agg(
        F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse")
    )
