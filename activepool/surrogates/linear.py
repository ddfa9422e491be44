"""Gaussian process with a dot-product kernel, in its weight-space form.

With k(x, x') = sigma0^2 + x.x' the process is a Bayesian linear model on (sigma0, x). The data
enter only through the Gram matrix, which is a sum over rows: one distributed aggregate, a solve of
the feature width on the driver, and a per-row prediction. The marginal likelihood of the scores follows
from the same matrix, so noise and bias scale can be fitted without another look at the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from .base import Surrogate, register_model


def gram_rows(rows: DataFrame, sigma0: float) -> DataFrame:
    """``(i, row)``: row i of Z'Z for Z = (sigma0, x, y), summed over all rows of the table.

    Each task reduces its Arrow batches to one small matrix; the matrices are added with partial
    aggregation per i, so the shuffle carries width^2 numbers per task, whatever the row count.
    """

    def partial(frames):
        import numpy as np
        import pandas as pd

        gram = None
        for frame in frames:
            if len(frame) == 0:
                continue
            x = np.stack(frame["features"].to_numpy()).astype("float64")
            y = frame["score"].to_numpy(dtype="float64")
            z = np.column_stack([np.full(len(x), sigma0), x, y])
            gram = z.T @ z if gram is None else gram + z.T @ z
        if gram is not None:
            yield pd.DataFrame({"i": range(len(gram)), "row": list(gram)})

    parts = rows.select("features", F.col("score").cast("double").alias("score")).mapInPandas(
        partial, "i int, row array<double>"
    )
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("_s"))
    return summed.select("i", vector_to_array("_s").alias("row"))


def _rescaled(gram: np.ndarray, factor: float) -> np.ndarray:
    """The Gram matrix with its bias column multiplied."""
    scale = np.ones(len(gram))
    scale[0] = factor
    return gram * scale[:, None] * scale


class Evidence:
    """Log marginal likelihood of normalised scores over noise variance ``alpha`` and bias scale ``sigma0``.

    ``gram`` is Z'Z for Z = (1, x, y). The feature part is taken apart into eigenvalues once; the bias is a
    border of the matrix, whose determinant and inverse follow from its Schur complement. A value then costs
    the feature width, whatever the number of rows.
    """

    def __init__(self, gram: np.ndarray):
        self.n = gram[0, 0]
        mean = gram[0, -1] / self.n
        spread = max(gram[-1, -1] / self.n - mean**2, 0.0) ** 0.5
        spread = spread if spread > 0 else 1.0
        self.values, vectors = np.linalg.eigh(gram[1:-1, 1:-1])
        self.values = np.maximum(self.values, 0.0)
        self.sums = vectors.T @ gram[0, 1:-1]
        self.target = vectors.T @ (gram[1:-1, -1] - mean * gram[0, 1:-1]) / spread
        self.square = max(gram[-1, -1] - self.n * mean**2, 0.0) / spread**2

    def __call__(self, alpha, sigma0):
        """Values at every pair of ``alpha`` and ``sigma0`` (arrays of one shape)."""
        alpha, bias = np.asarray(alpha, float), np.asarray(sigma0, float) ** 2
        ridge = self.values + alpha[..., None]
        corner = bias * self.n + alpha - bias * (self.sums**2 / ridge).sum(axis=-1)
        explained = (self.target**2 / ridge).sum(axis=-1)
        explained = explained + bias * (self.sums * self.target / ridge).sum(axis=-1) ** 2 / corner
        logdet = (self.n - len(self.values) - 1) * np.log(alpha) + np.log(ridge).sum(axis=-1) + np.log(corner)
        return -0.5 * ((self.square - explained) / alpha + logdet + self.n * np.log(2 * np.pi))

    def best(self, low: float = 1e-5, high: float = 1e5, points: int = 25, zooms: int = 30) -> tuple[float, float]:
        """The pair with the largest value between the bounds: a grid of logarithms that closes in."""
        centre = np.full(2, (np.log(low) + np.log(high)) / 2)
        reach = (np.log(high) - np.log(low)) / 2
        for _ in range(zooms):
            axes = [np.clip(c + np.linspace(-reach, reach, points), np.log(low), np.log(high)) for c in centre]
            value = np.stack([self(np.full(points, np.exp(a)), np.exp(axes[1])) for a in axes[0]])
            i, j = np.unravel_index(np.argmax(value), value.shape)
            centre, reach = np.array([axes[0][i], axes[1][j]]), reach / 2
        return float(np.exp(centre[0])), float(np.exp(centre[1]))


@register_model("gp")
class LinearGaussianSurrogate(Surrogate):
    """``alpha`` is the noise variance in units of normalised targets, ``sigma0`` the bias scale.

    With ``tune`` both are fitted to the rows by the largest marginal likelihood, after every fit and online
    step; the given values then count for nothing.
    """

    online = True

    def __init__(self, alpha: float = 1e-2, sigma0: float = 1.0, tune: bool = False, **_):
        if alpha <= 0 or sigma0 <= 0:
            raise ValueError("alpha and sigma0 must be greater than 0")
        self.alpha, self.sigma0, self.tune = float(alpha), float(sigma0), tune
        self.gram = None
        self.n = 0

    def fit(self, rows: DataFrame, online: bool = False) -> "LinearGaussianSurrogate":
        """With ``online`` the new rows' Gram matrix is added to the earlier ones (exact)."""
        parts = gram_rows(rows, self.sigma0).toPandas().sort_values("i")
        if len(parts) == 0:
            raise ValueError("no rows to fit on")
        gram = np.stack(parts["row"].to_numpy())
        # The bias column counts the rows, so the table is not read again.
        n = round(gram[0, 0] / self.sigma0**2)
        if online and self.gram is not None:
            gram, n = gram + self.gram, n + self.n
        self.gram, self.n = gram, n
        if self.tune:
            self._tune()
        return self._solve()

    def evidence(self) -> Evidence:
        """The marginal likelihood of the fitted rows."""
        return Evidence(_rescaled(self.gram, 1 / self.sigma0))

    def _tune(self) -> None:
        self.alpha, sigma0 = self.evidence().best()
        # The kept matrix has the bias scale in its first row and column.
        self.gram, self.sigma0 = _rescaled(self.gram, sigma0 / self.sigma0), sigma0

    def _solve(self) -> "LinearGaussianSurrogate":
        a, b = self.gram[:-1, :-1], self.gram[:-1, -1]
        sums = self.gram[0, :] / self.sigma0
        self.mean = sums[-1] / self.n
        spread = max(self.gram[-1, -1] / self.n - self.mean**2, 0.0) ** 0.5
        self.std = spread if spread > 0 else 1.0
        target = (b - self.mean * sums[:-1]) / self.std
        precision = a / self.alpha + np.eye(len(a))
        self.cov = np.linalg.inv(precision)
        self.weights = self.cov @ target / self.alpha
        return self

    def predict(self, pool: DataFrame, need_var: bool = True) -> DataFrame:
        weights, mean, std, sigma0 = self.weights, self.mean, self.std, self.sigma0
        half = np.linalg.cholesky(self.cov) if need_var else None

        @F.pandas_udf("mu double, var double")
        def moments(batch: pd.Series) -> pd.DataFrame:
            import numpy as np

            if len(batch) == 0:
                return pd.DataFrame({"mu": [], "var": []})
            x = np.stack(batch.to_numpy()).astype("float64")
            z = np.column_stack([np.full(len(x), sigma0), x])
            var = ((z @ half) ** 2).sum(axis=1) * std**2 if half is not None else np.nan
            return pd.DataFrame({"mu": z @ weights * std + mean, "var": var})

        out = pool.select("id", moments("features").alias("_m"))
        columns = [F.col("id"), F.col("_m.mu").alias("mu")]
        if need_var:
            columns.append(F.col("_m.var").alias("var"))
        return out.select(*columns)

    def save(self, path: str) -> str:
        from pyspark.sql import SparkSession

        # One row of the matrix a table row; every row repeats the few settings.
        settings = (int(self.n), self.alpha, self.sigma0, self.tune)
        rows = [(i, [float(v) for v in row], *settings) for i, row in enumerate(self.gram)]
        schema = "i int, row array<double>, n bigint, alpha double, sigma0 double, tune boolean"
        SparkSession.getActiveSession().createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
        return path

    def load(self, spark, path: str) -> "LinearGaussianSurrogate":
        rows = spark.read.parquet(path).orderBy("i").collect()  # as wide as the features
        self.gram, self.n = np.array([r["row"] for r in rows]), rows[0]["n"]
        self.alpha, self.sigma0, self.tune = rows[0]["alpha"], rows[0]["sigma0"], rows[0]["tune"]
        return self._solve()
