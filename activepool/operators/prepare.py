"""Target and feature scaling, splits, sampling and dataset audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hash_uniform, nan_to_null
from ..session import one_row
from .ordering import not_after, number_rows, order_boundaries


# --- scaling ---------------------------------------------------------------------------------


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``<c>_mean, <c>_std``: missing values skipped, population std, 0/absent std -> 1.

    One aggregate over all columns; no shuffle beyond one row per task.
    """
    cells = []
    for c in columns:
        value = nan_to_null(F.col(c).cast("double"))
        std = F.stddev_pop(value)
        cells.append(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{c}_mean"))
        cells.append(F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"{c}_std"))
    return df.agg(*cells)


def scale(
    df: DataFrame,
    scaler: DataFrame,
    columns: Sequence[str],
    replace_nan: float | None = None,
    suffix: str = "_scaled",
) -> DataFrame:
    """Adds scaled columns beside the raw ones; a missing value gives ``replace_nan``."""
    fit = one_row(scaler)
    return df.withColumns(
        {
            f"{c}{suffix}": F.coalesce(
                (nan_to_null(F.col(c).cast("double")) - fit[f"{c}_mean"]) / fit[f"{c}_std"],
                F.lit(replace_nan).cast("double"),
            )
            for c in columns
        }
    )


def unscale(
    df: DataFrame,
    scaler: DataFrame,
    columns: Sequence[str],
    suffix: str = "_scaled",
    target: str = "_back",
    replace_nan: float | None = None,
) -> DataFrame:
    fit = one_row(scaler)
    return df.withColumns(
        {
            f"{c}{target}": F.coalesce(
                nan_to_null(F.col(f"{c}{suffix}")) * fit[f"{c}_std"] + fit[f"{c}_mean"],
                F.lit(replace_nan).cast("double"),
            )
            for c in columns
        }
    )


# --- splits and sampling ----------------------------------------------------------------------


def shuffled_position(df: DataFrame, key: str, seed, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``_pos``: position in a seeded shuffle (exact, independent of the partitions)."""
    drawn = df.withColumn("_u", hash_uniform(F.col(key), f"shuffle/{seed}"))
    return number_rows(drawn, [F.col("_u").asc(), F.col(key).asc()], by=by, name="_pos").drop("_u")


def _labelled(df: DataFrame, key: str, seed, ends: Sequence[int], labels: Sequence, n: int) -> Column:
    """Label of a row by its place in the seeded shuffle: ``labels[i]`` up to position ``ends[i]``.

    Only the rows next to the cuts are put in order; labelling is then a comparison in the scan.
    """
    drawn = df.select(key, hash_uniform(F.col(key), f"shuffle/{seed}").alias("_u"))
    cuts = order_boundaries(drawn, "_u", key, [e for e in ends if e > 0], total=n)
    used = [label for e, label in zip(ends, labels) if e > 0]
    column = None
    for cut, label in zip(cuts, used):
        inside = not_after("_u", key, cut)
        column = F.when(inside, label) if column is None else column.when(inside, label)
    rest = F.lit(labels[-1])
    return rest if column is None else column.otherwise(rest)


def _with_label(df: DataFrame, key: str, seed, ends, labels, name: str, n: int) -> DataFrame:
    label = _labelled(df, key, seed, ends, labels, n)
    return (
        df.withColumn("_u", hash_uniform(F.col(key), f"shuffle/{seed}")).withColumn(name, label).drop("_u")
    )


def random_split(
    df: DataFrame, key: str, seed, sizes: Sequence[float] = (0.8, 0.1, 0.1)
) -> DataFrame:
    """Adds ``split``; the split sizes are exact (rounded down), the rest goes to the last split."""
    if len(sizes) != 3 or abs(sum(sizes) - 1.0) > 1e-9:
        raise ValueError("give three sizes that sum to 1")
    n = df.count()
    ends = [int(sizes[0] * n), int((sizes[0] + sizes[1]) * n)]
    return _with_label(df, key, seed, ends, ["train", "val", "test"], "split", n)


def holdout_split(df: DataFrame, key: str, seed, val_ratio: float) -> DataFrame:
    """Train and validation only: floor((1 - ratio) * n) rows train."""
    n = df.count()
    return _with_label(df, key, seed, [int((1.0 - val_ratio) * n)], ["train", "val"], "split", n)


CUT_FOLDS = 64


def kfold_split(df: DataFrame, key: str, seed: int, folds: int) -> DataFrame:
    """Adds ``fold`` and ``split``: test = seed mod k, validation = the next fold.

    Folds are runs of 1 + n div k rows of the shuffle (fixed values of the split that is reproduced);
    the last one takes what is left. Keys are unique.
    """
    n = df.count()
    if folds <= 1 or folds > n:
        raise ValueError("folds must be between 2 and the number of rows")
    size = 1 + n // folds
    split = (
        F.when(F.col("fold") == seed % folds, "test")
        .when(F.col("fold") == (seed + 1) % folds, "val")
        .otherwise("train")
    )
    if folds <= CUT_FOLDS:
        ends = [min(size * (i + 1), n) for i in range(folds - 1)]
        placed = _with_label(df, key, 0, ends, list(range(folds)), "fold", n)
    else:  # too many cuts to compare each row with: the fold follows from the position
        at = shuffled_position(df.select(key), key, 0).select(
            key, F.least(F.floor((F.col("_pos") - 1) / size), F.lit(folds - 1)).cast("int").alias("fold")
        )
        placed = df.join(at.distinct(), key)
    return placed.withColumn("split", split)


def given_split(df: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """Rows joined to a table ``(key, split)``; rows without a split are left out."""
    return df.join(assignment.select(key, "split"), key)


def balanced_sample(df: DataFrame, key: str, active: Column, seed=None) -> DataFrame:
    """Equal numbers of active and inactive rows, interleaved: ``slot`` 1, 2, 3, ...

    Without a seed rows are taken in key order, with a seed in a seeded shuffle.
    """
    rows = df.withColumn("_active", F.coalesce(active, F.lit(False)))
    if seed is None:
        placed = number_rows(rows, [F.col(key).asc()], by=["_active"], name="_pos")
    else:
        placed = shuffled_position(rows, key, seed, by=["_active"])
    counts = rows.agg(
        F.least(F.count_if(F.col("_active")), F.count_if(~F.col("_active"))).alias("n")
    )
    slot = F.col("_pos") * 2 - F.col("_active").cast("bigint")
    return (
        placed.filter(F.col("_pos") <= one_row(counts)["n"])
        .withColumn("slot", slot)
        .withColumnRenamed("_active", "active")
        .drop("_pos")
    )


# --- datasets ---------------------------------------------------------------------------------


def valid_keys(df: DataFrame, keys: str = "inputs", predicate=None) -> DataFrame:
    """Rows whose keys are all non-blank and pass ``predicate`` (a column function)."""
    def ok(k):
        blank_free = F.coalesce(F.length(F.trim(k)) > 0, F.lit(False))
        return blank_free if predicate is None else blank_free & predicate(k)

    return df.filter(F.forall(F.col(keys), ok))


def flat_keys(df: DataFrame, keys: str = "inputs") -> DataFrame:
    return df.select(F.explode(keys).alias("key"))


def dataset_shape(df: DataFrame, keys: str = "inputs", targets: str = "targets") -> DataFrame:
    """One row: rows, keys per row, tasks."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size(keys)).alias("keys_per_row"),
        F.max(F.size(targets)).alias("n_tasks"),
    )


def attach_target(
    df: DataFrame, measures: DataFrame, normalizer, key: str = "key", order: str = "pos"
) -> DataFrame:
    """Normalised key and target per row; a repeated key takes its last target."""
    last = measures.groupBy(key).agg(F.max_by("target", order).alias("target"))
    return df.join(last, key).withColumn("model_input", normalizer(F.col(key)))


def class_shares(df: DataFrame, targets: str = "targets") -> DataFrame:
    """Per task: number of known targets, share of zeros and of ones (NaN without targets)."""
    cells = df.select(F.posexplode(targets).alias("task", "t"))
    ones = F.coalesce(F.avg((F.col("t") != 0).cast("double")), F.lit(float("nan")))
    return cells.groupBy("task").agg(
        F.count("t").alias("n"), (F.lit(1.0) - ones).alias("zeros"), ones.alias("ones")
    )


def target_type(df: DataFrame, targets: str = "targets") -> DataFrame:
    """One row: is every known target 0 or 1 (classification), or not (regression)?"""
    cells = df.select(F.explode(targets).alias("t")).filter(F.col("t").isNotNull())
    binary = F.coalesce(F.bool_and(F.col("t").isin(0.0, 1.0)), F.lit(True))
    return cells.agg(
        binary.alias("is_binary"),
        F.when(binary, "classification").otherwise("regression").alias("dataset_type"),
    )
