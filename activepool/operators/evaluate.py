"""Model metrics (per task, missing targets skipped) and rewards of finished runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import safe_softplus
from ..session import one_row
from .ordering import number_rows, running_totals, top_per_group

LOG_2PI = 1.8378770664093453


# --- aggregate builders: (target, prediction) -> aggregate Column --------------------------------


def _mse(t: Column, p: Column) -> Column:
    return F.avg((p - t) * (p - t))


def _rmse(t: Column, p: Column) -> Column:
    return F.sqrt(_mse(t, p))


def _mae(t: Column, p: Column) -> Column:
    return F.avg(F.abs(p - t))


def _r2(t: Column, p: Column) -> Column:
    sst = F.var_pop(t) * F.count(t)
    return F.lit(1.0) - F.sum((p - t) * (p - t)) / F.nullif(sst, F.lit(0.0))


def _accuracy(t: Column, p: Column) -> Column:
    return F.avg((t == (p > 0.5).cast("double")).cast("double"))


def _binary_cross_entropy(t: Column, p: Column) -> Column:
    # Fixed value: the logarithms are clamped at -100.
    ln_p = F.greatest(F.coalesce(F.log(p), F.lit(-100.0)), F.lit(-100.0))
    ln_q = F.greatest(F.coalesce(F.log(F.lit(1.0) - p), F.lit(-100.0)), F.lit(-100.0))
    return -F.avg(t * ln_p + (F.lit(1.0) - t) * ln_q)


AGGREGATE_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "rmse": _rmse,
    "mse": _mse,
    "mae": _mae,
    "r2": _r2,
    "accuracy": _accuracy,
    "binary_cross_entropy": _binary_cross_entropy,
}


def register_model_metric(name: str, build: Callable[[Column, Column], Column]) -> None:
    AGGREGATE_METRICS[name] = build


def _known(df: DataFrame, target: str, pred: str) -> DataFrame:
    t = F.col(target).cast("double")
    return df.filter(t.isNotNull() & ~F.isnan(t) & F.col(pred).isNotNull())


def model_metrics(
    df: DataFrame, names: Sequence[str], target: str = "target", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """All the named aggregate metrics in one pass; ``auc`` and ``prc-auc`` are ``ranking_metrics``."""
    unknown = [n for n in names if n not in AGGREGATE_METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; one of {sorted(AGGREGATE_METRICS)}")
    t, p = F.col(target).cast("double"), F.col(pred).cast("double")
    return (
        _known(df, target, pred)
        .groupBy(*by)
        .agg(*[AGGREGATE_METRICS[n](t, p).alias(n) for n in names])
    )


def multiclass_accuracy(df: DataFrame, target: str, probabilities: str) -> DataFrame:
    """The first largest probability wins."""
    p = F.col(probabilities)
    hard = F.array_position(p, F.array_max(p)) - 1
    return df.agg(F.avg((hard == F.col(target)).cast("double")).alias("accuracy"))


def cross_entropy(df: DataFrame, target: str, probabilities: str) -> DataFrame:
    """Mean -ln p(true class); probabilities clipped to the double epsilon and renormalised."""
    p = F.transform(F.col(probabilities), lambda x: F.greatest(x, F.lit(2.220446049250313e-16)))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    own = F.element_at(p, F.col(target).cast("int") + 1) / total
    return df.agg((-F.avg(F.log(own))).alias("cross_entropy"))


def gaussian_losses(df: DataFrame, target: str, mu: str, var: str, raw_var: str) -> DataFrame:
    """One row: mean Gaussian NLL with a variance floor, and the softplus form with constant."""
    t, m = F.col(target), F.col(mu)
    v = F.greatest(F.col(var), F.lit(1e-5))
    s = safe_softplus(F.col(raw_var))
    gap = (m - t) * (m - t)
    return df.agg(
        F.avg((F.log(v) + gap / v) / 2).alias("nll"),
        F.avg(F.lit(LOG_2PI / 2) + F.log(s) / 2 + gap / (s * 2)).alias("mve_loss"),
    )


def ranking_metrics(
    df: DataFrame, target: str = "target", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """Exact ``roc_auc`` and ``prc_auc`` (trapezoids over tie groups), NaN for one-class groups.

    Rows are first reduced to one row per distinct prediction; the running counts over those go
    through range partitions and blocks, so a task never holds a whole group.
    """
    by = list(by)
    known = _known(df, target, pred)
    t = F.col(target).cast("double") == 1
    tied = known.groupBy(*by, F.col(pred).alias("_p")).agg(
        F.count_if(t).alias("_tp"), F.count_if(~t).alias("_fp")
    )
    placed = number_rows(tied, [F.col("_p").desc()], by=by, name="_pos")
    curve = running_totals(placed, "_pos", {"_ctp": F.col("_tp"), "_cfp": F.col("_fp")}, by=by)
    tp0, fp0 = F.col("_ctp") - F.col("_tp"), F.col("_cfp") - F.col("_fp")
    roc_piece = F.col("_fp") * (F.col("_ctp") + tp0) / 2.0
    precision = F.col("_ctp") / (F.col("_ctp") + F.col("_cfp"))
    seen = tp0 + fp0
    precision0 = F.when(seen == 0, F.lit(1.0)).otherwise(tp0 / F.nullif(seen, F.lit(0)))
    prc_piece = F.col("_tp") * (precision + precision0) / 2.0
    p, n = F.sum("_tp"), F.sum("_fp")
    one_class = (p == 0) | (n == 0)
    nan = F.lit(float("nan"))
    return curve.groupBy(*by).agg(
        F.when(one_class, nan)
        .otherwise(F.sum(roc_piece) / F.nullif(p * n, F.lit(0)))
        .alias("roc_auc"),
        F.when(one_class, nan).otherwise(F.sum(prc_piece) / F.nullif(p, F.lit(0))).alias("prc_auc"),
    )


def long_targets(df: DataFrame, targets: str = "targets", preds: str = "preds") -> DataFrame:
    """Parallel arrays to one row per (row, task), missing targets dropped."""
    pairs = F.arrays_zip(F.col(targets).alias("target"), F.col(preds).alias("pred"))
    cells = df.select(F.posexplode(pairs).alias("task", "cell"))
    long = cells.select("task", "cell.target", "cell.pred")
    return long.filter(F.col("target").isNotNull() & ~F.isnan(F.col("target").cast("double")))


# --- rewards of runs: runs(run_id, iter, id, score), true(id, score) -------------------------------


def best_found(runs: DataFrame, iteration: int, n: int) -> DataFrame:
    """The best n rows of each run up to round ``iteration`` (rounds hold their new rows only)."""
    order = [F.col("score").desc_nulls_last(), F.col("id").desc()]
    return top_per_group(runs.filter(F.col("iter") <= iteration), n, order, ["run_id"])


def rewards(runs: DataFrame, true_top: DataFrame, iteration: int, n: int) -> DataFrame:
    """Per run: found/true mean, share of true keys found, share of true scores found (multiset).

    All runs in one job: the true top n is aggregated to distinct values, the found scores to
    counts per (run, value).
    """
    found = best_found(runs, iteration, n)
    mean = found.groupBy("run_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("_found_avg"))
    truth = true_top.agg(F.avg("score").alias("avg"), F.count(F.lit(1)).alias("n"))
    keys = (
        found.select("run_id", "id")
        .distinct()
        .join(true_top.select("id"), "id", "left_semi")
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("_keys"))
    )
    wanted = true_top.groupBy("score").agg(F.count(F.lit(1)).alias("_want"))
    have = found.groupBy("run_id", "score").agg(F.count(F.lit(1)).alias("_have"))
    values = (
        have.join(wanted, "score")
        .groupBy("run_id")
        .agg(F.sum(F.least("_have", "_want")).alias("_values"))
    )
    fact = one_row(truth)
    return (
        mean.join(keys, "run_id", "left")
        .join(values, "run_id", "left")
        .select(
            "run_id",
            (F.col("_found_avg") / fact["avg"]).alias("f_avg"),
            (F.coalesce("_keys", F.lit(0)) / fact["n"]).alias("f_keys"),
            (F.coalesce("_values", F.lit(0)) / fact["n"]).alias("f_scores"),
        )
    )


def class_fractions(runs: DataFrame, classes: DataFrame, iteration: int, n: int) -> DataFrame:
    """Per run and size class: share of the class members among the best n found."""
    sizes = classes.groupBy("size_class").agg(F.count(F.lit(1)).alias("_size"))
    hits = (
        best_found(runs, iteration, n)
        .select("run_id", "id")
        .distinct()
        .join(classes, "id")
        .groupBy("run_id", "size_class")
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    return hits.join(sizes, "size_class").select(
        "run_id", "size_class", (F.col("_hits") / F.col("_size")).alias("fraction")
    )


def boltzmann_average(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """sum(x e^-x) / sum(e^-x)."""
    x = F.col(value)
    weight = F.exp(-x)
    return df.groupBy(*by).agg((F.sum(x * weight) / F.sum(weight)).alias("boltzmann"))


def density_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """2-D histogram between the extremes of both axes; the last bin is closed."""
    ends = one_row(
        df.agg(
            F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
        )
    )

    def cell(c, lo, hi):
        place = F.floor((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(float(bins)))
        return F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")

    return (
        df.select(cell(x, ends["x0"], ends["x1"]).alias("bin_x"), cell(y, ends["y0"], ends["y1"]).alias("bin_y"))
        .groupBy("bin_x", "bin_y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
