"""Acquisition utilities as column expressions, and batch selection."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import boltzmann_decay, hash_normal, hash_uniform, normal_cdf, normal_pdf, temperature
from ..session import one_row, pinned
from .ordering import loose_cut, top_n, top_quota


@dataclass(frozen=True)
class UtilityArgs:
    """Inputs of a utility beside the prediction: all are constants or one-row columns."""

    key: Column = field(default_factory=lambda: F.col("id"))
    best: Column = field(default_factory=lambda: F.lit(float("-inf")))
    spread: Column | None = None
    threshold: float = float("-inf")
    beta: float = 2.0
    xi: float = 0.01
    stochastic: bool = False
    salt: str = "0"


def _uniform(mu: Column, var: Column, a: UtilityArgs) -> Column:
    return hash_uniform(a.key, f"random/{a.salt}")


def _threshold(mu: Column, var: Column, a: UtilityArgs) -> Column:
    return F.when(mu >= a.threshold, hash_uniform(a.key, f"threshold/{a.salt}")).otherwise(F.lit(-1.0))


def _greedy(mu: Column, var: Column, a: UtilityArgs) -> Column:
    return mu


def _noisy(mu: Column, var: Column, a: UtilityArgs) -> Column:
    return mu + a.spread * hash_normal(a.key, f"noisy/{a.salt}")


def _ucb(mu: Column, var: Column, a: UtilityArgs) -> Column:
    return mu + F.lit(float(a.beta)) * F.sqrt(var)


def _lcb(mu: Column, var: Column, a: UtilityArgs) -> Column:
    return mu - F.lit(float(a.beta)) * F.sqrt(var)


def _thompson(mu: Column, var: Column, a: UtilityArgs) -> Column:
    if a.stochastic:
        return mu
    return mu + F.sqrt(var) * hash_normal(a.key, f"thompson/{a.salt}")


def _expected_improvement(mu: Column, var: Column, a: UtilityArgs) -> Column:
    gain, z = F.col("_gain"), F.col("_z")
    return F.when(var == 0, gain).otherwise(gain * normal_cdf(z) + F.sqrt(var) * normal_pdf(z))


def _probability_of_improvement(mu: Column, var: Column, a: UtilityArgs) -> Column:
    sure = F.when(F.col("_gain") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(var == 0, sure).otherwise(normal_cdf(F.col("_z")))


def _with_gain(preds: DataFrame, a: UtilityArgs) -> DataFrame:
    """The improvement and its z value as columns: the utility reads them many times."""
    gain = F.col("mu") - a.best + F.lit(float(a.xi))
    z = F.col("_gain") / F.nullif(F.sqrt("var"), F.lit(0.0))
    return preds.withColumn("_gain", gain).withColumn("_z", z)


@dataclass(frozen=True)
class Metric:
    build: Callable[[Column, Column, UtilityArgs], Column]
    needs: frozenset
    prepare: Callable[[DataFrame, UtilityArgs], DataFrame] = lambda df, args: df


_MEANS, _BOTH = frozenset({"means"}), frozenset({"means", "vars"})

METRICS: dict[str, Metric] = {
    "random": Metric(_uniform, frozenset()),
    "threshold": Metric(_threshold, _MEANS),
    "greedy": Metric(_greedy, _MEANS),
    "noisy": Metric(_noisy, _MEANS),
    "ucb": Metric(_ucb, _BOTH),
    "lcb": Metric(_lcb, _BOTH),
    "thompson": Metric(_thompson, _BOTH),
    "ts": Metric(_thompson, _BOTH),
    "ei": Metric(_expected_improvement, _BOTH, _with_gain),
    "pi": Metric(_probability_of_improvement, _BOTH, _with_gain),
}


def register_metric(name: str, build, needs=("means",)) -> None:
    """Add a utility: ``build(mu, var, args) -> Column``."""
    METRICS[name] = Metric(build, frozenset(needs))


def metric_needs(name: str) -> frozenset:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {sorted(METRICS)}")
    return METRICS[name].needs


def check_model(name: str, provides) -> None:
    """Fails before any job runs when the model cannot feed the metric."""
    missing = metric_needs(name) - set(provides)
    if missing:
        raise ValueError(f"metric {name!r} needs {sorted(missing)}, which the model does not provide")


def mean_spread(preds: DataFrame, mu: str = "mu") -> DataFrame:
    """One row: population standard deviation of all predicted means."""
    return preds.agg(F.stddev_pop(mu).alias("spread"))


def with_utility(preds: DataFrame, metric: str, args: UtilityArgs, name: str = "utility") -> DataFrame:
    """Adds the utility. ``preds`` has the key, ``mu`` and, if the metric needs it, ``var``.

    A one-row value (best, spread) enters as a scalar subquery: no join, no shuffle of the pool.
    """
    metric_needs(metric)
    if metric == "noisy" and args.spread is None:
        args = UtilityArgs(**{**args.__dict__, "spread": one_row(mean_spread(preds))["spread"]})
    chosen = METRICS[metric]
    var = F.col("var") if "var" in preds.columns else F.lit(None).cast("double")
    rated = chosen.prepare(preds, args).withColumn(name, chosen.build(F.col("mu"), var, args))
    return rated.select(*[c for c in preds.columns if c != name], name)


def unexplored(pool: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """Pool rows that have no score row. AQE broadcasts the scored keys while they are small."""
    return pool.join(scores.select(key), key, "left_anti")


def initial_batch(pool: DataFrame, n: int, seed, key: str = "id") -> DataFrame:
    """n uniformly drawn rows: the largest hashed uniforms."""
    drawn = pool.withColumn("_u", hash_uniform(F.col(key), f"init/{seed}"))
    return top_n(drawn, n, "_u", key).drop("_u")


def cluster_sizes(pool: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return pool.groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size"))


def cluster_quotas(pool: DataFrame, n: int, cluster: str = "cluster_id") -> DataFrame:
    """Each cluster's share of n, rounded up (so the sum may pass n)."""
    sizes = cluster_sizes(pool, cluster)
    total = one_row(sizes.agg(F.sum("cluster_size").alias("total")))["total"]
    return sizes.withColumn("quota", F.ceil(F.lit(n) * F.col("cluster_size") / total))


def initial_cluster_batch(
    pool: DataFrame, n: int, seed, key: str = "id", cluster: str = "cluster_id"
) -> DataFrame:
    """Quota sample: from each cluster its share of n, uniformly drawn."""
    drawn = pool.withColumn("_u", hash_uniform(F.col(key), f"init/{seed}"))
    return top_quota(drawn, cluster_quotas(pool, n, cluster), cluster, "_u", key).drop("_u")


def random_share(candidates: DataFrame, batch: int, epsilon: float, salt: str, key: str = "id"):
    """ceil(batch * epsilon) uniformly drawn candidates."""
    if not 0.0 <= epsilon <= 1.0:
        raise ValueError(f"epsilon must be in [0, 1]: {epsilon}")
    drawn = candidates.select(key, hash_uniform(F.col(key), f"epsilon/{salt}").alias("_u"))
    return top_n(drawn, math.ceil(batch * epsilon), "_u", key).drop("_u")


def _worth_reading(
    rated: DataFrame, scores: DataFrame, batch: int, epsilon: float, salt: str, key: str, prefilter_from: int
) -> DataFrame:
    """Rows that can be in the batch, by proven cuts of the utility and of the epsilon draw.

    Of the best (batch + scored) rows at least ``batch`` are unexplored, whatever was scored, so rows
    below them cannot be taken; the same holds for the draw. Nothing is cut while few rows are scored.
    """
    if not prefilter_from:
        return rated
    n_scored = scores.count()
    if n_scored < prefilter_from:
        return rated
    cut = loose_cut(rated, "utility", batch + n_scored)
    if cut is None:
        return rated
    keep = F.col("utility") >= F.lit(cut)
    if epsilon > 0.0:
        drawn = hash_uniform(F.col(key), f"epsilon/{salt}")
        edge = loose_cut(rated.select(drawn.alias("_u")), "_u", math.ceil(batch * epsilon) + n_scored)
        if edge is None:
            return rated
        keep = keep | (drawn >= F.lit(edge))
    return rated.filter(keep)


def _lifted(open_rows: DataFrame, batch: int, epsilon: float, salt: str, key: str) -> DataFrame:
    """The drawn share of the batch gets the utility +inf."""
    if epsilon == 0.0:
        return open_rows
    forced = random_share(open_rows, batch, epsilon, salt, key).withColumn("_forced", F.lit(True))
    lifted = F.when(F.col("_forced"), F.lit(float("inf"))).otherwise(F.col("utility"))
    return open_rows.join(forced, key, "left").withColumn("utility", lifted).drop("_forced")


def acquire_batch(
    preds: DataFrame,
    scores: DataFrame,
    batch: int,
    metric: str = "greedy",
    args: UtilityArgs | None = None,
    epsilon: float = 0.0,
    key: str = "id",
    prefilter_from: int = 0,
) -> DataFrame:
    """The next batch, best first, with its utility: best unexplored rows, ties to the larger key.

    A share ``epsilon`` of the batch is drawn uniformly from the unexplored rows (utility +inf).
    With ``prefilter_from`` > 0 and at least that many scored rows, rows that cannot be in the batch
    are dropped by proven cuts before the anti join, so the pool itself is not shuffled.
    """
    args = args or UtilityArgs()
    ranked = with_utility(preds, metric, args).select(key, "utility")
    ranked = _worth_reading(ranked, scores, batch, epsilon, args.salt, key, prefilter_from)
    open_rows = unexplored(ranked, scores, key)
    if epsilon > 0.0:  # read by the draw and by the cut
        open_rows = pinned(open_rows, "open")
    return top_n(_lifted(open_rows, batch, epsilon, args.salt, key), batch, "utility", key)


def acquire_cluster_batch(
    preds: DataFrame,
    scores: DataFrame,
    batch: int,
    t: int,
    temp_start: float,
    temp_end: float,
    key: str = "id",
    cluster: str = "cluster_id",
    epsilon: float = 0.0,
    salt: str = "0",
    prefilter: bool | None = None,
) -> DataFrame:
    """Clustered batch: ``preds`` has key, cluster, mu and utility.

    Each cluster's quota is shrunk by a decay in the gap between the best predicted mean of the
    whole pool and the best unexplored utility of the cluster. A share ``epsilon`` of the batch is
    drawn uniformly from all unexplored rows; drawn rows come first within their cluster's quota. The
    rated rows are read several times, so their narrow columns are written first, with the mark of
    what was scored. ``prefilter`` cuts each cluster at a proven utility before rows are put in order.
    """
    marked = preds.select(key, cluster, "mu", "utility").join(
        scores.select(key).distinct().withColumn("_scored", F.lit(True)), key, "left"
    )
    marked = pinned(marked, "rated")
    open_rows = marked.filter(F.col("_scored").isNull()).drop("_scored")
    # Size, best open utility and best mean of each cluster in one pass.
    sizes = pinned(
        marked.groupBy(cluster).agg(
            F.count(F.lit(1)).alias("cluster_size"),
            F.max(F.when(F.col("_scored").isNull(), F.col("utility"))).alias("_local"),
            F.count_if(F.col("_scored").isNull()).alias("_open"),
            F.max("mu").alias("_mu"),
        ),
        "clusters",
    )
    whole = one_row(sizes.agg(F.sum("cluster_size").alias("total"), F.max("_mu").alias("top")))
    lam = boltzmann_decay(whole["top"], F.col("_local"), temperature(F.lit(float(t)), temp_start, temp_end))
    share = F.ceil(F.lit(batch) * F.col("cluster_size") / whole["total"])
    quotas = sizes.filter(F.col("_open") > 0).select(
        cluster, F.ceil(F.least(lam, F.lit(1.0)) * share).alias("quota")
    )
    rows = _lifted(open_rows, batch, epsilon, salt, key)
    return top_quota(rows, quotas, cluster, "utility", key, prefilter=prefilter)


def retrieval_rate(explored_top: DataFrame, true_top: DataFrame, k: int, key: str = "id") -> DataFrame:
    """One row: share of the true top k among the explored top; a short list shrinks the divisor."""
    n = F.count(F.lit(1))
    flagged = explored_top.select(key).join(
        true_top.select(key, F.lit(1).alias("_hit")), key, "left"
    )
    return flagged.agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.nullif(F.least(n, F.lit(k)), F.lit(0))).alias("rate"))
