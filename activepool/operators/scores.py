"""The scores table ``(id, score NULL = failed, ...)``: upserts, rankings, averages, progress."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import rank_score
from .ordering import number_rows, top_n


def resolve_size(spec, total: int, rounding: str = "floor") -> int:
    """A count, or a fraction of ``total``: batches round up, k and budgets round down."""
    if isinstance(spec, bool) or not isinstance(spec, (int, float)):
        raise TypeError(f"size must be a number: {spec!r}")
    if isinstance(spec, float):
        if not 0.0 <= spec <= 1.0:
            raise ValueError(f"a fraction must be in [0, 1]: {spec}")
        spec = math.ceil(total * spec) if rounding == "ceil" else int(total * spec)
    if spec < 0:
        raise ValueError(f"size must not be negative: {spec}")
    return spec


def scheduled_size(sizes, t: int) -> int:
    """Size of batch ``t``; the last entry repeats."""
    sizes = list(sizes)
    return sizes[t] if t < len(sizes) else sizes[-1]


def last_per_key(df: DataFrame, key: str, order) -> DataFrame:
    """One row per key, the last in ``order`` (unique per key).

    One ``max_by`` per column: over numbers it stays a hash aggregate with partial results, so a hot
    key costs one row per task.
    """
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in df.columns if c != key])


def first_per_key(df: DataFrame, key: str, order) -> DataFrame:
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in df.columns if c != key])


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key. One shuffle, no join."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return last_per_key(both, key, "_age").drop("_age")


def top_explored(scores: DataFrame, n: int, key: str = "id", score: str = "score") -> DataFrame:
    """Best n scored rows, failures last."""
    return top_n(scores, n, score, key)


def top_average(scores: DataFrame, k: int, key: str = "id", score: str = "score") -> DataFrame:
    """One row: the mean of the best k rows, a failure counting as 0; NULL for an empty table."""
    best = top_n(scores.select(key, score), k, score, key)
    value = F.sum(F.coalesce(F.col(score), F.lit(0.0))) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return best.agg(value.alias("top_avg"))


def batch_average(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row: mean of the rows that did not fail, NULL if none."""
    return scores.agg(F.avg(score).alias("batch_avg"))


def kth_best(scores: DataFrame, k: int, key: str = "id", score: str = "score") -> DataFrame:
    """One row: the k-th best value, a failure counting as -inf; the best if fewer than k rows."""
    ranked = scores.select(F.col(key), rank_score(F.col(score)).alias("_v"))
    best = top_n(ranked, k, "_v", key)
    kth = F.when(F.count(F.lit(1)) >= k, F.min("_v")).otherwise(F.max("_v"))
    return best.agg(kth.alias("kth_best"))


def best_rows(scores: DataFrame, k: int, key: str = "id", score: str = "score") -> DataFrame:
    """``(key, score)`` of the best k rows, failures last: the state from which progress can go on."""
    ranked = scores.select(F.col(key), F.col(score).alias("score"), rank_score(F.col(score)).alias("_v"))
    return top_n(ranked, k, "_v", key).drop("_v")


def merge_best(best: DataFrame, rows: DataFrame, k: int, key: str = "id", score: str = "score") -> DataFrame:
    """The best k rows after ``rows`` (of new keys) joined those that ``best`` was kept for.

    Reads k and the new rows, whatever was scored before: a row outside the best k stays outside.
    """
    return best_rows(best.select(key, "score").unionByName(rows.select(key, F.col(score).alias("score"))), k, key)


def progress_columns(k: int) -> list:
    """Aggregates ``top_avg``, ``kth_best`` and ``n`` over rows kept by ``best_rows``."""
    n = F.count(F.lit(1))
    value = rank_score(F.col("score"))
    return [
        (F.sum(F.coalesce(F.col("score"), F.lit(0.0))) / F.nullif(n, F.lit(0))).alias("top_avg"),
        F.when(n >= k, F.min(value)).otherwise(F.max(value)).alias("kth_best"),
        n.alias("n"),
    ]


def progress_of(best: DataFrame, k: int) -> DataFrame:
    """One row: ``top_avg``, ``kth_best`` and ``n`` of the rows kept by ``best_rows``."""
    return best.agg(*progress_columns(k))


def progress(scores: DataFrame, k: int, key: str = "id", score: str = "score") -> DataFrame:
    """One row: ``top_avg`` and ``kth_best`` (see there) and ``n``, from one pass over the scores."""
    return progress_of(best_rows(scores, k, key, score), k)


def final_scores(scores: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """Best first, failures last, as a globally sorted table."""
    return scores.orderBy(F.col(score).desc_nulls_last(), F.col(key).desc())


def acquisition_order(log: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``pos``: order of acquisition by round, then utility (best first), then key."""
    order = [F.col("iter").asc(), F.col("utility").desc_nulls_last(), F.col(key).desc()]
    return number_rows(log, order, name="pos")


def round_sizes(rows: DataFrame, by: str = "run_id") -> DataFrame:
    """Per run and round: rows acquired, rows acquired so far, size of the first batch."""
    counts = rows.groupBy(by, "iter").agg(F.count(F.lit(1)).alias("n_new"))
    so_far = W.partitionBy(by).orderBy("iter").rowsBetween(W.unboundedPreceding, 0)
    return counts.select(
        by,
        "iter",
        "n_new",
        F.sum("n_new").over(so_far).alias("n_acquired"),
        F.first("n_new").over(so_far).alias("init_size"),
    )


def convergence(run_log: DataFrame, window: int, delta: float, by: str | None = None) -> DataFrame:
    """Moving average of the last ``window`` top-k averages and the signed relative gain.

    ``run_log`` has one row per round. NULL until ``window`` rounds have an average.
    """
    w = W.partitionBy(*([by] if by else [])).orderBy("iter").rowsBetween(-(window - 1), 0)
    full = F.count("top_avg").over(w) >= window
    sma = F.when(full, F.avg("top_avg").over(w))
    return run_log.withColumn("sma", sma).withColumn(
        "converged", (F.col("top_avg") - F.col("sma")) / F.col("sma") <= F.lit(float(delta))
    )


def stop_rule(
    run_log: DataFrame, max_iters: int, budget: int, window: int, delta: float, by: str | None = None
) -> DataFrame:
    """Adds ``stop``: rounds used up, budget spent, pool empty, or converged."""
    checked = convergence(run_log, window, delta, by)
    spent = F.col("n_acquired") - F.col("n_prior") >= budget
    stop = (
        (F.col("iter") > max_iters)
        | spent
        | F.col("exhausted")
        | F.coalesce(F.col("converged"), F.lit(False))
    )
    return checked.withColumn("stop", stop)


def stops(run_log: list[dict], max_iters: int, budget: int, window: int, delta: float) -> bool:
    """The stop rule for the last of a run's rounds, as the driver holds them (one small row a round)."""
    if not run_log:
        return False
    last = run_log[-1]
    if last["iter"] > max_iters or last["n_acquired"] - last["n_prior"] >= budget or last["exhausted"]:
        return True
    tops = [r["top_avg"] for r in run_log[-window:]]
    if len(tops) < window or any(t is None for t in tops):
        return False
    mean = sum(tops) / window
    return mean != 0 and (last["top_avg"] - mean) / mean <= delta


def warm_start(scores: DataFrame, prior: DataFrame, key: str = "id") -> DataFrame:
    """Earlier results join the scores; they are flagged so that they are not charged."""
    current = scores.select(key, "score", F.lit(False).alias("is_prior"))
    return upsert(current, prior.select(key, "score", F.lit(True).alias("is_prior")), key)


def final_averages(scores: DataFrame, pool_size: int, fractions=(0.0001, 0.0005, 0.001, 0.005)):
    """Top-k averages at fixed fractions of the pool; NULL where the fraction rounds to no row.

    One top-k over the largest k, then conditional sums.
    """
    ks = [int(f * pool_size) for f in fractions]
    best = top_explored(scores.select("id", "score"), max(max(ks), 1))
    ranked = number_rows(best, [F.col("score").desc_nulls_last(), F.col("id").desc()], name="_r")
    filled = F.coalesce(F.col("score"), F.lit(0.0))
    cells = []
    for f, k in zip(fractions, ks):
        inside = F.col("_r") <= k
        mean = F.sum(F.when(inside, filled)) / F.nullif(
            F.count(F.when(inside, F.lit(1))).cast("double"), F.lit(0.0)
        )
        cells.append(F.struct(F.lit(float(f)).alias("fraction"), F.lit(k).alias("k"), mean.alias("top_avg")))
    return ranked.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def status_line(run_log_row: dict, max_iters: int, k: int, budget: int) -> str:
    """Text line for one row of the run log."""
    avg = run_log_row.get("top_avg")
    shown = "N/A" if avg is None else f"{avg:.3f}"
    return (
        f"round {run_log_row['iter']}/{max_iters} | top-{k} average {shown} | "
        f"scored {run_log_row['n_acquired'] - run_log_row['n_prior']}/{budget}"
    )


def multiset_missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``wanted`` left after taking out ``found`` with multiplicity."""
    return wanted.exceptAll(found)
