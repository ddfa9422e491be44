"""Scalar rules for scores, sizes and encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

# Text that a score column may hold: decimal or exponent notation, inf, nan. Spark's own cast is
# wider (it takes a trailing 'd' or 'f'), so the cast is guarded by this pattern.
FLOAT_PATTERN = (
    r"^[ \t]*[+-]?([0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])[ \t]*$"
)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once per row.

    An expression used inside a per-element function is evaluated again for every element; a bound
    variable is not.
    """
    return F.transform(F.array(value), fn)[0]


def parse_float(text: Column) -> Column:
    """Text to double; anything that is not a number gives NULL instead of an error."""
    return F.when(text.rlike(FLOAT_PATTERN), F.trim(text).try_cast("double"))


def signed(score: Column, maximize: bool) -> Column:
    """Inside the engine every objective is maximised."""
    return score if maximize else -score


def nan_to_null(score: Column) -> Column:
    """A NaN score is a failed evaluation."""
    return F.when(~F.isnan(score), score)


def rank_score(score: Column) -> Column:
    """Failed rows sort below every scored row."""
    return F.coalesce(score, F.lit(float("-inf")))


def safe_softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow for large x."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def one_hot_unknown(value: Column, choices: list) -> Column:
    """One slot per choice and a last slot for any other value (NULL included)."""
    hits = [F.coalesce((value == F.lit(c)).cast("int"), F.lit(0)) for c in choices]
    known = F.coalesce(value.isin(choices), F.lit(False))
    return F.array(*hits, (~known).cast("int"))


def abbreviate_count(x: Column) -> Column:
    """1500000 -> '1.5M', 12000 -> '12k', 1200 -> '1.2k', 999 -> '999'.

    Halves go to the even digit, by the number's exact binary value, as C and Python print it; Spark's own
    ``format_string`` rounds the shortest decimal form up (198500 would be '199k').
    """

    @F.pandas_udf("string")
    def label(batch: pd.Series) -> pd.Series:
        def one(v):
            if v >= 1e6:
                return f"{v * 1e-6:.1f}M"
            if v >= 1e4:
                return f"{v * 1e-3:.0f}k"
            return f"{v * 1e-3:.1f}k" if v >= 1e3 else f"{v:.0f}"

        return batch.map(one)

    value = x.cast("double")
    return F.when(value.isNotNull(), label(value))


def temperature(t: Column, start: float, end: float) -> Column:
    """Falls from ``start`` at t = 0 towards ``end``, by a factor e per round."""
    return F.lit(float(start - end)) * F.exp(-t) + F.lit(float(end))


def boltzmann_decay(global_max: Column, local_max: Column, temp: Column) -> Column:
    return F.exp(-(global_max - local_max) / temp)


def decode_mean_var(outputs: Column, mean: Column, std: Column) -> Column:
    """Interleaved (mean, var, mean, var, ...) network outputs back to target units."""
    return F.transform(
        outputs,
        lambda x, i: F.when(i % 2 == 0, x * std + mean).otherwise(x * std * std),
    )
