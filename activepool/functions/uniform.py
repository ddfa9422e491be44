"""Reproducible randomness: a function of (key, salt), never of the partitioning.

``rand(seed)`` changes when partitions move or a task is retried; these do not, so a lost executor
recomputes the same draws.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TWO_52 = float(2**52)


def hash_uniform(key: Column, salt) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of ``md5(key:salt)``."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_TWO_52)


def hash_normal(key: Column, salt) -> Column:
    """Standard normal by Box-Muller on two independent uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - hash_uniform(key, f"{salt}/r")))
    angle = F.lit(6.283185307179586) * hash_uniform(key, f"{salt}/t")
    return radius * F.cos(angle)
