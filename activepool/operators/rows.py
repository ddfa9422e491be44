"""Keyed row access, joins of keyed tables, and the lookup objective."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import signed
from ..functions.tokens import fully_tokenized
from .ordering import number_rows

BROADCAST_ROWS = 50_000


def pick(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ``keys``."""
    return df.join(keys.select(key), key, "left_semi")


def slice_rows(df: DataFrame, start: int, stop: int, order: Sequence[Column]) -> DataFrame:
    """Rows at positions start..stop-1 (from 0) in ``order``."""
    numbered = number_rows(df, order, name="_pos")
    return numbered.filter((F.col("_pos") > start) & (F.col("_pos") <= stop)).drop("_pos")


def contains(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Each wanted key with a membership flag."""
    known = df.select(key).distinct().withColumn("found", F.lit(True))
    return keys.join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lookup_scores(
    batch: DataFrame, oracle: DataFrame, maximize: bool = True, batch_rows: int | None = None
) -> DataFrame:
    """``(id, score)`` of the batch; a key the oracle does not hold gives NULL.

    With a batch of known, small size the oracle is cut to it by a broadcast semi join, so the big
    table is scanned in place and never shuffled.
    """
    table = oracle.select("id", signed(F.col("y"), maximize).alias("score"))
    if batch_rows is not None and batch_rows <= BROADCAST_ROWS:
        table = table.join(F.broadcast(batch.select("id")), "id", "left_semi")
    return batch.join(table, "id", "left")


def split_valid(df: DataFrame, text: str, predicate=fully_tokenized) -> tuple[DataFrame, DataFrame]:
    """Valid rows and invalid rows by a column predicate on the key text."""
    ok = predicate(F.col(text))
    return df.filter(ok), df.filter(~ok)


def validity_counts(df: DataFrame, text: str, predicate=fully_tokenized) -> DataFrame:
    ok = predicate(F.col(text))
    return df.agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


def without_invalid(df: DataFrame, invalid: DataFrame, key: str = "id") -> DataFrame:
    return df.join(invalid.select(key), key, "left_anti")


def draw_rows(df: DataFrame, k: int, repeats: int, seed, order: Sequence[Column]) -> DataFrame:
    """``repeats`` samples of k rows each, with replacement: ``(rep, draw, row)``.

    The draws are a table of k x repeats row numbers; the pool is numbered once and joined.
    """
    from ..functions import hash_uniform

    spark = df.sparkSession
    n = df.count()
    draws = spark.range(k * repeats).select(
        F.floor(F.col("id") / F.lit(k)).alias("rep"),
        F.pmod(F.col("id"), F.lit(k)).alias("draw"),
        (F.floor(hash_uniform(F.col("id"), f"draw/{seed}") * F.lit(n)) + 1).alias("_pos"),
    )
    return number_rows(df, order, name="_pos").join(draws, "_pos").drop("_pos")
