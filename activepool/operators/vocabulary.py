"""Tokens to vocabulary ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tokens import BOS, EOS, LINE_NOTATION, PAD, SPECIAL_TOKENS, tokenize
from ..session import one_row, pinned
from .ordering import number_rows

DICT_LIMIT = 50_000


def _dictionary_ids(table: dict) -> Column:
    unknown = PAD

    @F.pandas_udf("array<int>")
    def code(batch: pd.Series) -> pd.Series:
        return batch.map(lambda row: None if row is None else [table.get(t, unknown) for t in row])

    return code("_tokens")


def build_vocabulary(df: DataFrame, text: str, pattern: str = LINE_NOTATION) -> DataFrame:
    """``(token, token_id)``: the special tokens, then all tokens by falling count."""
    counts = (
        df.select(F.explode(tokenize(F.col(text), pattern)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = number_rows(counts, [F.col("n").desc(), F.col("token").asc()], name="_pos")
    words = ranked.select("token", (F.col("_pos") + len(SPECIAL_TOKENS) - 1).cast("int").alias("token_id"))
    special = df.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, token_id int"
    )
    return special.unionByName(words)


def read_vocabulary(spark, path: str) -> DataFrame:
    """One token per line; the line number is the id."""
    from ..sources.text import LINE, line_key

    lines = spark.read.text(path).select(F.col("value").alias("token"), line_key().alias(LINE))
    numbered = number_rows(lines, [F.col(LINE).asc()], name="_pos")
    return numbered.select("token", (F.col("_pos") - 1).cast("int").alias("token_id"))


def encode(
    df: DataFrame,
    text: str,
    vocabulary: DataFrame,
    pattern: str = LINE_NOTATION,
    pad_to: int | None = None,
    dict_limit: int = DICT_LIMIT,
) -> DataFrame:
    """Adds ``ids`` (begin and end marks, padded) and ``mask``; an unknown token gets the pad id.

    ``pad_to=None`` pads to the longest row of the table. A token listed twice has its smallest id; a
    NULL text has NULL ids and mask; every row is coded by itself, whatever its columns repeat. Up to
    ``dict_limit`` tokens the vocabulary is a dictionary in an Arrow UDF, a larger one is joined; the
    ids are the same either way.
    """
    tokens = df.withColumn("_tokens", F.when(F.col(text).isNotNull(), tokenize(F.col(text), pattern)))
    words = vocabulary.groupBy("token").agg(F.min("token_id").alias("token_id"))
    known = words.limit(dict_limit + 1).collect() if dict_limit else None
    if known is not None and len(known) <= dict_limit:
        coded = tokens.withColumn("_ids", _dictionary_ids({w["token"]: w["token_id"] for w in known}))
    else:
        tokens = pinned(tokens.withColumn("_row", F.monotonically_increasing_id()), "tokens")
        flat = tokens.select("_row", F.posexplode("_tokens").alias("_at", "token"))
        cell = F.struct("_at", F.coalesce("token_id", F.lit(PAD)).alias("v"))
        matched = (
            flat.join(words, "token", "left")
            .groupBy("_row")
            .agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
            .select("_row", F.transform("_cells", lambda c: c["v"]).alias("_coded"))
        )
        none = F.when(F.col("_tokens").isNotNull(), F.array().cast("array<int>"))
        coded = tokens.join(matched, "_row", "left").withColumn("_ids", F.coalesce("_coded", none))
        coded = coded.drop("_coded", "_row")
    marked = coded.withColumn("_ids", F.concat(F.array(F.lit(BOS)), F.col("_ids"), F.array(F.lit(EOS))))
    if pad_to is None:
        longest = df.select(F.size(tokenize(F.col(text), pattern)).alias("n")).agg(F.max("n").alias("n"))
        width = one_row(longest)["n"] + 2
    else:
        width = F.lit(pad_to)
    missing = F.greatest(width - F.size("_ids"), F.lit(0))
    padded = F.concat(F.col("_ids"), F.array_repeat(F.lit(PAD), missing))
    mask = F.concat(
        F.transform("_ids", lambda i: F.lit(1)), F.array_repeat(F.lit(0), missing)
    ).cast("array<tinyint>")
    return marked.withColumns({"ids": padded, "mask": mask}).drop("_ids", "_tokens")
