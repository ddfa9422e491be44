"""Token features in tasks beside their column forms, and tables of few row groups."""

import pytest
from pyspark.sql import functions as F

from activepool.functions.numbers import let
from activepool.functions.tokens import LINE_NOTATION, WORDS, feature_slots, grams, min_hashes, slot_of, tokenize
from activepool.session import spread

TEXTS = [None, "", "  ", "\n", "a", "a b", "é ü a a a", "x" * 50, "the cat sat on the mat the cat", "[a [b]c Br Cl %12 %1 a-b\\/~|"]


@pytest.mark.parametrize("kind,pattern,length", [
    ("pair", WORDS, 512), ("pair", "(.)", 64), ("morgan", WORDS, 512), ("rdkit", WORDS, 64), ("map4", WORDS, 2048), ("map4", "(.)", 16),
])
def test_slots_are_those_of_the_columns(spark, kind, pattern, length):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    pieces = let(tokenize(F.col("text"), pattern), lambda tokens: grams(tokens, kind, 2))
    if kind == "map4":
        ones = F.transform(min_hashes(pieces, length), lambda v: F.pmod(v, F.lit(length)).cast("int"))
    else:
        ones = F.transform(pieces, lambda g: slot_of(g, length))
    plain = F.when(F.length(F.trim("text")) > 0, F.array_sort(F.array_distinct(ones)))
    both = rows.select(plain.alias("a"), feature_slots(F.col("text"), kind, 2, length, pattern).alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())


def test_line_tokens_are_those_of_the_pattern(spark):
    odd = [*TEXTS, "".join(map(chr, range(32, 127))), "%99%a%1[]][x]", "BrBClCrl"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    given = F.regexp_extract_all("text", F.lit(LINE_NOTATION), F.lit(1))
    assert all(r["a"] == r["b"] for r in rows.select(given.alias("a"), tokenize(F.col("text")).alias("b")).collect())


def test_a_file_of_one_row_group_is_spread(spark, tmp_path):
    """Such a file has a split for every core, but all of its rows are in one of them."""
    path = str(tmp_path / "one")
    spark.range(400_000).select("id", F.md5(F.col("id").cast("string")).alias("t")).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    held = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("id").alias("n")).collect()]
    assert table.rdd.getNumPartitions() >= 4 and len(held(table)) == 1
    parts = held(spread(table, "id"))
    assert sum(parts) == 400_000 and max(parts) < 150_000
    even = spark.range(0, 1000, 1, 4)
    assert spread(even, "id") is even and spread(spark.range(0), "id").count() == 0
