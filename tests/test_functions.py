import math

import pytest
from pyspark.sql import functions as F

from activepool import functions as fn
from activepool.functions import tokens as tk


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normal_cdf_against_erfc(spark):
    zs = [x / 7 for x in range(-105, 106)] + [38.0, -38.0]
    df = spark.createDataFrame([(float(z),) for z in zs], "z double")
    for row in df.select("z", fn.normal_cdf(F.col("z")).alias("p")).collect():
        assert row["p"] == pytest.approx(0.5 * math.erfc(-row["z"] / math.sqrt(2)), abs=1e-14)


def test_prob_above_without_spread(spark):
    df = spark.createDataFrame([(2.0, 0.0), (0.5, 0.0), (1.0, 0.0), (1.0, 4.0)], "mu double, var double")
    p = [r[0] for r in df.select(fn.prob_above(F.col("mu"), F.col("var"), 1.0)).collect()]
    assert p == [1.0, 0.0, 0.5, 0.5]


def test_hash_uniform_ignores_partitions(spark):
    df = spark.range(500).withColumn("u", fn.hash_uniform(F.col("id"), "s"))
    seen = {p: sorted(map(tuple, df.repartition(p).collect())) for p in (1, 4, 13)}
    assert seen[1] == seen[4] == seen[13]
    us = [u for _, u in seen[1]]
    assert 0 <= min(us) and max(us) < 1 and abs(sum(us) / 500 - 0.5) < 0.05


def test_hash_normal_moments(spark):
    row = (
        spark.range(4000)
        .select(fn.hash_normal(F.col("id"), "n").alias("x"))
        .agg(F.avg("x").alias("m"), F.stddev("x").alias("s"))
        .first()
    )
    assert abs(row["m"]) < 0.06 and abs(row["s"] - 1) < 0.05


@pytest.mark.parametrize(
    "text,value",
    [("1.5", 1.5), (" -2e3 ", -2000.0), (".5", 0.5), ("3.", 3.0), ("inf", math.inf),
     ("1e3d", None), ("n/a", None), ("", None), ("1,5", None), ("0x10", None)],
)
def test_parse_float(spark, text, value):
    assert one(spark, fn.parse_float(F.lit(text))) == value


def test_parse_float_nan(spark):
    assert math.isnan(one(spark, fn.parse_float(F.lit("NaN"))))


@pytest.mark.parametrize(
    "x,label", [(1.5e6, "1.5M"), (12000.0, "12k"), (1200.0, "1.2k"), (999.0, "999")]
)
def test_abbreviate(spark, x, label):
    assert one(spark, fn.abbreviate_count(F.lit(x))) == label


@pytest.mark.parametrize(
    "x,label", [(198500.0, "198k"), (199500.0, "200k"), (1250.0, "1.2k"), (0.5, "0"), (2.5, "2"), (None, None)]
)
def test_abbreviate_rounds_halves_to_even(spark, x, label):
    assert one(spark, fn.abbreviate_count(F.lit(x).cast("double"))) == label


def test_one_hot_unknown_value_takes_last_slot(spark):
    assert one(spark, fn.one_hot_unknown(F.lit("b"), ["a", "b"])) == [0, 1, 0]
    assert one(spark, fn.one_hot_unknown(F.lit("z"), ["a", "b"])) == [0, 0, 1]
    assert one(spark, fn.one_hot_unknown(F.lit(None).cast("string"), ["a", "b"])) == [0, 0, 1]


def test_softplus_is_safe(spark):
    assert one(spark, fn.safe_softplus(F.lit(800.0))) == 800.0
    assert one(spark, fn.safe_softplus(F.lit(0.0))) == pytest.approx(math.log(2))


def test_decode_mean_var(spark):
    out = one(spark, fn.decode_mean_var(F.array(F.lit(1.0), F.lit(2.0)), F.lit(10.0), F.lit(3.0)))
    assert out == [13.0, 18.0]


def test_tokens_of_line_notation(spark):
    text = "C[C@H](N)Cl%12Br"
    assert one(spark, tk.tokenize(F.lit(text))) == ["C", "[C@H]", "(", "N", ")", "Cl", "%12", "Br"]
    assert one(spark, tk.detokenize(tk.tokenize(F.lit(text)))) == text
    assert one(spark, tk.fully_tokenized(F.lit(text))) is True
    assert one(spark, tk.fully_tokenized(F.lit("C C"))) is False
    assert one(spark, tk.fully_tokenized(F.lit(" "))) is False


def test_fully_tokenized_long_text(spark):
    assert one(spark, tk.fully_tokenized(F.lit("CNO" * 20000))) is True


def test_dense_matches_slots(spark):
    df = spark.createDataFrame([("CNOCNS",), ("C",), (" ",)], "t string")
    slots = tk.feature_slots(F.col("t"), "pair", 2, 32)
    rows = df.select(slots.alias("s"), tk.dense(slots, 32).alias("d")).collect()
    assert [i for i, v in enumerate(rows[0]["d"]) if v] == rows[0]["s"] and len(rows[0]["d"]) == 32
    assert rows[1]["s"] == [] and rows[1]["d"] == [0] * 32
    assert rows[2]["s"] is None


def test_count_keys(spark):
    keys = one(spark, tk.count_keys(F.lit("CCN")))
    n = len(tk.KEY_SYMBOLS)
    c = tk.KEY_SYMBOLS.index("C")
    assert len(keys) == 167 and keys[c] == 1 and keys[c + n] == 1 and keys[c + 2 * n] == 0


def test_unknown_feature_kind():
    with pytest.raises(ValueError):
        tk.grams(None, "ecfp")
