"""Skewed fixtures: one group or value holds far more than a third of the rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from activepool.operators import ordering as od
from activepool.operators.scores import top_average


def skewed(spark, n=600):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 10 < 7 else f"g{i % 5}", float(rnd.choice([1, 1, 1, 2, 3]))) for i in range(n)]
    rows += [(n + 1, None, 5.0), (n + 2, None, None)]
    return rows, spark.createDataFrame(rows, "id long, grp string, v double")


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_number_rows_global(spark, partitions):
    rows, df = skewed(spark)
    out = od.number_rows(df, [F.col("v").desc_nulls_last(), F.col("id").desc()], partitions=partitions)
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), -r[0]))
    got = {r["id"]: r["pos"] for r in out.collect()}
    assert [got[r[0]] for r in want] == list(range(1, len(rows) + 1))


def test_number_rows_per_group_with_null_group(spark):
    rows, df = skewed(spark)
    out = od.number_rows(df, [F.col("id").asc()], by=["grp"], partitions=7)
    got = {r["id"]: r["pos"] for r in out.collect()}
    seen = {}
    for i, g, _ in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]


def test_running_totals_over_blocks(spark):
    rows, df = skewed(spark)
    out = od.running_totals(df, "id", {"s": F.coalesce("v", F.lit(0.0)), "n": F.lit(1)}, by=["grp"], block=17)
    got = {r["id"]: (r["s"], r["n"]) for r in out.collect()}
    sums = {}
    for i, g, v in sorted(rows):
        s, n = sums.get(g, (0.0, 0))
        sums[g] = (s + (v or 0.0), n + 1)
        assert got[i] == pytest.approx(sums[g])


@pytest.mark.parametrize("n", [0, 1, 50, 450, 601, 5000])
def test_top_n_paths_agree(spark, n):
    rows, df = skewed(spark)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), -r[0]))[:n]]
    pick = lambda **o: [r["id"] for r in od.top_n(df, n, "v", "id", **o).collect()]
    assert pick(small_n=10**6) == pick(small_n=-1) == pick(small_n=-1, gather=0) == want


@pytest.mark.parametrize("n", [1, 99, 100, 101, 350, 400, 420])
def test_top_n_with_repeated_pairs(spark, n):
    """Four (value, key) pairs of 100 rows and 20 rows without a value: exactly n rows, same rows and order."""
    rows = [(i % 4, float(i % 4), i) for i in range(400)] + [(9, None, i) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v double, other long")
    pick = lambda **o: [tuple(r) for r in od.top_n(df, n, "v", "id", **o).collect()]
    small, large, ranged = pick(small_n=1000), pick(small_n=0), pick(small_n=0, gather=0)
    assert len(small) == n and small == large == ranged
    assert [r[1] for r in small] == sorted((r[1] for r in small), key=lambda v: (v is None, -(v or 0)))


def test_loose_cut_keeps_enough(spark):
    _, df = skewed(spark)
    for n in (1, 10, 100, 300):
        cut = od.loose_cut(df, "v", n)
        assert cut is None or df.filter(F.col("v") >= cut).count() >= n


def test_top_quota(spark):
    rows, df = skewed(spark)
    quotas = df.groupBy("grp").agg(F.ceil(F.count("*") / 10).alias("quota"))
    got = {r["id"] for r in od.top_quota(df, quotas, "grp", "v", "id").collect()}
    want = set()
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r[2] is None, -(r[2] or 0), -r[0]))
        want |= {r[0] for r in members[: -(-len(members) // 10)]}
    assert got == want


@pytest.mark.parametrize("gather", [0, 10**6])
def test_order_boundaries(spark, gather):
    rows, df = skewed(spark)
    valued = sorted((v, i) for i, _, v in rows if v is not None)
    ks = [1, 7, 300, 420, len(valued)]
    assert od.order_boundaries(df, "v", "id", ks, gather=gather) == [valued[k - 1] for k in ks]
    assert od.order_boundaries(df, "v", "id", ks, accuracy=2, gather=gather) == [valued[k - 1] for k in ks]
    assert od.order_boundaries(df, "v", "id", []) == []


def test_quota_prefilter_changes_nothing(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("grp"),
        (F.hash("id") % 1000).cast("double").alias("v"),
    )
    quotas = df.groupBy("grp").agg(F.ceil(F.count("*") / 40).alias("quota"))
    pick = lambda p: sorted(r["id"] for r in od.top_quota(df, quotas, "grp", "v", "id", prefilter=p).collect())
    assert pick(True) == pick(False)


def test_chunks_with_empty_size_and_tail(spark):
    df = spark.range(7)
    rows = od.chunk_rows(df, [2, 0, 3], [F.col("id").asc()]).orderBy("id").collect()
    assert [r["chunk"] for r in rows] == [0, 0, 1, 1, 1, 2, 3]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    scores=st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=12),
    k=st.integers(1, 14),
)
def test_top_average_model(spark, scores, k):
    df = spark.createDataFrame(
        [(i, None if s is None else float(s)) for i, s in enumerate(scores)], "id long, score double"
    )
    best = sorted(scores, key=lambda s: float("-inf") if s is None else s, reverse=True)[:k]
    want = sum(s or 0 for s in best) / len(best)
    assert top_average(df, k).first()["top_avg"] == pytest.approx(want)
