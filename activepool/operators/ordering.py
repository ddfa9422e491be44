"""Positions, running totals and top-n over tables of any size.

A window without a partition key, a large ``limit`` and a window over one hot key all end in one
task. The operators here reach the same rows with range partitions and small per-partition totals,
so the biggest group may hold any share of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from ..session import pinned

SMALL_N = 1_000
BLOCK = 100_000
PREFILTER_ROWS = 1_000_000
GATHER = 100_000
_SLOT_BITS = 33


def _group_key(names: Sequence[str]) -> Column:
    """The names as one struct: never NULL itself, so a plain equi join matches NULL with NULL, and
    join and window share one hash partitioning."""
    return F.struct(*[F.col(n) for n in names])


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "pos",
    partitions: int | None = None,
) -> DataFrame:
    """Exact 1-based position of each row in ``order`` (per ``by`` group), without a global window.

    ``order`` must be total (end it with the key). Rows are range-partitioned on (by, order), which
    splits a hot group over many partitions; the sorted table is written once so that the slots
    stay fixed; then only (partition, group) counts are summed.
    """
    by = list(by)
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_keys = [F.col(c).asc() for c in by] + list(order)
    placed = (
        df.repartitionByRange(partitions, *sort_keys)
        .sortWithinPartitions(*sort_keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    placed = pinned(placed, "numbered").withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    placed = placed.withColumn("_g", _group_key(["_part", *by]))
    stretch = placed.groupBy("_g").agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = (
        W.partitionBy(*[F.col("_g")[c] for c in by])
        .orderBy(F.col("_g")["_part"])
        .rowsBetween(W.unboundedPreceding, -1)
    )
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    # Written, so that its true size (partitions + groups) decides between broadcast and shuffle.
    offsets = pinned(stretch.select("_g", shift.alias("_shift")), "offsets")
    return placed.join(offsets, "_g").select(*df.columns, (F.col("_slot") + F.col("_shift")).alias(name))


def running_totals(
    df: DataFrame,
    pos: str,
    sums: dict[str, Column],
    by: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Running sums (row included) along an integer position that is unique per group.

    Blocks of ``block`` positions are totalled first; a row's value is the total of the earlier
    blocks plus the running sum inside its own block. A task sees at most ``block`` rows of a group,
    and the window over block totals is ``block`` times smaller than the table. Give dense
    positions (see ``number_rows``) when the ids are sparse.
    """
    by = list(by)
    names = list(sums)
    # The block is named by its first position: integer arithmetic only.
    start = F.col(pos) - F.pmod(F.col(pos), F.lit(block))
    rows = df.withColumns({"_block": start, **{f"_v_{n}": e for n, e in sums.items()}})
    rows = rows.withColumn("_g", _group_key([*by, "_block"]))
    totals = rows.groupBy("_g").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = (
        W.partitionBy(*[F.col("_g")[c] for c in by])
        .orderBy(F.col("_g")["_block"])
        .rowsBetween(W.unboundedPreceding, -1)
    )
    totals = totals.select("_g", *[F.sum(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in names])
    inside = W.partitionBy("_g").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(totals, "_g").select(
        *df.columns,
        *[
            (
                F.coalesce(F.col(f"_b_{n}"), F.lit(0))
                + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))
            ).alias(n)
            for n in names
        ],
    )


def loose_cut(df: DataFrame, column: str, n: int, accuracy: int = 10_000) -> float | None:
    """A value such that at least ``n`` rows lie at or above it, and few more; None if unsure.

    Reads one column twice (quantile sketch, then an exact count that proves the bound).
    """
    total = df.agg(F.count(column).alias("c")).first()["c"]
    if total == 0 or n >= total:
        return None
    share = max(0.0, 1.0 - n / total * 1.01 - 2.0 / accuracy)
    cut = df.agg(F.percentile_approx(column, F.lit(share), F.lit(accuracy)).alias("v")).first()["v"]
    if cut is None:
        return None
    kept = df.filter(F.col(column) >= F.lit(cut)).count()
    return float(cut) if kept >= n else None


def order_boundaries(
    df: DataFrame,
    value: str,
    key: str,
    ks: Sequence[int],
    accuracy: int = 10_000,
    total: int | None = None,
    gather: int = GATHER,
) -> list[tuple]:
    """The exact k-th smallest ``(value, key)`` for each k, NULL values left out.

    Whatever the number of ks: quantile sketches give a bracket per k, exact counts prove it (a
    bracket that fails becomes the whole table), and only the rows inside the brackets are put in
    order: in one task while they are at most ``gather`` rows, else in range partitions. A row's side
    of a boundary is then a plain comparison, so cutting a table into exact parts moves none of its
    rows. ``df`` is read three times: give a written table.
    """
    if not ks:
        return []
    rows = df.select(F.col(value).alias("_v"), F.col(key).alias("_k")).filter(F.col("_v").isNotNull())
    total = rows.count() if total is None else total
    slack = 2.0 / accuracy
    points = []
    for k in ks:
        points += [max(0.0, k / total - slack), min(1.0, k / total + slack)]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(p) for p in points]), F.lit(accuracy))
    ends = rows.agg(sketch.alias("e")).first()["e"]
    brackets = list(zip(ends[0::2], ends[1::2]))
    below = rows.agg(
        *[F.count_if(F.col("_v") < F.lit(lo)).alias(f"b{i}") for i, (lo, _) in enumerate(brackets)],
        *[F.count_if(F.col("_v") <= F.lit(hi)).alias(f"u{i}") for i, (_, hi) in enumerate(brackets)],
    ).first()
    inside, targets, n_inside = [], [], 0
    for i, (k, (lo, hi)) in enumerate(zip(ks, brackets)):
        proven = below[f"b{i}"] < k <= below[f"u{i}"]
        member = F.col("_v").between(F.lit(lo), F.lit(hi)) if proven else F.lit(True)
        inside.append(F.when(member, F.lit(i)))
        targets.append(k - below[f"b{i}"] if proven else k)
        n_inside += below[f"u{i}"] - below[f"b{i}"] if proven else total
    tagged = rows.select(
        "_v", "_k", F.explode(F.filter(F.array(*inside), lambda i: i.isNotNull())).alias("_i")
    )
    if n_inside <= gather:
        rank = F.row_number().over(W.partitionBy("_i").orderBy("_v", "_k"))
        ordered = tagged.withColumn("_pos", rank)
    else:
        ordered = number_rows(tagged, [F.col("_v").asc(), F.col("_k").asc()], by=["_i"], name="_pos")
    wanted = F.array(*[F.lit(t) for t in targets])
    found = ordered.filter(F.col("_pos") == F.get(wanted, F.col("_i"))).collect()
    at = {r["_i"]: (r["_v"], r["_k"]) for r in found}
    return [at[i] for i in range(len(ks))]


def not_after(value: str, key: str, boundary: tuple) -> Column:
    """True for rows at or before the boundary in (value, key) order."""
    v, k = F.lit(boundary[0]), F.lit(boundary[1])
    return (F.col(value) < v) | ((F.col(value) == v) & (F.col(key) <= k))


def not_before(value: str, key: str, boundary: tuple) -> Column:
    v, k = F.lit(boundary[0]), F.lit(boundary[1])
    return (F.col(value) > v) | ((F.col(value) == v) & (F.col(key) >= k))


def _tie_break(df: DataFrame, value: str, key: str) -> list[Column]:
    """Order among rows of one (value, key): a hash of the other columns, so that reruns agree."""
    others = [c for c, t in df.dtypes if c not in (value, key) and "map<" not in t and t != "variant"]
    return [F.xxhash64(*[F.col(f"`{c}`") for c in others]).asc()] if others else []


def top_n(
    df: DataFrame, n: int, value: str, key: str, small_n: int = SMALL_N, gather: int = GATHER
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: the largest ``value`` first (NULL last), ties to the larger ``key``.

    Rows that repeat a (value, key) pair count one by one. Up to ``small_n`` Spark's own top-k gives
    them. Beyond, the table is written once (give narrow rows), the exact boundary row is found, rows
    past it are kept by a comparison, of the rows equal to it as many as are wanted, and the result is
    sorted by range, so no task holds n rows. The rows and their order are the same either way.
    """
    tie = _tie_break(df, value, key)
    best = [F.col(value).desc_nulls_last(), F.col(key).desc(), *tie]
    if n <= small_n:
        return df.orderBy(*best).limit(n)
    seen = Observation("top")
    rows = pinned(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(value).alias("valued")), "top")
    counts = seen.get
    if n < counts["rows"]:
        if n <= counts["valued"]:
            part, total, order_by, rest = rows.filter(F.col(value).isNotNull()), counts["valued"], value, None
            wanted = n
        else:  # some rows without a value are taken too, by key alone
            part, total, order_by = rows.filter(F.col(value).isNull()), counts["rows"] - counts["valued"], "_zero"
            part, rest, wanted = part.withColumn("_zero", F.lit(0)), rows.filter(F.col(value).isNotNull()), n - counts["valued"]
        kept = part
        if wanted == 0:
            kept = part.limit(0)
        elif wanted < total:
            (boundary,) = order_boundaries(part, order_by, key, [total - wanted + 1], total=total, gather=gather)
            at_or_past = not_before(order_by, key, boundary)
            equal = (F.col(order_by) == F.lit(boundary[0])) & (F.col(key) == F.lit(boundary[1]))
            tally = part.agg(F.count_if(at_or_past).alias("all"), F.count_if(equal).alias("equal")).first()
            kept = part.filter(at_or_past)
            if tally["all"] > wanted:
                surplus = wanted - (tally["all"] - tally["equal"])
                placed = number_rows(part.filter(equal), [*tie, F.col(key).asc()], name="_pos")
                kept = part.filter(at_or_past & ~equal).unionByName(
                    placed.filter(F.col("_pos") <= surplus).drop("_pos")
                )
        rows = kept.drop("_zero") if rest is None else rest.unionByName(kept.drop("_zero"))
    return rows.orderBy(*best)


def top_per_group(
    df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str], small_n: int = SMALL_N
) -> DataFrame:
    """The first ``n`` rows of each group.

    Small n: ``row_number() <= n`` is planned as a per-task limit before the shuffle. Large n: range
    partitions, so that a group of any size is split. The rows are the same either way.
    """
    if n <= small_n:
        ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    else:
        ranked = number_rows(df, order, by=by, name="_r")
    return ranked.filter(F.col("_r") <= n).drop("_r")


GRID = (0.5, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999, 0.9995, 0.9999)


def _quota_candidates(
    df: DataFrame, quotas: DataFrame, by: str, value: str, quota: str, accuracy: int = 10_000
) -> DataFrame:
    """Rows that can be among their group's quota: those above a quantile of the group.

    The quantile leaves more rows than the quota by the sketch's error; groups where the count does
    not prove that keep all their rows.
    """
    grid = F.array(*[F.lit(p) for p in GRID])
    sketch = F.percentile_approx(value, grid, F.lit(accuracy)).alias("_cuts")
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count(value).alias("_n"), sketch)
    wanted = quotas.select(F.col(by).alias("_q_by"), F.col(quota).alias("_quota"))
    need = (F.col("_quota") * 1.01 / F.col("_n")) + F.lit(2.0 / accuracy)
    levels = F.size(F.filter(grid, lambda p: F.lit(1.0) - p >= need))
    cuts = sizes.join(wanted, F.col("_by").eqNullSafe(F.col("_q_by"))).select(
        "_by", "_quota", F.get("_cuts", levels - 1).alias("_cut")
    )
    cuts = pinned(cuts, "cuts")
    above = df.join(cuts, F.col(by).eqNullSafe(F.col("_by")) & (F.col(value) >= F.col("_cut")))
    proven = above.groupBy("_by", "_quota", "_cut").agg(F.count(F.lit(1)).alias("_kept"))
    proven = pinned(proven.filter(F.col("_kept") >= F.col("_quota")).select("_by", "_cut"), "proven")
    joined = df.join(proven, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.filter(F.col("_cut").isNull() | (F.col(value) >= F.col("_cut"))).select(*df.columns)


def top_quota(
    df: DataFrame,
    quotas: DataFrame,
    by: str,
    value: str,
    key: str,
    quota: str = "quota",
    prefilter: bool | None = None,
) -> DataFrame:
    """Per group, the ``quota`` rows with the largest ``value``; a group may be of any size.

    ``quotas`` has one row per group. With ``prefilter`` rows below a proven quantile of their group
    are dropped in the scan, so that about the quotas are put in order and not the table; by default
    that is done for tables where the extra passes pay.
    """
    if prefilter is None:
        prefilter = df.count() >= PREFILTER_ROWS
    order = [F.col(value).desc_nulls_last(), F.col(key).desc()]
    limits = pinned(quotas.select(F.col(by), F.col(quota).alias("_quota")), "quotas")
    rows = _quota_candidates(df, limits, by, value, "_quota") if prefilter else df
    numbered = number_rows(rows, order, by=[by], name="_pos")
    limits = limits.withColumnRenamed(by, "_by")
    within = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_pos") <= F.col("_quota"))
    return numbered.join(limits, within).drop("_by", "_quota", "_pos")


def chunk_rows(
    df: DataFrame, sizes: Sequence[int], order: Sequence[Column], name: str = "chunk"
) -> DataFrame:
    """Cut an ordered table into chunks of the given sizes; rows past the last are single chunks.

    The sizes become a table of (chunk, last position) that the positions are joined with.
    """
    sizes = [s for s in sizes if s > 0]
    total, ends = 0, []
    for i, size in enumerate(sizes):
        ends.append((i, total + 1, total + size))
        total += size
    spark = df.sparkSession
    placed = number_rows(df, order, name="_pos")
    single = F.col("_pos") - F.lit(total) - 1 + F.lit(len(sizes))
    if not sizes:
        return placed.withColumn(name, single.cast("bigint")).drop("_pos")
    ranges = spark.createDataFrame(ends, "_chunk bigint, _from bigint, _to bigint")
    starts = ranges.select(F.explode(F.sequence("_from", "_to")).alias("_at"), "_chunk")
    joined = placed.join(starts, F.col("_pos") == F.col("_at"), "left")
    return joined.withColumn(name, F.coalesce("_chunk", single.cast("bigint"))).drop("_pos", "_at", "_chunk")
