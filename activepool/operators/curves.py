"""Reward curves: one value per acquired row, for many runs at once.

``points(run_id, seq, id, score)``; ``seq`` is an integer acquisition position, unique per run and
close to dense (``number_rows`` makes one). Every curve is a set of blocked running totals, so a
single run may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import one_row, pinned
from .ordering import BLOCK, number_rows, running_totals, top_per_group

#: Parts of a stretch that are counted in one window.
PARTS = 8
#: Events, of all runs, that may be put in order by run; beyond, they are put in order by range.
FEW_EVENTS = 1_000_000


def hit_curve_scores(points: DataFrame, true_top: DataFrame, block: int = BLOCK) -> DataFrame:
    """Share of the true scores reached: all scores above the lowest true score, and of the scores
    equal to it only as many (in acquisition order) as the true list holds."""
    low = true_top.agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    fact = one_row(low)
    ties = one_row(
        true_top.withColumn("_low", fact["low"]).agg(F.count_if(F.col("score") == F.col("_low")).alias("m"))
    )["m"]
    rows = points.withColumns({"_low": fact["low"], "_m": ties, "_n": fact["n"]})
    curve = running_totals(
        rows,
        "seq",
        {
            "n_sampled": F.lit(1),
            "_above": (F.coalesce(F.col("score") > F.col("_low"), F.lit(False))).cast("bigint"),
            "_tied": (F.coalesce(F.col("score") == F.col("_low"), F.lit(False))).cast("bigint"),
        },
        by=["run_id"],
        block=block,
    )
    reward = (F.col("_above") + F.least("_tied", "_m")) / F.col("_n")
    return curve.select("run_id", "n_sampled", reward.alias("reward"))


def hit_curve_keys(points: DataFrame, true_top: DataFrame, block: int = BLOCK) -> DataFrame:
    """Share of the true keys found so far."""
    n = one_row(true_top.agg(F.count(F.lit(1)).alias("n")))["n"]
    flagged = points.join(true_top.select("id", F.lit(1).alias("_hit")), "id", "left")
    curve = running_totals(
        flagged, "seq", {"n_sampled": F.lit(1), "_hits": F.coalesce("_hit", F.lit(0))}, ["run_id"], block
    )
    return curve.select("run_id", "n_sampled", (F.col("_hits") / n).alias("reward"))


def running_mean_curve(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Mean of all scores so far, a failure counting as 0."""
    curve = running_totals(
        points,
        "seq",
        {"n_sampled": F.lit(1), "_sum": F.coalesce(F.col("score"), F.lit(0.0))},
        ["run_id"],
        block,
    )
    return curve.select("run_id", "n_sampled", (F.col("_sum") / F.col("n_sampled")).alias("reward"))


def class_curve(points: DataFrame, classes: DataFrame, names, block: int = BLOCK) -> DataFrame:
    """Per size class, the share of its members found so far: one column per name."""
    size_row = classes.agg(
        *[F.count_if(F.col("size_class") == F.lit(n)).alias(n) for n in names]
    )
    sizes = one_row(size_row)
    flagged = points.join(classes.select("id", "size_class"), "id", "left")
    sums = {
        f"_c_{n}": F.coalesce((F.col("size_class") == F.lit(n)).cast("bigint"), F.lit(0)) for n in names
    }
    curve = running_totals(flagged, "seq", {"n_sampled": F.lit(1), **sums}, ["run_id"], block)
    return curve.select(
        "run_id", "n_sampled", *[(F.col(f"_c_{n}") / sizes[n]).alias(f"found_{n}") for n in names]
    )


def boundary_top_average(points: DataFrame, k: int) -> DataFrame:
    """Top-k average after each round (``points`` has ``iter``), a missing place counting as 0.

    Each round is cut to its k best rows first; the best k are carried forward over the rounds.
    """
    lists = _best_lists(points.filter(F.col("score").isNotNull()), ["run_id", "iter"], k)
    rounds = points.select("run_id", "iter").distinct()
    place = W.partitionBy("run_id").orderBy("iter")
    states = pinned(
        rounds.withColumn("_at", F.row_number().over(place)).join(lists, ["run_id", "iter"], "left"), "rounds"
    )
    total = F.aggregate("_upto", F.lit(0.0), lambda a, x: a + x)
    return best_upto(states, ["run_id"], "_at", k).select("run_id", "iter", (total / F.lit(k)).alias("reward"))


def _best_lists(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """``_best``: the k largest scores of each group, best first."""
    ranked = top_per_group(rows.select(*by, "score"), k, [F.col("score").desc()], by)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("score"), asc=False).alias("_best"))


def best_upto(states: DataFrame, by: list[str], at: str, k: int, fan: int = 64) -> DataFrame:
    """Adds ``_upto``: the k largest of all ``_best`` lists of places 1..``at`` (dense per group).

    A tree of prefix scans: inside each stretch of ``fan`` places a window gathers the lists, the whole
    stretches are places of the level above, and what came before a stretch is joined back. A task sees
    ``fan`` lists of k values, whatever the group, and a level has ``fan`` times fewer places.
    """
    none = F.array().cast("array<double>")
    merged = lambda lists: F.slice(F.sort_array(F.flatten(lists), asc=False), 1, k)
    rows = states.withColumn("_stretch", F.floor((F.col(at) - 1) / F.lit(fan)))
    inside = W.partitionBy(*by, "_stretch").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", merged(F.collect_list(F.coalesce("_best", none)).over(inside)))
    longest = states.agg(F.max(at).alias("n")).first()["n"] or 0
    if longest <= fan:
        return rows.drop("_best", "_stretch")
    rows = pinned(rows, "upto")
    ends = rows.groupBy(*by, "_stretch").agg(F.max_by("_upto", at).alias("_best"))
    above = best_upto(ends.withColumn("_at", F.col("_stretch") + 1), by, "_at", k, fan)
    # What stood at the end of the stretch before.
    before = above.select(*by, F.col("_at").alias("_stretch"), F.col("_upto").alias("_more"))
    both = merged(F.array(F.coalesce("_more", none), F.col("_upto")))
    return rows.join(before, [*by, "_stretch"], "left").withColumn("_upto", both).drop("_best", "_stretch", "_more")


def _entering(rows: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """Rows that are among the best m when they come: fewer than m rows before them have their score or more.

    ``rows`` (run_id, _block, _in: place in the block, seq, score) may hold any rows that could be; ``starts``
    has the best m scores before each block, m itself and the worst of a full list. The rows of a block that
    come earlier and are as large are counted by parts: at each size, rows of one part of a stretch look at the
    parts left of it. All windows share the hash of (run, block), so the rows are shuffled once.
    """
    worth = rows.join(starts.select("run_id", "_block", "_m", "_worst"), ["run_id", "_block"]).filter(
        (F.col("_m") > 0) & (F.col("_worst").isNull() | (F.col("score") > F.col("_worst")))
    )
    worth = pinned(worth.select("run_id", "_block", "_in", "seq", "score", "_m"), "worth")
    needed = worth.select("run_id", "_block").distinct()
    earlier = starts.join(needed, ["run_id", "_block"], "left_semi").select(
        "run_id", "_block", F.lit(-1).cast("bigint").alias("_in"), F.lit(None).cast("bigint").alias("seq"),
        F.explode("_before").alias("score"), "_m",
    )
    both = worth.unionByName(earlier).withColumn("_g", F.struct("run_id", "_block")).repartition("_g")
    order = [F.col("score").desc(), F.col("_in").asc()]
    so_far = lambda flag, *part: F.sum(flag.cast("int")).over(
        W.partitionBy("_g", *part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    both = both.withColumn("_ahead", so_far(F.col("_in") < 0)).filter("_in >= 0")
    size = 1
    while size < block:
        child, parent = F.pmod(F.floor(F.col("_in") / size), F.lit(PARTS)), F.floor(F.col("_in") / (PARTS * size))
        # Of the parts of one stretch, those left of a row's own.
        left = [F.when(child > j, so_far(child == j, parent)).otherwise(F.lit(0)) for j in range(PARTS - 1)]
        both = both.withColumn("_ahead", sum(left, F.col("_ahead")))
        size *= PARTS
    return both.filter(F.col("_ahead") < F.col("_m")).select("run_id", "seq", "score")


def _steps(entered: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(run_id, seq, sum, until): where the gains of each run change, from row 1 on; events of a run in one task."""
    event = F.when(F.col("seq") > k, F.struct("seq", "score"))
    lists = entered.groupBy("run_id").agg(F.array_sort(F.collect_list(event)).alias("_ev"), F.array_sort(F.collect_list("score")).alias("_out"))
    gains = F.transform("_ev", lambda e, i: F.struct(e["seq"].alias("seq"), (e["score"] - F.get("_out", i)).alias("gain")))
    start = F.array(F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit(0.0).alias("gain")))
    rows = places.join(lists, "run_id", "left").select("run_id", F.inline(F.concat(start, F.coalesce(gains, F.slice(start, 1, 0)))))
    w = W.partitionBy("run_id").orderBy("seq")
    return rows.select("run_id", "seq", F.sum("gain").over(w).alias("sum"), (F.lead("seq").over(w) - 1).alias("until"))


def _steps_by_range(entered: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """The same for any number of events: places in time and in score by range partitions, joined."""
    by = ["run_id"]
    events = number_rows(entered.filter(F.col("seq") > k), [F.col("seq").asc()], by=by, name="_i")
    out = number_rows(entered, [F.col("score").asc(), F.col("seq").asc()], by=by, name="_i")
    gains = events.join(out.select("run_id", "_i", F.col("score").alias("_out")), ["run_id", "_i"])
    gains = gains.select("run_id", "_i", "seq", (F.col("score") - F.col("_out")).alias("_gain"))
    start = places.select("run_id", F.lit(0).cast("bigint").alias("_i"), F.lit(1).cast("bigint").alias("seq"), F.lit(0.0).alias("_gain"))
    steps = running_totals(gains.unionByName(start), "_i", {"sum": F.col("_gain")}, by)
    behind = steps.select("run_id", (F.col("_i") - 1).alias("_i"), (F.col("seq") - 1).alias("until"))
    return steps.join(behind, ["run_id", "_i"], "left").select("run_id", "seq", "sum", "until")


def top_average_curve(points: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """Running top-k average per acquired row (dense ``seq`` from 1).

    The first k rows all get the value reached after k rows. A failure among those leaves its place
    empty for good, counting as 0: the number of places m is the number of scored rows among the
    first k. Later rows change the sum only where they enter the best m, and each of those is an event:
    what it drives out is the worst kept score, which never falls, so the i-th event drives out the i-th
    smallest score that was ever kept. A gain is the difference of the two, and the curve a running total.

    Rows below the best m before their block can't enter; these lists come from the k best of each block by
    a prefix scan. Whether one of the rest enters is counted (see ``_entering``).
    """
    block = block or max(BLOCK, 10 * k)
    rows = points.select(
        "run_id", "seq", "score", F.floor((F.col("seq") - 1) / F.lit(block)).alias("_block"), F.pmod(F.col("seq") - 1, F.lit(block)).alias("_in")
    )
    early = F.col("seq") <= k
    places = rows.groupBy("run_id").agg(
        F.count(F.when(early, F.col("score"))).alias("_m"), F.coalesce(F.sum(F.when(early, F.col("score"))), F.lit(0.0)).alias("_base"),
        F.max("seq").alias("_rows"),
    )
    places = pinned(places, "places")  # a row a run
    # A block's scores are a bounded list; failures are not collected.
    best = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k)
    states = pinned(rows.groupBy("run_id", "_block").agg(best.alias("_best")).withColumn("_at", F.col("_block") + 1), "blocks")
    upto = best_upto(states, ["run_id"], "_at", k)
    # A block starts from what was reached at the end of the one before.
    before = upto.select("run_id", F.col("_at").alias("_block"), F.col("_upto").alias("_before"))
    kept = F.slice(F.coalesce("_before", F.array().cast("array<double>")), F.lit(1), F.greatest("_m", F.lit(1)))
    starts = states.select("run_id", "_block").join(before, ["run_id", "_block"], "left").join(places, "run_id")
    starts = starts.select("run_id", "_block", "_m", F.when(F.col("_m") > 0, kept).alias("_before"))
    full = (F.size("_before") == F.col("_m")) & (F.col("_m") > 0)
    starts = pinned(starts.withColumn("_worst", F.when(full, F.element_at("_before", -1))), "starts")

    entered = pinned(_entering(rows.filter(F.col("score").isNotNull()), starts, block), "entered")
    steps = (_steps if entered.count() <= FEW_EVENTS else _steps_by_range)(entered, places, k)
    # From each event to the next one the curve is level; before the first it is where the first k rows left it.
    level = steps.join(places, "run_id").select(
        "run_id", F.col("seq").alias("_from"), F.coalesce("until", "_rows").alias("_until"), ((F.col("_base") + F.col("sum")) / F.lit(k)).alias("reward")
    )
    # Level stretches are dealt out in pieces, so a long one is no task's alone.
    pieces = level.select("*", F.explode(F.sequence("_from", "_until", F.lit(BLOCK).cast("bigint"))).alias("_at"))
    pieces = pieces.repartition(F.col("run_id"), F.col("_at"))
    rows_of = F.sequence("_at", F.least("_until", F.col("_at") + (BLOCK - 1)))
    return pieces.select("run_id", F.explode(rows_of).alias("n_sampled"), "reward")


def first_seen(rows: DataFrame, by: str = "run_id") -> DataFrame:
    """Round in which each key first appears: the rows that are new per round, in one shuffle."""
    return rows.groupBy(by, "id").agg(F.min("iter").alias("iter"))
