"""Acquisition utilities, top-n and joins of the acquisition step."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from activepool.functions import boltzmann_decay, hash_uniform, temperature
from activepool.operators import acquisition as acq
from activepool.operators.ordering import number_rows, top_n, top_quota
from activepool.operators.rows import lookup_scores
from activepool.operators.scores import kth_best, top_explored
from activepool.sources.colocated import write_colocated
from activepool.session import one_row, pinned

from .registry import (
    BASE,
    POOL,
    PREDS,
    RUNS,
    TRUTH,
    Tables,
    cdf_sql,
    explored,
    normal_sql,
    oracle,
    pdf_sql,
    pool,
    predictions,
    query,
    runs,
    u_sql,
)

K = 10
BEST = f"""best AS (
  SELECT CASE WHEN count(*) >= {K} THEN min(v) ELSE max(v) END AS best FROM (
    SELECT coalesce(score, '-infinity'::double) AS v FROM explored ORDER BY v DESC, id DESC LIMIT {K}))"""


def _best(t: Tables):
    return one_row(kth_best(explored(t), K))["kth_best"]


def _utility(t: Tables, metric: str, **options):
    args = acq.UtilityArgs(salt="7", **options)
    rated = acq.with_utility(predictions(t), metric, args)
    return rated.select("id", F.round("utility", 6).alias("utility"))


def _utility_sql(expr: str, extra: str = "") -> str:
    return f"WITH {PREDS}{extra} SELECT id, round({expr}, 6) AS utility FROM preds"


@query("acq1_random", _utility_sql(u_sql("id", "random/7")))
def acq1(t):
    return _utility(t, "random")


@query(
    "acq2_threshold",
    _utility_sql(f"CASE WHEN mu >= 10.6 THEN {u_sql('id', 'threshold/7')} ELSE -1.0 END"),
)
def acq2(t):
    return _utility(t, "threshold", threshold=10.6)


@query("acq3_greedy", _utility_sql("mu"))
def acq3(t):
    return _utility(t, "greedy")


@query(
    "acq4_noisy",
    _utility_sql(f"mu + (SELECT stddev_pop(mu) FROM preds) * {normal_sql('id', 'noisy/7')}"),
)
def acq4(t):
    return _utility(t, "noisy")


@query("acq5_upper_confidence_bound", _utility_sql("mu + 2.0 * sqrt(var)"))
def acq5(t):
    return _utility(t, "ucb", beta=2.0)


@query("acq6_lower_confidence_bound", _utility_sql("mu - 2.0 * sqrt(var)"))
def acq6(t):
    return _utility(t, "lcb", beta=2.0)


@query("acq7_thompson", _utility_sql(f"mu + sqrt(var) * {normal_sql('id', 'thompson/7')}"))
def acq7(t):
    return _utility(t, "thompson")


@query("acq7_thompson_stochastic", _utility_sql("mu"))
def acq7_stochastic(t):
    return _utility(t, "ts", stochastic=True)


GAIN = "(mu - (SELECT best FROM best) + 0.01)"
Z_ROWS = f"""rated AS (
  SELECT id, mu, var, {GAIN} AS gain, {GAIN} / nullif(sqrt(var), 0.0) AS z FROM preds)"""
EI = f"CASE WHEN var = 0 THEN gain ELSE gain * {cdf_sql('z')} + sqrt(var) * {pdf_sql('z')} END"
PI = f"CASE WHEN var = 0 THEN CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END ELSE {cdf_sql('z')} END"


@query(
    "acq8_expected_improvement",
    f"{BASE}, {BEST}, {Z_ROWS} SELECT id, round({EI}, 6) AS utility FROM rated",
)
def acq8(t):
    return _utility(t, "ei", best=_best(t))


@query(
    "acq9_probability_of_improvement",
    f"{BASE}, {BEST}, {Z_ROWS} SELECT id, round({PI}, 6) AS utility FROM rated",
)
def acq9(t):
    return _utility(t, "pi", best=_best(t))


@query(
    "acq10_metric_dispatch",
    f"""WITH {PREDS}
    SELECT 'greedy' AS metric, round(max(mu), 6) AS top_utility FROM preds
    UNION ALL SELECT 'ucb', round(max(mu + 3.0 * sqrt(var)), 6) FROM preds
    UNION ALL SELECT 'lcb', round(max(mu - 3.0 * sqrt(var)), 6) FROM preds
    UNION ALL SELECT 'random', round(max({u_sql('id', 'random/7')}), 6) FROM preds""",
)
def acq10(t):
    """Metrics by name, each checked against what the predictions provide; one pass over them."""
    preds = predictions(t)
    args = acq.UtilityArgs(beta=3.0, salt="7")
    names = ["greedy", "ucb", "lcb", "random"]
    for name in names:
        acq.check_model(name, {"means", "vars"})
        preds = acq.with_utility(preds, name, args, name=name)
    tops = preds.agg(*[F.max(n).alias(n) for n in names])
    return tops.unpivot([], names, "metric", "top_utility").withColumn(
        "top_utility", F.round("top_utility", 6)
    )


@query(
    "acq11_seeded_streams",
    f"""WITH {PREDS}
    SELECT id, round({u_sql('id', 'random/1')}, 9) AS first, round({u_sql('id', 'random/2')}, 9) AS second,
           true AS repeated
    FROM preds""",
)
def acq11(t):
    """Two seeds give two streams; the same seed repeats its stream after any repartitioning."""
    preds = predictions(t)
    one, two = (acq.UtilityArgs(salt=s) for s in ("1", "2"))
    first = acq.with_utility(preds, "random", one, "first")
    again = acq.with_utility(preds.repartition(13, "mu"), "random", one, "again").select("id", "again")
    both = acq.with_utility(first, "random", two, "second").join(again, "id")
    return both.select(
        "id",
        F.round("first", 9).alias("first"),
        F.round("second", 9).alias("second"),
        (F.col("first") == F.col("again")).alias("repeated"),
    )


CLUSTER_BATCH = 60


@query(
    "acq12_cluster_temperature_quota",
    f"""{BASE}, joined AS (
      SELECT r.id, r.mu, p.cluster_id, round(r.mu + 2.0 * sqrt(r.var), 6) AS utility
      FROM preds r JOIN pool p ON p.id = r.id),
    sizes AS (SELECT cluster_id, count(*) AS n FROM joined GROUP BY 1),
    free AS (SELECT * FROM joined WHERE id NOT IN (SELECT id FROM explored)),
    local AS (SELECT cluster_id, max(utility) AS top FROM free GROUP BY 1),
    quotas AS (
      SELECT l.cluster_id,
             ceil(least(1.0, exp(-((SELECT max(mu) FROM joined) - l.top) / ((2.0 - 0.5) * exp(-1.0::double) + 0.5)))
                  * ceil({CLUSTER_BATCH} * s.n / (SELECT count(*)::double FROM joined))) AS quota
      FROM local l JOIN sizes s ON s.cluster_id = l.cluster_id),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY utility DESC, id DESC) AS r FROM free)
    SELECT ranked.id, ranked.cluster_id, utility FROM ranked
    JOIN quotas ON quotas.cluster_id = ranked.cluster_id WHERE r <= quota""",
)
def acq12(t):
    rated = acq.with_utility(predictions(t), "ucb", acq.UtilityArgs())
    rated = rated.withColumn("utility", F.round("utility", 6)).join(
        pool(t).select("id", "cluster_id"), "id"
    )
    picked = acq.acquire_cluster_batch(rated, explored(t), CLUSTER_BATCH, 1, 2.0, 0.5)
    return picked.select("id", "cluster_id", "utility")


def _cluster_rated(t: Tables):
    rated = acq.with_utility(predictions(t), "ucb", acq.UtilityArgs())
    return rated.withColumn("utility", F.round("utility", 6)).join(pool(t).select("id", "cluster_id"), "id")


CLUSTER_PICKS = f"""{BASE}, joined AS (
      SELECT r.id, r.mu, p.cluster_id, round(r.mu + 2.0 * sqrt(r.var), 6) AS utility
      FROM preds r JOIN pool p ON p.id = r.id),
    sizes AS (SELECT cluster_id, count(*) AS n FROM joined GROUP BY 1),
    free AS (SELECT * FROM joined WHERE id NOT IN (SELECT id FROM explored)),
    local AS (SELECT cluster_id, max(utility) AS top FROM free GROUP BY 1),
    quotas AS (
      SELECT l.cluster_id,
             ceil(least(1.0, exp(-((SELECT max(mu) FROM joined) - l.top) / ((2.0 - 0.5) * exp(-1.0::double) + 0.5)))
                  * ceil({CLUSTER_BATCH} * s.n / (SELECT count(*)::double FROM joined))) AS quota
      FROM local l JOIN sizes s ON s.cluster_id = l.cluster_id)"""


@query(
    "acq12_cluster_quota_with_epsilon",
    f"""{CLUSTER_PICKS}, forced AS (
      SELECT id FROM free ORDER BY {u_sql('id', 'epsilon/4')} DESC, id DESC LIMIT ceil({CLUSTER_BATCH} * 0.2)::int),
    ranked AS (
      SELECT *, id IN (SELECT id FROM forced) AS forced, row_number() OVER (
        PARTITION BY cluster_id ORDER BY id IN (SELECT id FROM forced) DESC, utility DESC, id DESC) AS r FROM free)
    SELECT ranked.id, ranked.cluster_id, forced FROM ranked
    JOIN quotas ON quotas.cluster_id = ranked.cluster_id WHERE r <= quota""",
)
def acq12_epsilon(t):
    """A fifth of the batch is drawn from all open rows and comes first in its clusters' quotas."""
    picked = acq.acquire_cluster_batch(
        _cluster_rated(t), explored(t), CLUSTER_BATCH, 1, 2.0, 0.5, epsilon=0.2, salt="4"
    )
    return picked.select("id", "cluster_id", (F.col("utility") == float("inf")).alias("forced"))


@query(
    "acq12_cluster_quota_prefiltered",
    f"""{CLUSTER_PICKS}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY utility DESC, id DESC) AS r FROM free)
    SELECT ranked.id, ranked.cluster_id, utility FROM ranked
    JOIN quotas ON quotas.cluster_id = ranked.cluster_id WHERE r <= quota""",
)
def acq12_prefiltered(t):
    """The same batch with each cluster cut at a proven utility first."""
    picked = acq.acquire_cluster_batch(
        _cluster_rated(t), explored(t), CLUSTER_BATCH, 1, 2.0, 0.5, prefilter=True
    )
    return picked.select("id", "cluster_id", "utility")


@query(
    "prj21_temperature_and_decay",
    f"""WITH {TRUTH}, {POOL}, rounds AS (
      SELECT cluster_id, max(y) AS local, (row_number() OVER (ORDER BY cluster_id) - 1)::double AS t
      FROM pool JOIN truth ON truth.id = pool.id GROUP BY cluster_id)
    SELECT cluster_id, round((10.0 - 1.0) * exp(-t) + 1.0, 6) AS temp,
           round(exp(-((SELECT max(y) FROM truth) - local) / ((10.0 - 1.0) * exp(-t) + 1.0)), 6) AS lam
    FROM rounds""",
)
def prj21(t):
    truth = oracle(t)
    local = pool(t).join(truth, "id").groupBy("cluster_id").agg(F.max("y").alias("local"))
    rounds = number_rows(local, [F.col("cluster_id").asc()], name="t")
    temp = temperature((F.col("t") - 1).cast("double"), 10.0, 1.0)
    top = one_row(truth.agg(F.max("y").alias("top")))["top"]
    return rounds.select(
        "cluster_id",
        F.round(temp, 6).alias("temp"),
        F.round(boltzmann_decay(top, F.col("local"), temp), 6).alias("lam"),
    )


# --- joins ------------------------------------------------------------------------------------


@query("joi1_lookup_objective", f"{BASE} SELECT id, score FROM explored")
def joi1(t):
    return explored(t)


@query(
    "joi2_unexplored_rows",
    f"{BASE} SELECT id, payload, cluster_id FROM pool WHERE id NOT IN (SELECT id FROM explored)",
)
def joi2(t):
    return acq.unexplored(pool(t).select("id", "payload", "cluster_id"), explored(t))


@query(
    "joi3_pool_predictions_clusters",
    f"WITH {PREDS}, {POOL} SELECT p.id, p.cluster_id, r.mu, r.var FROM pool p JOIN preds r ON r.id = p.id",
)
def joi3(t):
    return pool(t).select("id", "cluster_id").join(predictions(t), "id")


def _colocated(t, rows, name):
    return write_colocated(rows, t.scratch(name), max(8, int(t.spark.conf.get("spark.sql.shuffle.partitions"))))


@query(
    "joi2_colocated_unexplored_rows",
    f"{BASE} SELECT id, payload, cluster_id FROM pool WHERE id NOT IN (SELECT id FROM explored)",
)
def joi2_colocated(t):
    """The pool in files by key: an anti join that moves the scored keys only."""
    return acq.unexplored(_colocated(t, pool(t).select("id", "payload", "cluster_id"), "pool"), explored(t))


@query(
    "joi3_colocated_pool_predictions_clusters",
    f"WITH {PREDS}, {POOL} SELECT p.id, p.cluster_id, r.mu, r.var FROM pool p JOIN preds r ON r.id = p.id",
)
def joi3_colocated(t):
    """Pool and predictions in files by the same key: joined file by file."""
    return _colocated(t, pool(t).select("id", "cluster_id"), "pool").join(_colocated(t, predictions(t), "preds"), "id")


TRUE_K = "true_top AS (SELECT id, y FROM truth ORDER BY y DESC, id DESC LIMIT 100)"


@query(
    "joi4_hit_test",
    f"{BASE}, {TRUE_K} SELECT id, score FROM explored WHERE id IN (SELECT id FROM true_top)",
)
def joi4(t):
    top = top_n(oracle(t), 100, "y", "id")
    return explored(t).join(top.select("id"), "id", "left_semi")


# --- top-n ------------------------------------------------------------------------------------


@query(
    "top3_initial_random_batch",
    f"""WITH {POOL}, drawn AS (
      SELECT id, row_number() OVER (ORDER BY {u_sql('id', 'init/11')} DESC, id DESC) AS r FROM pool)
    SELECT id FROM drawn WHERE r <= (SELECT ceil(count(*) * 0.05) FROM pool)""",
)
def top3(t):
    rows = pool(t).select("id")
    return acq.initial_batch(rows, math.ceil(rows.count() * 0.05), 11)


@query(
    "top3_initial_batch_large",
    f"""WITH o AS (SELECT o_orderkey AS id FROM orders), drawn AS (
      SELECT id, row_number() OVER (ORDER BY {u_sql('id', 'init/5')} DESC, id DESC) AS r FROM o)
    SELECT id FROM drawn WHERE r <= 12000""",
)
def top3_large(t):
    """More rows than the plain top-k takes: a proven cut, then range-partitioned positions."""
    return acq.initial_batch(t.orders.select(F.col("o_orderkey").alias("id")), 12_000, 5)


REPEATED = """WITH r AS (
  SELECT l_quantity AS v, l_linenumber AS k, row_number() OVER (ORDER BY l_quantity DESC, l_linenumber DESC) AS rank FROM lineitem)
  SELECT v, k, rank FROM r WHERE rank <= {n}"""


def _ranked_top(t, n, **options):
    """350 pairs of (quantity, line number) over all line items: every pair repeats many times."""
    rows = t.lineitem.select(F.col("l_quantity").alias("v"), F.col("l_linenumber").alias("k"))
    top = top_n(rows, n, "v", "k", **options)
    return number_rows(top, [F.col("v").desc(), F.col("k").desc()], name="rank")


@query("top2_repeated_pairs_small", REPEATED.format(n=900))
def top2_repeated_small(t):
    return _ranked_top(t, 900)


@query("top2_repeated_pairs_large", REPEATED.format(n=5000))
def top2_repeated_large(t):
    """Beyond Spark's own top-k: exactly n rows of repeated pairs, the bracket's rows in one task."""
    return _ranked_top(t, 5000)


@query("top2_repeated_pairs_ranged", REPEATED.format(n=5000))
def top2_repeated_ranged(t):
    """The same with the bracket's rows in range partitions, as when they are many."""
    return _ranked_top(t, 5000, gather=0)


@query(
    "top2_stated_order_large",
    """SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS pos
       FROM orders QUALIFY pos <= 3000""",
)
def top2_order(t):
    """A large cut comes best first: the position as it stands in the result."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    top = top_n(rows, 3000, "v", "id").withColumn("_at", F.monotonically_increasing_id())
    # Partitions of a sorted result follow each other, so ids that rise with them keep its order.
    return number_rows(top, [F.col("_at").asc()], name="pos").select("id", "pos")


RATED = f"""{BASE}, {BEST}, {Z_ROWS}, scored AS (SELECT id, round({EI}, 6) AS utility FROM rated),
  free AS (SELECT * FROM scored WHERE id NOT IN (SELECT id FROM explored))"""


def _rated(t: Tables):
    return _utility(t, "ei", best=_best(t)).withColumn("mu", F.col("utility"))


@query(
    "top4_acquire_batch",
    f"{RATED} SELECT id, utility FROM free ORDER BY utility DESC, id DESC LIMIT 20",
)
def top4(t):
    return acq.acquire_batch(_rated(t), explored(t), 20)


@query(
    "top4_acquire_batch_prefiltered",
    f"{RATED} SELECT id, utility FROM free ORDER BY utility DESC, id DESC LIMIT 20",
)
def top4_prefiltered(t):
    """The same batch, with the utility cut that keeps the pool out of the anti join."""
    return acq.acquire_batch(_rated(t), explored(t), 20, prefilter_from=1)


@query(
    "top5_random_share",
    f"""{RATED}, forced AS (
      SELECT id FROM free ORDER BY {u_sql('id', 'epsilon/9')} DESC, id DESC LIMIT 5),
    lifted AS (SELECT id, id IN (SELECT id FROM forced) AS forced, utility FROM free)
    SELECT id, forced, CASE WHEN forced THEN NULL ELSE utility END AS utility
    FROM lifted ORDER BY forced DESC, lifted.utility DESC, id DESC LIMIT 20""",
)
def top5(t):
    picked = acq.acquire_batch(
        _rated(t), explored(t), 20, args=acq.UtilityArgs(salt="9"), epsilon=0.25
    )
    forced = F.col("utility") == float("inf")
    return picked.select("id", forced.alias("forced"), F.when(~forced, F.col("utility")).alias("utility"))


@query(
    "top6_true_top_k",
    """SELECT s_suppkey AS id, -s_acctbal AS y FROM supplier ORDER BY y DESC, id DESC LIMIT 25""",
)
def top6(t):
    signed = t.supplier.select(F.col("s_suppkey").alias("id"), (-F.col("s_acctbal")).alias("y"))
    return top_n(signed, 25, "y", "id")


@query(
    "top2_best_predicted",
    f"WITH {PREDS} SELECT id, mu FROM preds ORDER BY mu DESC, id DESC LIMIT 50",
)
def top2(t):
    return top_n(predictions(t).select("id", "mu"), 50, "mu", "id")


@query(
    "win8_cluster_quota_sample",
    f"""WITH {POOL}, sizes AS (SELECT cluster_id, count(*) AS n FROM pool GROUP BY 1),
    drawn AS (
      SELECT id, cluster_id,
             row_number() OVER (PARTITION BY cluster_id ORDER BY {u_sql('id', 'init/3')} DESC, id DESC) AS r
      FROM pool)
    SELECT d.id, d.cluster_id FROM drawn d JOIN sizes s ON s.cluster_id = d.cluster_id
    WHERE r <= ceil(100 * s.n / (SELECT count(*)::double FROM pool))""",
)
def win8(t):
    return acq.initial_cluster_batch(pool(t).select("id", "cluster_id"), 100, 3)


@query(
    "win8_cluster_quota_prefiltered",
    f"""WITH {POOL}, sizes AS (SELECT cluster_id, count(*) AS n FROM pool GROUP BY 1),
    drawn AS (
      SELECT id, cluster_id,
             row_number() OVER (PARTITION BY cluster_id ORDER BY {u_sql('id', 'init/3')} DESC, id DESC) AS r
      FROM pool)
    SELECT d.id, d.cluster_id FROM drawn d JOIN sizes s ON s.cluster_id = d.cluster_id
    WHERE r <= ceil(100 * s.n / (SELECT count(*)::double FROM pool))""",
)
def win8_prefiltered(t):
    """The same sample with each cluster cut at a proven quantile before rows are put in order."""
    rows = pool(t).select("id", "cluster_id").withColumn("_u", hash_uniform(F.col("id"), "init/3"))
    quotas = acq.cluster_quotas(rows, 100)
    return top_quota(rows, quotas, "cluster_id", "_u", "id", prefilter=True).select("id", "cluster_id")


@query(
    "top5_random_share_prefiltered",
    f"""{RATED}, forced AS (
      SELECT id FROM free ORDER BY {u_sql('id', 'epsilon/9')} DESC, id DESC LIMIT 5),
    lifted AS (SELECT id, id IN (SELECT id FROM forced) AS forced, utility FROM free)
    SELECT id, forced, CASE WHEN forced THEN NULL ELSE utility END AS utility
    FROM lifted ORDER BY forced DESC, lifted.utility DESC, id DESC LIMIT 20""",
)
def top5_prefiltered(t):
    """A drawn share with the cuts of utility and draw before the anti join."""
    picked = acq.acquire_batch(
        _rated(t), explored(t), 20, args=acq.UtilityArgs(salt="9"), epsilon=0.25, prefilter_from=1
    )
    forced = F.col("utility") == float("inf")
    return picked.select("id", forced.alias("forced"), F.when(~forced, F.col("utility")).alias("utility"))


@query("agg6_cluster_sizes", f"WITH {POOL} SELECT cluster_id, count(*) AS cluster_size FROM pool GROUP BY 1")
def agg6(t):
    return acq.cluster_sizes(pool(t))


@query("agg8_mean_spread", f"WITH {PREDS} SELECT round(stddev_pop(mu), 6) AS spread FROM preds")
def agg8(t):
    return acq.mean_spread(predictions(t)).select(F.round("spread", 6).alias("spread"))


@query(
    "eva5_retrieval_rate",
    f"""{BASE}, {TRUE_K}, best AS (
      SELECT id FROM explored ORDER BY score DESC NULLS LAST, id DESC LIMIT 100)
    SELECT round(count(*) FILTER (WHERE id IN (SELECT id FROM true_top)) / least(count(*), 100)::double, 6) AS rate
    FROM best""",
)
def eva5(t):
    best = top_explored(explored(t), 100)
    rate = acq.retrieval_rate(best, top_n(oracle(t), 100, "y", "id"), 100)
    return rate.select(F.round("rate", 6).alias("rate"))


FLAGSHIP = f"""{RATED}, {TRUE_K}, batch AS (
    SELECT id, utility FROM free ORDER BY utility DESC, id DESC LIMIT 20),
  next AS (
    SELECT e.id FROM (SELECT id, score FROM explored
      UNION ALL SELECT b.id, o.y FROM batch b LEFT JOIN truth o ON o.id = b.id) e
    ORDER BY e.score DESC NULLS LAST, e.id DESC LIMIT 100)
  SELECT b.id, b.utility, o.y AS score,
         round((SELECT count(*) FILTER (WHERE id IN (SELECT id FROM true_top)) / least(count(*), 100)::double
                FROM next), 6) AS rate
  FROM batch b LEFT JOIN truth o ON o.id = b.id"""


@query("flagship_one_round", FLAGSHIP)
def flagship(t):
    """One whole round: predictions, best so far, utility, batch, its scores, retrieval rate.

    The line items are read once: predictions and true scores are one aggregate, written narrow, and so
    are the explored rows.
    """
    price = F.log("l_extendedprice")
    per_part = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(
        F.round(F.avg(price), 6).alias("mu"),
        F.round(F.var_pop(price), 6).alias("var"),
        F.round(F.log(F.max("l_extendedprice")), 6).alias("y"),
    )
    per_part = pinned(per_part, "per-part")
    truth = per_part.select("id", "y")
    ids = pinned(t.part.select(F.col("p_partkey").alias("id")), "pool")
    n = math.ceil(ids.count() * 0.01)
    scored = pinned(lookup_scores(acq.initial_batch(ids, n, "s"), truth, True, n), "explored")
    best = one_row(kth_best(scored, K))["kth_best"]
    rated = acq.with_utility(per_part.select("id", "mu", "var"), "ei", acq.UtilityArgs(salt="7", best=best))
    rated = rated.select("id", F.round("utility", 6).alias("mu"))
    batch = pinned(acq.acquire_batch(rated, scored, 20), "batch")
    result = batch.join(lookup_scores(batch.select("id"), truth, True, 20), "id", "left")
    top = top_explored(scored.unionByName(result.select("id", "score")), 100)
    rate = one_row(acq.retrieval_rate(top, top_n(truth, 100, "y", "id"), 100))["rate"]
    return result.withColumn("rate", F.round(rate, 6))


@query(
    "top9_best_rows_with_coordinates",
    """SELECT vec_id AS id, round(embedding[1]::double, 6) AS x, round(embedding[2]::double, 6) AS y,
              round(embedding[3]::double, 6) AS score
       FROM embeddings ORDER BY embedding[3] ASC, vec_id DESC LIMIT 100""",
)
def top9(t):
    """The best (lowest) scores with their coordinates, joined by key after the cut."""
    e = F.col("embedding")
    scores = t.embeddings.select(F.col("vec_id").alias("id"), e[2].cast("double").alias("score"))
    places = t.embeddings.select(
        F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y")
    )
    best = top_n(scores.withColumn("_v", -F.col("score")), 100, "_v", "id").drop("_v")
    return best.join(places, "id").select(
        "id", *[F.round(c, 6).alias(c) for c in ("x", "y", "score")]
    )


@query(
    "top7_best_at_round",
    f"""WITH {RUNS}, mid AS (SELECT max(iter) // 2 AS i FROM runs), ranked AS (
      SELECT run_id, id, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id DESC) AS r
      FROM runs WHERE iter <= (SELECT i FROM mid))
    SELECT run_id, id, score FROM ranked WHERE r <= 25""",
)
def top7(t):
    from activepool.operators.evaluate import best_found

    from .registry import median_iter

    return best_found(runs(t), median_iter(t), 25).select("run_id", "id", "score")
