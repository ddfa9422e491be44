"""Score tables, averages, stop rules, set operations and pruning."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from activepool.functions import abbreviate_count, nan_to_null, prob_above, rank_score, safe_softplus, signed
from activepool.operators import prune as pr, scores as sc
from activepool.operators.acquisition import initial_batch
from activepool.operators.ordering import number_rows, top_n
from activepool.operators.rows import lookup_scores
from activepool.plans.extract import first_scored
from activepool.session import one_row, pinned
from activepool.surrogates import ensemble_moments
from activepool.surrogates.base import training_errors, wide_moments

from .registry import (
    BASE,
    DOC_SCORES,
    POOL,
    PREDS,
    RUNS,
    TRUTH,
    cdf_sql,
    document_scores,
    explored,
    oracle,
    pool,
    predictions,
    query,
    runs,
    u_sql,
)

K = 250
BEST_DOCS = f"best AS (SELECT id, score FROM docs ORDER BY score DESC NULLS LAST, id DESC LIMIT {K})"


def _plain(t):
    return document_scores(t).select("id", "score")


# --- projections ------------------------------------------------------------------------------


@query("prj6_objective_sign", "SELECT c_custkey AS id, -c_acctbal AS score FROM customer")
def prj6(t):
    return t.customer.select(
        F.col("c_custkey").alias("id"), signed(F.col("c_acctbal"), maximize=False).alias("score")
    )


@query(
    "prj7_nan_is_failure",
    "SELECT id, score, score IS NULL AS failed FROM (SELECT s_suppkey AS id, "
    "CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END AS score FROM supplier) "
    .replace("ln(s_acctbal)", "round(ln(s_acctbal), 6)"),
)
def prj7(t):
    """ln of a negative balance is no number: those rows failed."""
    value = F.when(F.col("s_acctbal") > 0, F.round(F.log("s_acctbal"), 6)).otherwise(F.lit(float("nan")))
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), value.alias("v"))
    return rows.select("id", nan_to_null(F.col("v")).alias("score")).withColumn(
        "failed", F.col("score").isNull()
    )


@query(
    "prj8_null_rules",
    f"""WITH {DOC_SCORES} SELECT id, coalesce(score, -1e308) AS ranked,
        coalesce(score, 0.0) AS averaged FROM docs""",
)
def prj8(t):
    ranked = rank_score(F.col("score"))
    return _plain(t).select(
        "id",
        F.greatest(ranked, F.lit(-1e308)).alias("ranked"),
        F.coalesce("score", F.lit(0.0)).alias("averaged"),
    )


@query(
    "prj13_safe_softplus",
    "SELECT c_custkey AS id, round(ln(1 + exp(-abs(c_acctbal / 100))) + greatest(c_acctbal / 100, 0), 6) AS y "
    "FROM customer",
)
def prj13(t):
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.round(safe_softplus(F.col("c_acctbal") / 100), 6).alias("y")
    )


@query(
    "prj15_probability_above",
    f"""WITH {PREDS}, z AS (SELECT id, var, mu - 10.6 AS gap, (mu - 10.6) / nullif(sqrt(var), 0) AS z FROM preds)
    SELECT id, round(CASE WHEN var = 0 THEN CASE WHEN gap > 0 THEN 1.0 WHEN gap < 0 THEN 0.0 ELSE 0.5 END
                     ELSE {cdf_sql('z')} END, 6) AS p FROM z""",
)
def prj15(t):
    return predictions(t).select("id", F.round(prob_above(F.col("mu"), F.col("var"), 10.6), 6).alias("p"))


@query(
    "prj20_abbreviated_counts",
    """SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 1e6 THEN printf('%.1fM', o_totalprice * 1e-6)
       WHEN o_totalprice >= 1e4 THEN printf('%.0fk', o_totalprice * 1e-3)
       WHEN o_totalprice >= 1e3 THEN printf('%.1fk', o_totalprice * 1e-3)
       ELSE printf('%.0f', o_totalprice) END AS label FROM orders""",
)
def prj20(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), abbreviate_count(F.col("o_totalprice")).alias("label")
    )


@query(
    "prj22_sizes_from_fractions",
    """SELECT ceil(count(*) * 0.015::double)::bigint AS batch, floor(count(*) * 0.0333::double)::bigint AS k,
       floor(count(*) * 0.25::double)::bigint AS budget FROM part""",
)
def prj22(t):
    n = t.part.count()
    sizes = (
        sc.resolve_size(0.015, n, "ceil"),
        sc.resolve_size(0.0333, n),
        sc.resolve_size(0.25, n),
    )
    return t.spark.createDataFrame([sizes], "batch bigint, k bigint, budget bigint")


@query(
    "prj23_batch_schedule",
    """WITH sizes AS (SELECT c_mktsegment, count(*) AS n, row_number() OVER (ORDER BY c_mktsegment) - 1 AS t
                      FROM customer GROUP BY 1)
       SELECT r.t::bigint AS t, s.n AS size FROM range(8) r(t)
       JOIN sizes s ON s.t = least(r.t, (SELECT max(t) FROM sizes))""",
)
def prj23(t):
    """A schedule read from a table of sizes; the last entry repeats."""
    rows = t.customer.groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()
    sizes = [r["count"] for r in rows]
    return t.spark.createDataFrame(
        [(i, sc.scheduled_size(sizes, i)) for i in range(8)], "t bigint, size bigint"
    )


# --- aggregates -------------------------------------------------------------------------------


@query(
    "agg1_top_k_average",
    f"WITH {DOC_SCORES}, {BEST_DOCS} SELECT round(sum(coalesce(score, 0)) / count(*), 6) AS top_avg FROM best",
)
def agg1(t):
    return sc.top_average(_plain(t), K).select(F.round("top_avg", 6).alias("top_avg"))


@query(
    "agg1_top_k_average_with_failures",
    f"""WITH {DOC_SCORES}, best AS (SELECT score FROM docs ORDER BY score DESC NULLS LAST, id DESC
        LIMIT (SELECT (count(*) * 0.75)::bigint FROM docs))
    SELECT round(sum(coalesce(score, 0)) / count(*), 6) AS top_avg FROM best""",
)
def agg1_failures(t):
    """k reaches into the failed rows, which count as 0."""
    scores = _plain(t)
    k = sc.resolve_size(0.75, scores.count())
    return sc.top_average(scores, k).select(F.round("top_avg", 6).alias("top_avg"))


@query(
    "agg1_progress_round_by_round",
    f"""WITH {DOC_SCORES}, rounds AS (SELECT DISTINCT iter FROM docs),
    ranked AS (SELECT r.iter, d.score, row_number() OVER (PARTITION BY r.iter ORDER BY d.score DESC NULLS LAST, d.id DESC) AS k
      FROM rounds r JOIN docs d ON d.iter <= r.iter)
    SELECT iter, round(sum(coalesce(score, 0)) / count(*), 6) AS top_avg, count(*) AS n,
      round(CASE WHEN count(*) >= {K} THEN min(coalesce(score, '-infinity'::double)) ELSE max(coalesce(score, '-infinity'::double)) END, 6) AS kth_best
    FROM ranked WHERE k <= {K} GROUP BY iter""",
)
def agg1_rounds(t):
    """Each round merges its rows into the best ones kept by the round before; no earlier score is read again."""
    rows, best, out = document_scores(t), None, None
    for it in sorted(r["iter"] for r in rows.select("iter").distinct().collect()):
        new = rows.filter(F.col("iter") == it)
        best = pinned(sc.best_rows(new, K) if best is None else sc.merge_best(best, new, K), "best")
        line = sc.progress_of(best, K).select(
            F.lit(it).alias("iter"), F.round("top_avg", 6).alias("top_avg"), "n", F.round("kth_best", 6).alias("kth_best")
        )
        out = line if out is None else out.unionByName(line)
    return out


@query("agg2_batch_average", f"WITH {DOC_SCORES} SELECT iter, round(avg(score), 6) AS batch_avg FROM docs GROUP BY 1")
def agg2(t):
    return document_scores(t).groupBy("iter").agg(F.round(F.avg("score"), 6).alias("batch_avg"))


@query(
    "agg3_kth_best",
    f"""WITH {DOC_SCORES}, {BEST_DOCS} SELECT round(CASE WHEN count(*) >= {K} THEN min(score) ELSE max(score) END, 6)
        AS kth_best FROM best""",
)
def agg3(t):
    return sc.kth_best(_plain(t), K).select(F.round("kth_best", 6).alias("kth_best"))


THRESHOLD = "cut AS (SELECT min(mu) AS v FROM (SELECT mu FROM preds ORDER BY mu DESC, id DESC LIMIT 100))"
HIT = f"""rated AS (
  SELECT id, mu, var, gap, CASE WHEN var = 0 THEN CASE WHEN gap > 0 THEN 1.0 WHEN gap < 0 THEN 0.0 ELSE 0.5 END
         ELSE {cdf_sql('z')} END AS p
  FROM (SELECT *, gap / nullif(sqrt(var), 0) AS z FROM (SELECT *, mu - (SELECT v FROM cut) AS gap FROM preds)))"""


def _threshold(t):
    return one_row(pr.prune_threshold(predictions(t), None, 100))["kth_best"]


@query("agg4_prune_threshold", f"WITH {PREDS}, {THRESHOLD} SELECT v AS kth_best FROM cut")
def agg4(t):
    return pr.prune_threshold(predictions(t), None, 100)


@query(
    "agg4_prune_threshold_observed",
    f"{BASE} SELECT min(score) AS kth_best FROM (SELECT score FROM explored ORDER BY score DESC, id DESC LIMIT 10)",
)
def agg4_observed(t):
    return pr.prune_threshold(predictions(t), explored(t), 10, observed=True)


@query(
    "agg5_expected_hits_pruned",
    f"""WITH {PREDS}, {THRESHOLD}, {HIT}
    SELECT count(*) FILTER (WHERE p >= 0.4) AS n_kept, count(*) FILTER (WHERE p < 0.4) AS n_pruned,
           round(coalesce(sum(p) FILTER (WHERE p < 0.4), 0), 6) AS expected_hits_pruned FROM rated""",
)
def agg5(t):
    return pr.expected_pruned(predictions(t), _threshold(t), 0.4).withColumn(
        "expected_hits_pruned", F.round("expected_hits_pruned", 6)
    )


@query(
    "fil4_prune_by_probability",
    f"WITH {PREDS}, {THRESHOLD}, {HIT} SELECT id, mu, var, round(p, 6) AS p_hit FROM rated WHERE p >= 0.4",
)
def fil4(t):
    return pr.prune(predictions(t), _threshold(t), 0.4).withColumn("p_hit", F.round("p_hit", 6))


@query(
    "snk7_retained_rows",
    f"WITH {PREDS}, {THRESHOLD}, {HIT} SELECT id FROM rated WHERE p >= 0.4",
)
def snk7(t):
    return pr.retained_ids(predictions(t), _threshold(t), 0.4)


@query(
    "agg7_ensemble_moments",
    """SELECT l_partkey AS id, round(avg(sqrt(l_quantity)), 6) AS mu, round(var_pop(sqrt(l_quantity)), 6) AS var
       FROM lineitem GROUP BY 1""",
)
def agg7(t):
    members = t.lineitem.select("l_partkey", F.sqrt("l_quantity").alias("member"))
    moments = ensemble_moments(members, "member", by="l_partkey")
    return moments.select(F.col("l_partkey").alias("id"), *[F.round(c, 6).alias(c) for c in ("mu", "var")])


@query(
    "agg7_ensemble_moments_wide",
    """SELECT vec_id AS id, round(list_avg(list_transform(embedding, lambda x: x::double)), 6) AS mu,
              round(list_var_pop(list_transform(embedding, lambda x: x::double)), 6) AS var FROM embeddings""",
)
def agg7_wide(t):
    members = F.transform("embedding", lambda x: x.cast("double"))
    mu, var = wide_moments(F.col("_m"))
    return t.embeddings.select(F.col("vec_id").alias("id"), members.alias("_m")).select(
        "id", F.round(mu, 6).alias("mu"), F.round(var, 6).alias("var")
    )


@query(
    "agg9_training_errors",
    f"""WITH {PREDS}, {TRUTH} SELECT round(avg(abs(mu - y)), 6) AS mae, round(avg((mu - y) * (mu - y)), 6) AS mse
    FROM preds JOIN truth ON truth.id = preds.id""",
)
def agg9(t):
    rows = oracle(t).select("id", F.col("y").alias("score"))
    return training_errors(rows, predictions(t)).select(*[F.round(c, 6).alias(c) for c in ("mae", "mse")])


@query(
    "agg13_iteration_log",
    f"""WITH {RUNS}, c AS (SELECT run_id, iter, count(*) AS n_new FROM runs GROUP BY 1, 2)
    SELECT run_id, iter::int AS iter, n_new, sum(n_new) OVER w::bigint AS n_acquired,
           first(n_new) OVER w AS init_size
    FROM c WINDOW w AS (PARTITION BY run_id ORDER BY iter)""".replace("sum(n_new) OVER w::bigint", "(sum(n_new) OVER w)::bigint"),
)
def agg13(t):
    return sc.round_sizes(runs(t))


@query(
    "agg15_last_value_per_key",
    f"""WITH {RUNS} SELECT "user" AS id, arg_max(score, seq) AS score FROM runs GROUP BY 1""",
)
def agg15(t):
    rows = runs(t).select(F.col("user").alias("id"), "score", "seq")
    return sc.last_per_key(rows, "id", "seq").select("id", "score")


@query(
    "agg15_first_row_per_key",
    f"""WITH {RUNS} SELECT "user" AS id, arg_min(run_id, seq) AS run_id, arg_min(score, seq) AS score
    FROM runs GROUP BY 1""",
)
def agg15_first(t):
    rows = runs(t).select(F.col("user").alias("id"), "run_id", "score", "seq")
    return sc.first_per_key(rows, "id", "seq").select("id", "run_id", "score")


# --- windows, stop rules ----------------------------------------------------------------------

RUN_LOG = f"""{RUNS}, daily AS (SELECT run_id, iter, avg(score) AS top_avg, count(*) AS n_new FROM runs GROUP BY 1, 2),
  logged AS (SELECT run_id, iter::int AS iter, round(top_avg, 6) AS top_avg,
                    (sum(n_new) OVER (PARTITION BY run_id ORDER BY iter))::bigint AS n_acquired FROM daily)"""


def _run_log(t):
    daily = runs(t).groupBy("run_id", "iter").agg(
        F.round(F.avg("score"), 6).alias("top_avg"), F.count(F.lit(1)).alias("n_new")
    )
    so_far = W.partitionBy("run_id").orderBy("iter")
    return daily.select(
        "run_id",
        "iter",
        "top_avg",
        F.sum("n_new").over(so_far).alias("n_acquired"),
        F.lit(20).cast("bigint").alias("n_prior"),
        F.lit(False).alias("exhausted"),
    )


SMA = """checked AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(top_avg) OVER w END AS sma FROM logged
  WINDOW w AS (PARTITION BY run_id ORDER BY iter ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query(
    "win1_convergence",
    f"""WITH {RUN_LOG}, {SMA} SELECT run_id, iter, top_avg, round(sma, 6) AS sma,
        (top_avg - sma) / sma <= 0.05 AS converged FROM checked""",
)
def win1(t):
    log = _run_log(t).select("run_id", "iter", "top_avg")
    return sc.convergence(log, 3, 0.05, by="run_id").withColumn("sma", F.round("sma", 6))


@query(
    "lop2_stop_rule",
    f"""WITH {RUN_LOG}, {SMA} SELECT run_id, iter, n_acquired,
        iter > 12 OR n_acquired - 20 >= 900 OR coalesce((top_avg - sma) / sma <= -0.01, false) AS stop
        FROM checked""",
)
def lop2(t):
    return sc.stop_rule(_run_log(t), 12, 900, 3, -0.01, by="run_id").select(
        "run_id", "iter", "n_acquired", "stop"
    )


@query(
    "win9_acquisition_position",
    f"""WITH {DOC_SCORES} SELECT id, iter, row_number() OVER (
        ORDER BY iter, score DESC NULLS LAST, id DESC) AS pos FROM docs""",
)
def win9(t):
    log = document_scores(t).withColumnRenamed("score", "utility")
    return sc.acquisition_order(log).select("id", "iter", "pos")


# --- top --------------------------------------------------------------------------------------


@query("top1_best_explored", f"WITH {DOC_SCORES}, {BEST_DOCS} SELECT id, score FROM best")
def top1(t):
    return sc.top_explored(_plain(t), K)


@query(
    "top1_best_explored_fraction",
    f"""WITH {DOC_SCORES}, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, id DESC) AS r
        FROM docs) SELECT id, score FROM r WHERE r <= (SELECT (count(*) * 0.6)::bigint FROM docs)""",
)
def top1_fraction(t):
    scores = _plain(t)
    return sc.top_explored(scores, sc.resolve_size(0.6, scores.count()))


@query(
    "top8_first_scored_rows",
    f"""WITH {DOC_SCORES}, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, id DESC) AS pos
        FROM docs) SELECT id, score, pos FROM r WHERE pos <= 600 AND score IS NOT NULL""",
)
def top8(t):
    order = [F.col("score").desc_nulls_last(), F.col("id").desc()]
    return first_scored(number_rows(_plain(t), order), 600)


# --- sets -------------------------------------------------------------------------------------


@query(
    "set1_union_of_libraries",
    "SELECT p_name AS key FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer",
)
def set1(t):
    parts = t.part.select(F.col("p_name").alias("key"))
    return parts.unionByName(t.supplier.select(F.col("s_name").alias("key"))).unionByName(
        t.customer.select(F.col("c_name").alias("key"))
    )


@query(
    "set2_upsert_scores",
    """SELECT coalesce(n.c_nationkey, o.s_nationkey) AS id, coalesce(n.score, o.score) AS score
       FROM (SELECT s_nationkey, max(s_acctbal) AS score FROM supplier GROUP BY 1) o
       FULL JOIN (SELECT c_nationkey, min(c_acctbal) AS score FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) n
       ON n.c_nationkey = o.s_nationkey""",
)
def set2(t):
    old = t.supplier.groupBy(F.col("s_nationkey").alias("id")).agg(F.max("s_acctbal").alias("score"))
    new = (
        t.customer.filter(F.col("c_mktsegment") == "MACHINERY")
        .groupBy(F.col("c_nationkey").alias("id"))
        .agg(F.min("c_acctbal").alias("score"))
    )
    return sc.upsert(old, new)


@query(
    "set3_found_and_true",
    f"""{BASE}, top AS (SELECT id FROM truth ORDER BY y DESC, id DESC LIMIT 400)
    SELECT id FROM explored INTERSECT SELECT id FROM top""",
)
def set3(t):
    return explored(t).select("id").intersect(top_n(oracle(t), 400, "y", "id").select("id"))


@query(
    "set4_multiset_difference",
    f"""WITH {RUNS} SELECT score FROM runs WHERE run_id = 'click'
    EXCEPT ALL SELECT score FROM runs WHERE run_id = 'view'""",
)
def set4(t):
    rows = runs(t)
    wanted = rows.filter(F.col("run_id") == "click").select("score")
    return sc.multiset_missing(wanted, rows.filter(F.col("run_id") == "view").select("score"))


@query(
    "set5_new_minus_seen",
    f"""WITH {RUNS} SELECT DISTINCT "user" AS id FROM runs WHERE iter = 1 AND "user" NOT IN (
        SELECT "user" FROM runs WHERE iter < 1)""",
)
def set5(t):
    rows = runs(t).select(F.col("user").alias("id"), "iter")
    seen = rows.filter(F.col("iter") < 1).select("id")
    return rows.filter(F.col("iter") == 1).select("id").distinct().join(seen, "id", "left_anti")


@query("fil5_valid_scores", f"WITH {DOC_SCORES} SELECT id, score FROM docs WHERE score IS NOT NULL")
def fil5(t):
    return _plain(t).filter(F.col("score").isNotNull())


# --- warm start and final averages ------------------------------------------------------------


@query(
    "lop3_warm_start",
    f"""{BASE}, prior AS (SELECT id, price AS score FROM pool WHERE cluster_id = 'Brand#7')
    SELECT coalesce(p.id, e.id) AS id, CASE WHEN p.id IS NULL THEN e.score ELSE p.score END AS score,
           p.id IS NOT NULL AS is_prior
    FROM explored e FULL JOIN prior p ON p.id = e.id""",
)
def lop3(t):
    prior = pool(t).filter(F.col("cluster_id") == "Brand#7")
    return sc.warm_start(explored(t), prior.select("id", F.col("price").alias("score")))


@query(
    "lop4_final_averages",
    f"""WITH {DOC_SCORES}, fr AS (SELECT unnest([0.0001, 0.0005, 0.001, 0.005])::double AS fraction),
    ks AS (SELECT fraction, floor(fraction * (SELECT count(*) FROM lineitem))::int AS k FROM fr),
    ranked AS (SELECT score, row_number() OVER (ORDER BY score DESC NULLS LAST, id DESC) AS r FROM docs)
    SELECT fraction, k, (SELECT round(sum(coalesce(score, 0)) / nullif(count(*), 0), 6) FROM ranked WHERE r <= k) AS top_avg
    FROM ks""",
)
def lop4(t):
    rows = sc.final_averages(_plain(t), t.lineitem.count())
    return rows.withColumn("top_avg", F.round("top_avg", 6))


@query(
    "joi5_coordinates_and_scores",
    """SELECT e.vec_id AS id, round(embedding[1]::double, 6) AS x, round(embedding[2]::double, 6) AS y, l.quality
       FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id""",
)
def joi5(t):
    e = F.col("embedding")
    places = t.embeddings.select(
        F.col("vec_id").alias("id"),
        F.round(e[0].cast("double"), 6).alias("x"),
        F.round(e[1].cast("double"), 6).alias("y"),
    )
    return places.join(t.labels.select(F.col("doc_id").alias("id"), "quality"), "id")


@query(
    "joi6_external_results_left_join",
    """SELECT o.o_orderkey AS id, coalesce(x.total, 0) AS score FROM orders o LEFT JOIN (
         SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x
       ON x.l_orderkey = o.o_orderkey""",
)
def joi6(t):
    results = (
        t.lineitem.filter(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))
    )
    batch = t.orders.select(F.col("o_orderkey").alias("id"))
    return lookup_scores(batch, results).select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
