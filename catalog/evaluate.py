"""Rewards, curves and model metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from activepool.functions import hash_uniform
from activepool.operators import curves as cv, evaluate as ev
from activepool.plans import retrospect

from .registry import RUNS, TRUE_POINTS, median_iter, query, runs, true_points, u_sql

HEAD = f"WITH {RUNS}, {TRUE_POINTS}"


def _points(t):
    return runs(t).select("run_id", "seq", "id", "score")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- curves -----------------------------------------------------------------------------------

ORDERED = "(PARTITION BY run_id ORDER BY seq)"


@query(
    "win2_hit_curve_scores",
    f"""{HEAD}, low AS (SELECT min(score) AS low, count(*) AS n FROM true_top),
    m AS (SELECT count(*) AS m FROM true_top WHERE score = (SELECT low FROM low))
    SELECT run_id, row_number() OVER {ORDERED} AS n_sampled,
      round((sum((score > low)::int) OVER {ORDERED}
        + least(sum((score = low)::int) OVER {ORDERED}, m)) / n::double, 6) AS reward
    FROM runs, low, m""",
)
def win2(t):
    return _rounded(cv.hit_curve_scores(_points(t), true_points(t), block=1000), "reward")


@query(
    "win3_hit_curve_keys",
    f"""{HEAD} SELECT run_id, row_number() OVER {ORDERED} AS n_sampled,
      round(sum((id IN (SELECT id FROM true_top))::int) OVER {ORDERED} / 100.0::double, 6) AS reward FROM runs""",
)
def win3(t):
    return _rounded(cv.hit_curve_keys(_points(t), true_points(t), block=1000), "reward")


@query(
    "win4_top_average_at_rounds",
    f"""{HEAD}, bounds AS (SELECT DISTINCT run_id, iter AS b FROM runs), ranked AS (
      SELECT r.run_id, b.b, r.score, row_number() OVER (PARTITION BY r.run_id, b.b ORDER BY r.score DESC, r.id DESC) AS r
      FROM runs r JOIN bounds b ON b.run_id = r.run_id AND r.iter <= b.b)
    SELECT run_id, b::int AS iter, round(sum(score) / 25.0::double, 6) AS reward FROM ranked WHERE r <= 25 GROUP BY 1, 2""",
)
def win4(t):
    return _rounded(cv.boundary_top_average(runs(t), 25), "reward")


POINT_TOP = """failing AS (
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS p, CASE WHEN score >= 1 THEN score END AS score
    FROM runs), places AS (SELECT run_id, count(score) AS m FROM failing WHERE p <= 25 GROUP BY 1),
  ranked AS (
    SELECT b.run_id, b.p, f.score,
           row_number() OVER (PARTITION BY b.run_id, b.p ORDER BY f.score DESC) AS r
    FROM failing b JOIN failing f ON f.run_id = b.run_id AND f.p <= greatest(b.p, 25) AND f.score IS NOT NULL)"""


@query(
    "win4_top_average_per_row",
    f"""{HEAD}, {POINT_TOP}
    SELECT k.run_id, k.p AS n_sampled, round(sum(k.score) / 25.0::double, 6) AS reward
    FROM ranked k JOIN places m ON m.run_id = k.run_id WHERE k.r <= m.m GROUP BY 1, 2""",
)
def win4_per_row(t):
    """Scores below 1 count as failures here, so that empty places occur."""
    from activepool.operators.ordering import number_rows

    points = _points(t).withColumn("score", F.when(F.col("score") >= 1, F.col("score")))
    dense = number_rows(points.drop("seq"), [F.col("id").asc()], by=["run_id"], name="seq")
    return _rounded(cv.top_average_curve(dense, 25, block=500), "reward")


@query(
    "win5_running_mean",
    f"""{HEAD} SELECT run_id, row_number() OVER {ORDERED} AS n_sampled,
      round(avg(score) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS reward FROM runs""",
)
def win5(t):
    """The shift of 1e-9 keeps exact rounding ties (two-decimal scores) out of the comparison."""
    curve = cv.running_mean_curve(_points(t), block=1000)
    return curve.withColumn("reward", F.round(F.col("reward") + 1e-9, 6))


NAMES = ("small", "mid", "large")
CLASSES = """classes AS (SELECT id, CASE WHEN score >= 60 THEN 'small' WHEN score >= 40 THEN 'mid' ELSE 'large' END
  AS size_class FROM runs WHERE score >= 25)"""


def _classes(t):
    label = F.when(F.col("score") >= 60, "small").when(F.col("score") >= 40, "mid").otherwise("large")
    return runs(t).filter(F.col("score") >= 25).select("id", label.alias("size_class"))


@query(
    "win6_class_curve",
    f"""{HEAD}, {CLASSES} SELECT r.run_id, row_number() OVER w AS n_sampled, """
    + ", ".join(
        f"round(count(*) FILTER (WHERE c.size_class = '{n}') OVER w / "
        f"(SELECT count(*) FROM classes WHERE size_class = '{n}')::double, 6) AS found_{n}"
        for n in NAMES
    )
    + " FROM runs r LEFT JOIN classes c ON c.id = r.id WINDOW w AS (PARTITION BY r.run_id ORDER BY r.seq)",
)
def win6(t):
    curve = cv.class_curve(_points(t), _classes(t), NAMES, block=1000)
    return _rounded(curve, *[f"found_{n}" for n in NAMES])


@query(
    "win7_new_rows_per_round",
    f"""{HEAD} SELECT run_id, "user" AS id, min(iter)::int AS iter FROM runs GROUP BY 1, 2""",
)
def win7(t):
    return cv.first_seen(runs(t).select("run_id", F.col("user").alias("id"), "iter"))


@query(
    "joi7_new_per_round_counts",
    f"""{HEAD}, f AS (SELECT run_id, "user", min(iter) AS iter FROM runs GROUP BY 1, 2)
    SELECT run_id, iter::int AS iter, count(*) AS n_new FROM f GROUP BY 1, 2""",
)
def joi7(t):
    return retrospect.new_per_round(runs(t).select("run_id", F.col("user").alias("id"), "iter"))


# --- rewards ----------------------------------------------------------------------------------

FOUND = """mid AS (SELECT max(iter) // 2 AS i FROM runs), found AS (
  SELECT run_id, id, score FROM (
    SELECT run_id, id, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id DESC) AS r
    FROM runs WHERE iter <= (SELECT i FROM mid)) WHERE r <= 100)"""
F_AVG = "round(avg(score) / (SELECT avg(score) FROM true_top), 6) AS f_avg"
F_KEYS = "round(count(*) FILTER (WHERE id IN (SELECT id FROM true_top)) / 100.0::double, 6) AS f_keys"
VALUES = """want AS (SELECT score, count(*) AS w FROM true_top GROUP BY 1),
  have AS (SELECT run_id, score, count(*) AS h FROM found GROUP BY 1, 2),
  vals AS (SELECT h.run_id, round(sum(least(coalesce(w, 0), h)) / 100.0::double, 6) AS f_scores
           FROM have h LEFT JOIN want USING (score) GROUP BY 1)"""


def _rewards(t):
    rows = ev.rewards(runs(t), true_points(t), median_iter(t), 100)
    return _rounded(rows, "f_avg", "f_keys", "f_scores")


@query("eva1_reward_average", f"{HEAD}, {FOUND} SELECT run_id, {F_AVG} FROM found GROUP BY 1")
def eva1(t):
    return _rewards(t).select("run_id", "f_avg")


@query("eva2_reward_keys", f"{HEAD}, {FOUND} SELECT run_id, {F_KEYS} FROM found GROUP BY 1")
def eva2(t):
    return _rewards(t).select("run_id", "f_keys")


@query("eva3_reward_scores_multiset", f"{HEAD}, {FOUND}, {VALUES} SELECT run_id, f_scores FROM vals")
def eva3(t):
    return _rewards(t).select("run_id", "f_scores")


REWARD_MATRIX = f"""{HEAD}, {FOUND}, {VALUES}, a AS (SELECT run_id, {F_AVG}, {F_KEYS} FROM found GROUP BY 1)
  SELECT a.run_id, f_avg, f_keys, f_scores FROM a JOIN vals ON vals.run_id = a.run_id"""


@query("snk15_reward_matrix", REWARD_MATRIX)
def snk15(t):
    """All runs at once, against a signed oracle, written and read back."""
    oracle = runs(t).select("id", F.col("score").alias("y"))
    matrix = retrospect.reward_matrix(runs(t), oracle, median_iter(t), 100)
    path = t.scratch("rewards")
    _rounded(matrix, "f_avg", "f_keys", "f_scores").write.parquet(path)
    return t.spark.read.parquet(path)


@query(
    "eva4_class_fractions",
    f"""{HEAD}, {FOUND}, {CLASSES}, sizes AS (SELECT size_class, count(*) AS n FROM classes GROUP BY 1)
    SELECT f.run_id, c.size_class, round(count(*) / max(s.n)::double, 6) AS fraction
    FROM found f JOIN classes c ON c.id = f.id JOIN sizes s ON s.size_class = c.size_class GROUP BY 1, 2""",
)
def eva4(t):
    return _rounded(ev.class_fractions(runs(t), _classes(t), median_iter(t), 100), "fraction")


@query(
    "agg14_boltzmann_average",
    f"""WITH {RUNS} SELECT run_id, round(sum(score / 10 * exp(-score / 10)) / sum(exp(-score / 10)), 6) AS boltzmann
    FROM runs GROUP BY 1""",
)
def agg14(t):
    rows = runs(t).withColumn("x", F.col("score") / 10)
    return _rounded(ev.boltzmann_average(rows, "x", ["run_id"]), "boltzmann")


@query(
    "agg16_density_grid",
    """WITH c AS (SELECT embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings),
    e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c)
    SELECT least(floor((x - x0) / (x1 - x0) * 50.0::double), 49)::int AS bin_x,
           least(floor((y - y0) / (y1 - y0) * 50.0::double), 49)::int AS bin_y, count(*) AS n
    FROM c, e GROUP BY 1, 2""",
)
def agg16(t):
    e = F.col("embedding")
    rows = t.embeddings.select(e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))
    return ev.density_grid(rows, "x", "y")


# --- model metrics ----------------------------------------------------------------------------

LABELLED = f"""labelled AS (
  SELECT d.doc_id AS id, l.quality::double AS target, l.toxic::double AS toxic, d.lang,
         round(0.3 * coalesce(l.quality, 0) + 0.7 * {u_sql('d.doc_id', 'pred')}, 2) AS pred
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _labelled(t):
    """Targets with gaps and predictions with many ties."""
    pred = F.coalesce(F.col("quality"), F.lit(0)) * 0.3 + hash_uniform(F.col("doc_id"), "pred") * 0.7
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("double").alias("target"),
        F.col("toxic").cast("double").alias("toxic"),
        "lang",
        F.round(pred, 2).alias("pred"),
    )


KNOWN = "known AS (SELECT * FROM labelled WHERE target IS NOT NULL AND NOT isnan(target))"


@query(
    "fil6_known_targets",
    f"WITH {LABELLED} SELECT id, target, pred FROM labelled WHERE target IS NOT NULL",
)
def fil6(t):
    rows = _labelled(t).withColumn(
        "target", F.coalesce("target", F.when(F.col("lang") == "fr", F.lit(float("nan"))))
    )
    return ev._known(rows, "target", "pred").select("id", "target", "pred")


@query(
    "eva6_regression_metrics",
    """SELECT l_returnflag AS flag, round(sqrt(avg(power(p - y, 2))), 6) AS rmse, round(avg(power(p - y, 2)), 6) AS mse,
       round(avg(abs(p - y)), 6) AS mae, round(1 - sum(power(p - y, 2)) / (var_pop(y) * count(*)), 6) AS r2
       FROM (SELECT l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS p FROM lineitem) GROUP BY 1""",
)
def eva6(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("flag"),
        (F.col("l_extendedprice") / 1000).alias("target"),
        (F.col("l_quantity") * 1.5).alias("pred"),
    )
    names = ["rmse", "mse", "mae", "r2"]
    return _rounded(ev.model_metrics(rows, names, by=["flag"]), *names)


AUC = f"""tied AS (SELECT pred, count(*) FILTER (WHERE target = 1) AS tp, count(*) FILTER (WHERE target <> 1) AS fp
    FROM known GROUP BY 1),
  cum AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM tied WINDOW w AS (ORDER BY pred DESC)),
  pieces AS (SELECT *, ctp / (ctp + cfp)::double AS pr,
     CASE WHEN ctp - tp + cfp - fp = 0 THEN 1.0 ELSE (ctp - tp) / (ctp - tp + cfp - fp)::double END AS pr0 FROM cum)"""


@query(
    "eva7_ranking_metrics",
    f"""WITH {LABELLED}, {KNOWN}, {AUC}
    SELECT round(sum(fp * (ctp + ctp - tp) / 2.0::double) / (sum(tp) * sum(fp)), 6) AS roc_auc,
           round(sum(tp * (pr + pr0) / 2.0::double) / sum(tp), 6) AS prc_auc FROM pieces""",
)
def eva7(t):
    return _rounded(ev.ranking_metrics(_labelled(t)), "roc_auc", "prc_auc")


@query(
    "eva8_accuracy",
    f"WITH {LABELLED}, {KNOWN} SELECT round(avg((target = (pred > 0.5)::int)::int), 6) AS accuracy FROM known",
)
def eva8(t):
    return _rounded(ev.model_metrics(_labelled(t), ["accuracy"]), "accuracy")


SOFT = """soft AS (SELECT vec_id AS id, label,
    list_transform(embedding[1:10], lambda x: exp(x::double * 8)) AS e FROM embeddings)"""


def _soft(t):
    """Ten positive class scores per row from the first ten features."""
    e = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double") * 8))
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", e.alias("p"))


@query(
    "eva8_multiclass_accuracy",
    f"WITH {SOFT} SELECT round(avg((list_position(e, list_max(e)) - 1 = label)::int), 6) AS accuracy FROM soft",
)
def eva8_multiclass(t):
    return _rounded(ev.multiclass_accuracy(_soft(t), "label", "p"), "accuracy")


@query(
    "eva9_binary_cross_entropy",
    f"""WITH {LABELLED}, {KNOWN}
    SELECT round(-avg(target * greatest(CASE WHEN pred > 0 THEN ln(pred) ELSE -100 END, -100)
      + (1 - target) * greatest(CASE WHEN pred < 1 THEN ln(1 - pred) ELSE -100 END, -100)), 6) AS binary_cross_entropy
    FROM known""",
)
def eva9(t):
    return _rounded(ev.model_metrics(_labelled(t), ["binary_cross_entropy"]), "binary_cross_entropy")


@query(
    "eva9_cross_entropy",
    f"WITH {SOFT} SELECT round(-avg(ln(e[label + 1] / list_sum(e))), 6) AS cross_entropy FROM soft",
)
def eva9_categorical(t):
    return _rounded(ev.cross_entropy(_soft(t), "label", "p"), "cross_entropy")


@query(
    "eva10_gaussian_losses",
    """WITH r AS (SELECT l_extendedprice / 1000 AS t, l_quantity * 2 AS m, l_discount AS v, l_tax * 10 AS s FROM lineitem),
    q AS (SELECT *, greatest(v, 1e-5) AS vf, ln(1 + exp(-abs(s))) + greatest(s, 0) AS sp FROM r)
    SELECT round(avg((ln(vf) + power(m - t, 2) / vf) / 2), 4) AS nll,
           round(avg(1.8378770664093453::double / 2 + ln(sp) / 2 + power(m - t, 2) / (2 * sp)), 4) AS mve_loss FROM q""",
)
def eva10(t):
    rows = t.lineitem.select(
        (F.col("l_extendedprice") / 1000).alias("t"),
        (F.col("l_quantity") * 2).alias("m"),
        F.col("l_discount").alias("v"),
        (F.col("l_tax") * 10).alias("s"),
    )
    losses = ev.gaussian_losses(rows, "t", "m", "v", "s")
    return losses.select(*[F.round(c, 4).alias(c) for c in losses.columns])


TASKS = f"""long AS (
  SELECT 0 AS task, target, pred FROM labelled WHERE target IS NOT NULL
  UNION ALL SELECT 1, toxic, round(1 - pred, 2) FROM labelled WHERE toxic IS NOT NULL)"""


@query(
    "eva11_metrics_per_task",
    f"""WITH {LABELLED}, {TASKS},
    tied AS (SELECT task, pred, count(*) FILTER (WHERE target = 1) AS tp, count(*) FILTER (WHERE target <> 1) AS fp
             FROM long GROUP BY 1, 2),
    cum AS (SELECT *, sum(tp) OVER w AS ctp FROM tied WINDOW w AS (PARTITION BY task ORDER BY pred DESC)),
    auc AS (SELECT task, round(sum(fp * (ctp + ctp - tp) / 2.0::double) / (sum(tp) * sum(fp)), 6) AS roc_auc
            FROM cum GROUP BY 1),
    acc AS (SELECT task, round(avg((target = (pred > 0.5)::int)::int), 6) AS accuracy,
                   round(sqrt(avg(power(pred - target, 2))), 6) AS rmse FROM long GROUP BY 1)
    SELECT auc.task, roc_auc, accuracy, rmse FROM auc JOIN acc ON acc.task = auc.task""",
)
def eva11(t):
    rows = _labelled(t).select(
        F.array("target", "toxic").alias("targets"),
        F.array(F.col("pred"), F.round(F.lit(1) - F.col("pred"), 2)).alias("preds"),
    )
    long = ev.long_targets(rows)
    ranked = ev.ranking_metrics(long, by=["task"]).select("task", "roc_auc")
    plain = ev.model_metrics(long, ["accuracy", "rmse"], by=["task"])
    return _rounded(ranked.join(plain, "task"), "roc_auc", "accuracy", "rmse")


@query(
    "udf7_registered_model_metric",
    f"WITH {LABELLED}, {KNOWN} SELECT round(avg(pred - target), 6) AS bias FROM known",
)
def udf7(t):
    ev.register_model_metric("bias", lambda y, p: F.avg(p - y))
    return _rounded(ev.model_metrics(_labelled(t), ["bias"]), "bias")
