"""Clusters, projections, surrogates and user extension points."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from activepool.functions import hash_uniform
from activepool.functions.tokens import WORDS
from activepool.operators import acquisition as acq
from activepool.operators.features import (
    as_vector,
    assign_centres,
    cluster_centres,
    components,
    hashed_vectors,
    mini_batch_centres,
    project,
)
from activepool.operators.pool import make_pool
from activepool.plans.objective import FunctionObjective, LookupObjective, build_objective
from activepool.session import one_row, spread
from activepool.surrogates import (
    BatchFunctionSurrogate,
    LinearGaussianSurrogate,
    build_model,
    training_rows,
)

from .registry import BASE, PREDS, oracle, pool, predictions, query, u_sql


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


def vector_truth(t):
    """A score that the features explain in part."""
    e = F.col("embedding")
    value = e[0] * 3 - e[1] * 2 + e[2] * e[3] + F.col("label") / 10
    return t.embeddings.select(F.col("vec_id").alias("id"), F.round(value.cast("double"), 6).alias("y"))


def scored_vectors(t, share=0.2):
    rows = vectors(t).select("id")
    n = math.ceil(rows.count() * share)
    batch = acq.initial_batch(rows, n, "fit")
    return LookupObjective(vector_truth(t)).score(batch, n).withColumn("iter", F.lit(0))


def _fitted(t, name, **options):
    rows = training_rows(vectors(t), scored_vectors(t), retrain=True)
    return build_model(name, **options).fit(rows)


def _rounded(df):
    return df.select("id", *[F.round(c, 6).alias(c) for c in df.columns if c != "id"])


@query("mlp5_cluster_assignment", "SELECT vec_id AS id, true AS nearest FROM embeddings")
def mlp5(t):
    """100 k-means centres of all rows; each row's assigned centre is the nearest of them."""
    rows = vectors(t)
    model = cluster_centres(rows, k=100, seed=1)
    assigned = model.transform(as_vector(rows)).select("id", "features", "cluster_id")
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])

    def distance(c):
        gap = F.zip_with(F.col("features").cast("array<double>"), c, lambda a, b: (a - b) * (a - b))
        return F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)

    far = assigned.withColumn("_d", F.transform(centres, distance))
    own = F.get("_d", F.col("cluster_id"))
    return far.select("id", (own <= F.array_min("_d") * (1 + 1e-9) + 1e-9).alias("nearest"))


def _mini_batch_sql(k=5, size=256, count=3) -> str:
    """The same batches and steps, a query for each step."""
    steps = ""
    for b in range(count):
        steps += f"""
  near{b} AS (
    SELECT b.id, any_value(b.x) AS x, arg_max(c.c, list_inner_product(b.x, c.x) - list_inner_product(c.x, c.x) / 2) AS c
    FROM batches b, c{b} c WHERE b.batch = {b} GROUP BY b.id),
  mean{b} AS (
    SELECT c, max(n) AS n, list(m ORDER BY i) AS m FROM (
      SELECT c, i, count(*) AS n, avg(x[i]) AS m FROM near{b}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c),
  c{b + 1} AS (
    SELECT c.c, c.taken + coalesce(n, 0) AS taken, CASE WHEN n IS NULL THEN c.x
        ELSE list_transform(list_zip(c.x, m.m), lambda z: z[1] + n / (c.taken + n)::double * (z[2] - z[1])) END AS x
    FROM c{b} c LEFT JOIN mean{b} m ON m.c = c.c),"""
    return f"""WITH v AS (SELECT vec_id AS id, embedding::double[] AS x FROM embeddings),
  dealt AS (SELECT greatest(count(*) // {size}, 1) AS d FROM v),
  batches AS (
    SELECT * FROM (SELECT id, x, e * d + floor({u_sql('id', "batch/1/' || e || '")} * d) AS batch FROM v, dealt, range({count}) r(e)
      WHERE e < ceil({count} / d::double)) WHERE batch < {count}),
  c0 AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY {u_sql('id', 'centre/1')} DESC, id DESC) - 1 AS c, x, 0 AS taken FROM v) WHERE c < {k}),{steps}
  own AS (
    SELECT v.id, arg_max(c.c, list_inner_product(v.x, c.x) - list_inner_product(c.x, c.x) / 2) AS c FROM v, c{count} c GROUP BY v.id)
  SELECT id, own.c::int AS cluster_id, round(c.x[1], 6) AS first, round(c.x[64], 6) AS last FROM own JOIN c{count} c ON c.c = own.c"""


@query("mlp5_mini_batch_clusters", _mini_batch_sql())
def mlp5_mini_batch(t):
    """Centres after three mini-batches, and every row's nearest of them."""
    centres = mini_batch_centres(vectors(t), k=5, seed=1, size=256, count=3, group=1)
    ends = t.spark.createDataFrame([(c, float(x[0]), float(x[-1])) for c, x in enumerate(centres)], "cluster_id int, first double, last double")
    rows = assign_centres(vectors(t), centres).join(F.broadcast(ends), "cluster_id")  # one row a centre
    return rows.select("id", "cluster_id", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"))


def _tree_facts(t, name, **options):
    """Mean of the model, mean over its trees walked one by one, variance over them."""
    model = _fitted(t, name, **options)
    both = model.predict(vectors(t)).join(
        model.predict(vectors(t), need_var=False).withColumnRenamed("mu", "mean"), "id"
    )
    return both, model


@query(
    "mlp6_random_forest",
    "SELECT vec_id AS id, true AS mean_of_trees, true AS sound, true AS in_range FROM embeddings",
)
def mlp6(t):
    """A forest of 100 trees: its mean is that of its trees and stays within the scores it saw."""
    both, _ = _tree_facts(t, "rf", n_estimators=100, max_depth=8, seed=1)
    seen = one_row(scored_vectors(t).agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    return both.select(
        "id",
        (F.abs(F.col("mu") - F.col("mean")) < 1e-6).alias("mean_of_trees"),
        (F.col("var") >= 0).alias("sound"),
        F.col("mu").between(seen["lo"] - 1e-6, seen["hi"] + 1e-6).alias("in_range"),
    )


@query(
    "mlp7_boosted_trees",
    "SELECT vec_id AS id, true AS sum_of_trees, true AS sound FROM embeddings",
)
def mlp7(t):
    """100 boosted trees: the walk over the trees gives the model's own prediction."""
    both, _ = _tree_facts(t, "gbt", n_estimators=100, max_depth=4, seed=1)
    return both.select(
        "id", (F.abs(F.col("mu") - F.col("mean")) < 1e-6).alias("sum_of_trees"), (F.col("var") >= 0).alias("sound")
    )


def _two(t):
    """The first two coordinates: few enough features for the normal equations to be written out."""
    e = F.col("embedding")
    return t.embeddings.select(F.col("vec_id").alias("id"), F.array(e[0], e[1]).alias("features"))


ALPHA = 0.01
# Normal equations of the weight-space process on (1, a, b): P = Z'Z / alpha + I, w = P^-1 Z'(y - mean) / (std alpha).
NORMAL = f"""WITH x AS (
    SELECT vec_id AS id, embedding[1]::double AS a, embedding[2]::double AS b,
      round((embedding[1] * 3 - embedding[2] * 2 + embedding[3] * embedding[4] + label / 10.0::double)::double, 6) AS y FROM embeddings),
  chosen AS (
    SELECT * FROM x QUALIFY row_number() OVER (ORDER BY {u_sql('id', 'init/fit')} DESC, id DESC)
      <= (SELECT ceil(count(*) * 0.2) FROM embeddings)),
  m AS (SELECT count(*)::double AS n, avg(y) AS mean, stddev_pop(y) AS std FROM chosen),
  g AS (
    SELECT max(n) / {ALPHA}::double + 1 AS p11, sum(a) / {ALPHA}::double AS p12, sum(b) / {ALPHA}::double AS p13,
      sum(a * a) / {ALPHA}::double + 1 AS p22, sum(a * b) / {ALPHA}::double AS p23, sum(b * b) / {ALPHA}::double + 1 AS p33,
      sum(y - mean) / max(std) / {ALPHA}::double AS q1, sum(a * (y - mean)) / max(std) / {ALPHA}::double AS q2,
      sum(b * (y - mean)) / max(std) / {ALPHA}::double AS q3 FROM chosen, m),
  adj AS (
    SELECT *, p22 * p33 - p23 * p23 AS c11, p13 * p23 - p12 * p33 AS c12, p12 * p23 - p13 * p22 AS c13,
      p11 * p33 - p13 * p13 AS c22, p12 * p13 - p11 * p23 AS c23, p11 * p22 - p12 * p12 AS c33 FROM g),
  inv AS (SELECT *, p11 * c11 + p12 * c12 + p13 * c13 AS det FROM adj),
  pred AS (
    SELECT x.id,
      ((c11 * q1 + c12 * q2 + c13 * q3) + a * (c12 * q1 + c22 * q2 + c23 * q3) + b * (c13 * q1 + c23 * q2 + c33 * q3)) / det * std + mean AS mu,
      (c11 + a * a * c22 + b * b * c33 + 2 * (a * c12 + b * c13 + a * b * c23)) / det * std * std AS var
    FROM x, inv, m)"""


@query("mlp8_linear_gaussian_process", f"{NORMAL} SELECT id, round(mu, 5) AS mu, round(var, 7) AS var FROM pred")
def mlp8(t):
    """Mean and variance of the process beside its normal equations, written out for two features."""
    rows = training_rows(_two(t), scored_vectors(t), retrain=True)
    out = build_model("gp", alpha=ALPHA).fit(rows).predict(_two(t))
    return out.select("id", F.round("mu", 5).alias("mu"), F.round("var", 7).alias("var"))


@query("mlp8_all_features", "SELECT i::int AS i, true AS solved FROM range(65) r(i)")
def mlp8_all(t):
    """All 64 features: the fitted weights solve each of their normal equations."""
    import numpy as np

    model = _fitted(t, "gp", alpha=ALPHA)
    gram = model.gram
    residual = (gram[:-1, :-1] / ALPHA + np.eye(len(gram) - 1)) @ model.weights
    residual -= (gram[:-1, -1] - model.mean * gram[0, :-1] / model.sigma0) / model.std / ALPHA
    scale = np.abs(gram[:-1, :-1]).max() / ALPHA
    gaps = [(i, float(r)) for i, r in enumerate(residual / scale)]
    return t.spark.createDataFrame(gaps, "i int, gap double").select("i", (F.abs("gap") < 1e-9).alias("solved"))


EVIDENCE_GRID = [(a, s) for a in (0.01, 0.1, 1.0, 10.0) for s in (0.1, 1.0, 10.0)]
# Of n normal scores with covariance alpha I + Z Z', Z = (sigma0, a, b): the 3 x 3 matrix taken apart into triangles.
EVIDENCE = f"""{NORMAL.split("  g AS (")[0].rstrip().rstrip(",")},
  s AS (
    SELECT max(n) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum((y - mean) ** 2) / max(std) ** 2 AS tt,
      sum(a * (y - mean)) / max(std) AS ca, sum(b * (y - mean)) / max(std) AS cb FROM chosen, m),
  w AS (
    SELECT alpha, sigma0, n, tt, ca, cb, sigma0 ** 2 * n + alpha AS m11, sigma0 * sa AS m12, sigma0 * sb AS m13, aa + alpha AS m22, ab AS m23,
      bb + alpha AS m33 FROM s, (VALUES {", ".join(f"({a}::double, {v}::double)" for a, v in EVIDENCE_GRID)}) grid(alpha, sigma0)),
  l1 AS (SELECT *, sqrt(m11) AS a11, m12 / sqrt(m11) AS a21, m13 / sqrt(m11) AS a31 FROM w),
  l2 AS (SELECT *, sqrt(m22 - a21 * a21) AS a22, (m23 - a31 * a21) / sqrt(m22 - a21 * a21) AS a32 FROM l1),
  l3 AS (SELECT *, sqrt(m33 - a31 * a31 - a32 * a32) AS a33 FROM l2),
  z AS (SELECT *, ca / a22 AS z2, (cb - a32 * ca / a22) / a33 AS z3 FROM l3)
  SELECT alpha, sigma0, round(-0.5 * ((tt - z2 * z2 - z3 * z3) / alpha + (n - 3) * ln(alpha) + 2 * (ln(a11) + ln(a22) + ln(a33))
      + n * ln(2 * pi())), 1) AS evidence FROM z"""


@query("mlp8_log_evidence", EVIDENCE)
def mlp8_evidence(t):
    """Log marginal likelihood over a grid of noise variances and bias scales, beside the matrix written out.

    Scores are rounded to 1e-6 on both sides, where a tie may fall either way: that moves the third decimal, so one is shown.
    """
    rows = training_rows(_two(t), scored_vectors(t), retrain=True)
    evidence = build_model("gp", alpha=ALPHA).fit(rows).evidence()
    found = [(a, s, float(evidence(a, s))) for a, s in EVIDENCE_GRID]
    return t.spark.createDataFrame(found, "alpha double, sigma0 double, evidence double").withColumn("evidence", F.round("evidence", 1))


RANDOM_MODEL = f"""SELECT vec_id AS id, round({u_sql('vec_id', 'mean/5')}, 9) AS mu,
  round({u_sql('vec_id', 'var/5')}, 9) AS var FROM embeddings"""


@query("mlp9_random_model", RANDOM_MODEL)
def mlp9(t):
    preds = build_model("random", seed=5).predict(vectors(t))
    return preds.select("id", *[F.round(c, 9).alias(c) for c in ("mu", "var")])


@query(
    "mlp10_online_and_retrained_fit",
    f"{NORMAL} SELECT id, round(mu, 5) AS mu, round(mu, 5) AS mu_online FROM pred",
)
def mlp10(t):
    """The linear model fitted in two online steps and in one go gives the written-out means."""
    scores = scored_vectors(t).withColumn(
        "iter", (hash_uniform(F.col("id"), "half") < 0.5).cast("int")
    )
    once = LinearGaussianSurrogate(alpha=ALPHA).fit(training_rows(_two(t), scores, retrain=True))
    steps = LinearGaussianSurrogate(alpha=ALPHA).fit(training_rows(_two(t), scores, False, last_iter=0))
    steps.fit(training_rows(_two(t), scores, False, last_iter=1), online=True)
    both = once.predict(_two(t), need_var=False).join(
        steps.predict(_two(t), need_var=False).withColumnRenamed("mu", "mu_online"), "id"
    )
    return both.select("id", *[F.round(c, 5).alias(c) for c in ("mu", "mu_online")])


@query("mlp10_online_fit_of_all_features", "SELECT vec_id AS id, true AS same FROM embeddings")
def mlp10_all(t):
    """All 64 features: two online steps and one fit over all rows predict the same."""
    scores = scored_vectors(t).withColumn("iter", (hash_uniform(F.col("id"), "half") < 0.5).cast("int"))
    once = LinearGaussianSurrogate(alpha=ALPHA).fit(training_rows(vectors(t), scores, retrain=True))
    steps = LinearGaussianSurrogate(alpha=ALPHA).fit(training_rows(vectors(t), scores, False, last_iter=0))
    steps.fit(training_rows(vectors(t), scores, False, last_iter=1), online=True)
    both = once.predict(vectors(t)).join(
        steps.predict(vectors(t)).select("id", F.col("mu").alias("mu_online"), F.col("var").alias("var_online")), "id"
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-8
    return both.select("id", (near("mu", "mu_online") & near("var", "var_online")).alias("same"))


@query("mlp11_mean_only_prediction", "SELECT vec_id AS id, 'id,mu' AS columns, true AS same FROM embeddings")
def mlp11(t):
    """Greedy needs no variance: only the mean is planned, and it is that of the full prediction."""
    model = _fitted(t, "rf", n_estimators=100, max_depth=8, seed=2)
    only = model.predict(vectors(t), "vars" in acq.metric_needs("greedy"))
    columns = ",".join(only.columns)
    both = only.join(model.predict(vectors(t)).select("id", F.col("mu").alias("full")), "id")
    return both.select("id", F.lit(columns).alias("columns"), (F.abs(F.col("mu") - F.col("full")) < 1e-6).alias("same"))


@query(
    "mlp12_vector_export",
    """SELECT vec_id AS id, round(list_sum(list_transform(embedding[1:8], lambda x: x::double)), 4) AS v0,
              round(list_max(embedding)::double, 4) AS v1 FROM embeddings""",
)
def mlp12(t):
    """An embedding column from a user's network, in batches."""

    def make_predict():
        import numpy as np

        def predict(x):
            return np.stack([x[:, :8].astype("float64").sum(axis=1), x.max(axis=1)], axis=1)

        return predict

    out = BatchFunctionSurrogate(make_predict, width=64).predict(vectors(t))
    return out.select("id", F.round("mu", 4).alias("v0"), F.round("var", 4).alias("v1"))


@query(
    "mlp13_projection",
    """WITH e AS (SELECT unnest(embedding)::double AS v, unnest(range(1, 65)) AS i, vec_id FROM embeddings),
    m AS (SELECT i, avg(v) AS mean, var_samp(v) AS spread FROM e GROUP BY 1)
    SELECT true AS orthogonal, true AS unit, true AS uncorrelated, true AS ordered, true AS largest,
           round((SELECT sum(spread) FROM m), 4) AS total""",
)
def mlp13(t):
    """Two components of all rows: orthogonal, of unit length, uncorrelated, in order, and beyond any column."""
    rows = vectors(t)
    model = components(rows)
    pc = model.pc.toArray()
    xy = project(rows)
    facts = xy.agg(F.corr("x", "y").alias("r"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
    flat = rows.select("id", F.posexplode(F.col("features").cast("array<double>")).alias("i", "v"))
    columns = flat.groupBy("i").agg(F.var_samp("v").alias("s")).agg(F.sum("s").alias("total"), F.max("s").alias("most"))
    both = one_row(columns)
    return facts.select(
        F.lit(bool(abs(pc[:, 0] @ pc[:, 1]) < 1e-9)).alias("orthogonal"),
        F.lit(bool(abs((pc**2).sum(axis=0) - 1).max() < 1e-9)).alias("unit"),
        (F.abs("r") < 1e-6).alias("uncorrelated"),
        (F.col("vx") >= F.col("vy")).alias("ordered"),
        (F.col("vx") >= both["most"] - 1e-9).alias("largest"),
        F.round(both["total"], 4).alias("total"),
    )


# --- extension points -------------------------------------------------------------------------


@query(
    "udf1_objectives",
    f"""{BASE}, b AS (SELECT id, payload FROM pool WHERE id IN (SELECT id FROM explored))
    SELECT id, -length(payload)::double AS score, 'function' AS kind FROM b WHERE payload NOT LIKE 'red%'
    UNION ALL SELECT id, NULL, 'function' FROM b WHERE payload LIKE 'red%'
    UNION ALL SELECT id, -y, 'lookup' FROM truth WHERE id IN (SELECT id FROM b)""",
)
def udf1(t):
    """A user's scoring function (errors fail the row) and the lookup, both minimised."""

    def score(payload):
        if payload.startswith("red"):
            raise ValueError("cannot score")
        return len(payload)

    n = math.ceil(t.part.count() * 0.01)
    batch = acq.initial_batch(pool(t).select("id", "payload"), n, "s")
    by_function = FunctionObjective(score, payload="payload", maximize=False).score(batch, n)
    lookup = build_objective("lookup", oracle=oracle(t), maximize=False)
    by_lookup = lookup.score(batch, n)
    return by_function.withColumn("kind", F.lit("function")).unionByName(
        by_lookup.withColumn("kind", F.lit("lookup"))
    )


@query(
    "udf2_user_model",
    """SELECT vec_id AS id, round(list_avg(list_transform(embedding, lambda x: x::double)), 5) AS mu,
              round(list_var_pop(list_transform(embedding, lambda x: x::double)), 5) AS var FROM embeddings""",
)
def udf2(t):
    def make_predict():
        import numpy as np

        def predict(x):
            x = x.astype("float64")
            return np.stack([x.mean(axis=1), x.var(axis=1)], axis=1)

        return predict

    model = BatchFunctionSurrogate(make_predict, width=64, batch_size=256)
    out = model.fit(training_rows(vectors(t), scored_vectors(t), True)).predict(vectors(t))
    return out.select("id", F.round("mu", 5).alias("mu"), F.round("var", 5).alias("var"))


@query(
    "udf3_user_featurizer",
    """SELECT p_partkey AS id, length(p_name)::int AS f0, len(string_split(p_name, ' '))::int AS f1 FROM part
       WHERE p_name NOT LIKE 'red%'""",
)
def udf3(t):
    """A vectorised user featuriser; a missing result marks the row invalid."""

    @F.pandas_udf("array<int>")
    def featurize(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n.startswith("red") else [len(n), len(n.split(" "))])

    rows = make_pool(t.part, "p_partkey", "p_name", featurize("p_name"), eager=False)
    return rows.select("id", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query(
    "udf4_registered_metric",
    f"WITH {PREDS} SELECT id, round(mu / (1 + var), 6) AS utility FROM preds",
)
def udf4(t):
    acq.register_metric("shrunk", lambda mu, var, args: mu / (var + 1), needs=("means", "vars"))
    rated = acq.with_utility(predictions(t), "shrunk", acq.UtilityArgs())
    return rated.select("id", F.round("utility", 6).alias("utility"))


@query("udf5_eager_and_lazy_pool", "SELECT doc_id AS id, true AS same FROM documents WHERE length(trim(text)) > 0")
def udf5(t):
    """The written and the computed pool hold the same features of the whole texts."""
    from activepool.functions.tokens import feature_slots

    slots = feature_slots(F.col("text"), "pair", 1, 2048, WORDS)
    documents = spread(t.documents.select("doc_id", "text"), "doc_id")
    eager = make_pool(documents, "doc_id", "text", slots, eager=True)
    lazy = make_pool(documents, "doc_id", "text", slots, eager=False)
    both = eager.join(lazy.select("id", F.col("features").alias("again")), "id")
    return both.select("id", (F.col("features") == F.col("again")).alias("same"))


@query("prj2_feature_vectors")
def prj2_vectors(t):
    """Sparse ml vectors of the word pairs (Murmur3 slots)."""
    rows = hashed_vectors(t.documents.select("doc_id", "text"), F.col("text"), "pair", 1, 1024, pattern=WORDS)
    from pyspark.ml.functions import vector_to_array

    ones = F.aggregate(vector_to_array("features_vec"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", ones.cast("int").alias("n_ones"))
