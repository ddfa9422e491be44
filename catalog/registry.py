"""Registration, table access and the SQL pieces shared by many queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from activepool.functions.normal import SQRT_2PI, WEST_DENOMINATOR, WEST_NUMERATOR, WEST_SPLIT
from activepool.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.part`` reads the table ``part`` of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)


def query(name: str, sql: str | None = None):
    """Registers ``fn(t: Tables) -> DataFrame`` and its SQL."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# --- SQL for the column functions -----------------------------------------------------------------


def u_sql(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5({key}::varchar || ':{salt}'), 1, 13))::ubigint::double / 4503599627370496.0)"


def normal_sql(key: str, salt: str) -> str:
    return (
        f"(sqrt(-2.0 * ln(1.0 - {u_sql(key, salt + '/r')}))"
        f" * cos(6.283185307179586 * {u_sql(key, salt + '/t')}))"
    )


def _horner_sql(x: str, coefficients) -> str:
    acc = repr(float(coefficients[0])) + "::double"
    for c in coefficients[1:]:
        acc = f"({acc} * {x} + {float(c)!r}::double)"
    return acc


def pdf_sql(z: str) -> str:
    return f"(exp(-0.5 * {z} * {z}) / {SQRT_2PI!r}::double)"


def cdf_sql(z: str) -> str:
    x = f"abs({z})"
    bell = f"exp(-0.5 * {x} * {x})"
    near = f"({bell} * {_horner_sql(x, WEST_NUMERATOR)} / {_horner_sql(x, WEST_DENOMINATOR)})"
    fraction = f"({x} + 0.65::double)"
    for step in (4, 3, 2, 1):
        fraction = f"({x} + {step}.0::double / {fraction})"
    tail = (
        f"(case when {x} > 37 then 0.0::double when {x} < {WEST_SPLIT!r}::double then {near}"
        f" else {bell} / {fraction} / {SQRT_2PI!r}::double end)"
    )
    return f"(case when {z} > 0 then 1.0::double - {tail} else {tail} end)"


# --- shared test roles ---------------------------------------------------------------------------
# Pool: part. Predictions: mean and variance of the log prices of a part's line items.
# Explored: a 1 % seeded draw of the pool. Oracle: the part's best log price.


def predictions(t: Tables) -> DataFrame:
    price = F.log("l_extendedprice")
    return t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(
        F.round(F.avg(price), 6).alias("mu"), F.round(F.var_pop(price), 6).alias("var")
    )


PREDS = """preds AS (
  SELECT l_partkey AS id, round(avg(ln(l_extendedprice)), 6) AS mu,
         round(var_pop(ln(l_extendedprice)), 6) AS var
  FROM lineitem GROUP BY l_partkey)"""


def oracle(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(
        F.round(F.log(F.max("l_extendedprice")), 6).alias("y")
    )


TRUTH = """truth AS (
  SELECT l_partkey AS id, round(ln(max(l_extendedprice)), 6) AS y FROM lineitem GROUP BY l_partkey)"""


def pool(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("payload"),
        F.col("p_brand").alias("cluster_id"),
        F.col("p_retailprice").alias("price"),
    )


POOL = """pool AS (
  SELECT p_partkey AS id, p_name AS payload, p_brand AS cluster_id, p_retailprice AS price FROM part)"""


def explored(t: Tables) -> DataFrame:
    """Scores after the initial batch: ceil(1 %) drawn rows with their true score (may be missing)."""
    import math

    from activepool.operators.acquisition import initial_batch
    from activepool.operators.rows import lookup_scores

    n = math.ceil(t.part.count() * 0.01)
    batch = initial_batch(pool(t).select("id"), n, "s")
    return lookup_scores(batch, oracle(t), True, n)


EXPLORED = f"""explored AS (
  SELECT d.id, o.y AS score FROM (
    SELECT id, row_number() OVER (ORDER BY {u_sql('id', 'init/s')} DESC, id DESC) AS r FROM pool) d
  LEFT JOIN truth o ON o.id = d.id
  WHERE d.r <= (SELECT ceil(count(*) * 0.01) FROM part))"""

BASE = f"WITH {PREDS}, {TRUTH}, {POOL}, {EXPLORED}"


def document_scores(t: Tables) -> DataFrame:
    """Scores with failures: documents whose label is missing failed; the score is text-based."""
    return (
        t.documents.join(t.labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.when(F.col("quality").isNotNull(), F.col("n_chars") / 8.0 + F.col("quality")).alias("score"),
            F.substring("source", 4, 9).cast("int").alias("iter"),
        )
    )


DOC_SCORES = """docs AS (
  SELECT d.doc_id AS id, CASE WHEN l.quality IS NOT NULL THEN d.n_chars / 8.0::double + l.quality END AS score,
         substr(d.source, 4, 9)::int AS iter
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def runs(t: Tables) -> DataFrame:
    """Five runs (event types); rows in event order; a round is a day; ids repeat over runs."""
    return t.events.select(
        F.col("event_type").alias("run_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("iter"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("user"),
        F.col("event_id").alias("id"),
        F.col("value").alias("score"),
    )


RUNS = """runs AS (
  SELECT event_type AS run_id, date_diff('day', DATE '2024-01-01', ts::date) AS iter, event_id AS seq,
         user_id AS "user", event_id AS id, value AS score FROM events)"""


def median_iter(t: Tables) -> int:
    """A round in the middle of the runs."""
    last = runs(t).agg(F.max("iter")).first()[0]
    return last // 2


def true_points(t: Tables, k: int = 100) -> DataFrame:
    """True top k: the best values over all runs."""
    return runs(t).select("id", "score").orderBy(F.col("score").desc(), F.col("id").desc()).limit(k)


TRUE_POINTS = "true_top AS (SELECT id, score FROM runs ORDER BY score DESC, id DESC LIMIT 100)"
