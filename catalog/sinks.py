"""Writers: each query writes below the shared folder and reads its own output back."""

from __future__ import annotations

from pyspark.sql import functions as F

from activepool.functions.tokens import feature_slots
from activepool.operators import prepare as prep
from activepool.operators.ordering import number_rows
from activepool.session import spread
from activepool.sources import files
from activepool.sources.text import read_columns, read_config

from .registry import BASE, DOC_SCORES, PREDS, document_scores, explored, predictions, query


@query(
    "snk1_intermediate_scores",
    f"""WITH {DOC_SCORES} SELECT id::varchar AS id, score,
        row_number() OVER (ORDER BY id) AS pos FROM docs WHERE iter = 2""",
)
def snk1(t):
    """The rows of one round in acquisition order."""
    rows = document_scores(t).filter(F.col("iter") == 2)
    ordered = number_rows(rows, [F.col("id").asc()], name="pos")
    path = files.write_round_scores(ordered, t.scratch("run"), 2, 50)
    return files.read_ordered_scores(t.spark, path)


@query(
    "snk2_final_scores",
    f"""WITH {DOC_SCORES} SELECT id::varchar AS id, score,
        row_number() OVER (ORDER BY score DESC NULLS LAST, id DESC) AS pos FROM docs""",
)
def snk2(t):
    path = files.write_final_scores(document_scores(t).select("id", "score"), t.scratch("run"))
    return files.read_ordered_scores(t.spark, path)


@query(
    "snk3_feature_table",
    """SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS invalid FROM customer""",
)
def snk3(t):
    """Feature table of the valid rows, and the ids of the invalid ones (here: a blanked segment)."""
    name = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).otherwise(F.lit(" "))
    customers = spread(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    rows = customers.select(F.col("c_custkey").alias("id"), name.alias("text"))
    slots = feature_slots(F.col("text"), "pair", 2, 256, pattern="(.)")
    path, invalid = files.write_feature_table(rows, t.scratch("features"), slots)
    written = files.read_features(t.spark, path).filter("valid = 1").select("id", F.lit(False).alias("invalid"))
    return written.unionByName(invalid.withColumn("invalid", F.lit(True)))


@query("snk6_predictions_per_round", f"WITH {PREDS} SELECT id, mu, var, 1 AS iter FROM preds")
def snk6(t):
    path = files.write_predictions(predictions(t).withColumn("iter", F.lit(1)), t.scratch("preds"))
    return files.read_predictions(t.spark, path, 1)


@query(
    "snk8_effective_config",
    """SELECT 'pool-size' AS key, count(*)::varchar AS value FROM part
    UNION ALL SELECT 'budget', (count(*) // 4)::varchar FROM part
    UNION ALL SELECT 'batch-sizes', (SELECT '[' || string_agg(n::varchar, ', ' ORDER BY c_mktsegment) || ']'
      FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1))""",
)
def snk8(t):
    """Settings taken from table sizes; unset and false ones are left out."""
    n = t.part.count()
    sizes = [r["count"] for r in t.customer.groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()]
    settings = {
        "pool_size": n, "budget": n // 4, "batch_sizes": sizes, "retrain": False, "previous_scores": None
    }
    return read_config(t.spark, files.write_config(t.spark, settings, t.scratch("config")))


@query(
    "snk11_scoring_input",
    f"{BASE} SELECT id, 'd' || (row_number() OVER (ORDER BY id) - 1) AS ext_id FROM explored",
)
def snk11(t):
    """Generated ids for an external scorer, in key order."""
    rows = files.write_scoring_input(explored(t).select("id"), t.scratch("input"), [F.col("id").asc()])
    return rows.select(F.col("id").cast("bigint").alias("id"), "ext_id")


@query(
    "snk12_extended_results",
    "SELECT o_orderkey::varchar AS id, 'lig_' || o_orderkey AS name, o_orderpriority AS node_id FROM orders",
)
def snk12(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("lig_"), "o_orderkey").alias("name"),
        F.col("o_orderpriority").alias("node_id"),
        F.col("o_totalprice").alias("score"),
    )
    path = files.write_extended(rows, t.scratch("extended"))
    return read_columns(t.spark, path, [0, 1, 2]).toDF("id", "name", "node_id")


@query(
    "snk13_feature_save",
    "SELECT vec_id AS id, round(embedding[1]::double, 6) AS first, len(embedding) AS width FROM embeddings",
)
def snk13(t):
    path = t.scratch("features")
    t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features")).write.parquet(path)
    rows = files.read_features(t.spark, path)
    return rows.select(
        "id",
        F.round(F.col("features")[0].cast("double"), 6).alias("first"),
        F.size("features").cast("bigint").alias("width"),
    )


@query(
    "snk14_collate_runs",
    """SELECT p_brand AS target, l_linenumber AS rep,
       max(CASE WHEN l_returnflag = 'A' THEN v END) AS "full", max(CASE WHEN l_returnflag = 'R' THEN v END) AS prune
       FROM (SELECT p_brand, l_linenumber, l_returnflag, round(avg(ln(l_extendedprice)), 6) AS v
             FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2, 3)
       GROUP BY 1, 2""",
)
def snk14(t):
    """One row per target and repeat, one column per variant."""
    priced = t.lineitem.filter(F.col("l_returnflag").isin("A", "R")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")
    )
    results = priced.groupBy(
        F.col("p_brand").alias("target"),
        F.col("l_linenumber").alias("rep"),
        F.when(F.col("l_returnflag") == "A", "full").otherwise("prune").alias("variant"),
    ).agg(F.round(F.avg(F.log("l_extendedprice")), 6).alias("value"))
    return files.collate_runs(results)


SPLIT = """pos AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {u}, doc_id) AS p FROM documents),
  n AS (SELECT count(*) AS n FROM documents)"""


@query(
    "snk9_split_files",
    "WITH "
    + SPLIT.format(
        u="(('0x' || substr(md5(doc_id::varchar || ':shuffle/8'), 1, 13))::ubigint::double / 4503599627370496.0)"
    )
    + """ SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS row_index,
        CASE WHEN p <= floor(0.8::double * n) THEN 'train' WHEN p <= floor((0.8::double + 0.1::double) * n) THEN 'val' ELSE 'test' END AS split
        FROM pos, n""",
)
def snk9(t):
    """Split rows with their source row numbers, one directory per split."""
    rows = number_rows(t.documents.select("doc_id", "lang"), [F.col("doc_id").asc()], name="row_index")
    rows = rows.withColumn("row_index", F.col("row_index") - 1)
    path = files.write_splits(prep.random_split(rows, "doc_id", 8), t.scratch("splits"))
    return t.spark.read.parquet(path)


@query(
    "snk10_fit_files",
    "WITH "
    + SPLIT.format(
        u="(('0x' || substr(md5(doc_id::varchar || ':shuffle/2'), 1, 13))::ubigint::double / 4503599627370496.0)"
    )
    + """, s AS (SELECT p.doc_id, CASE WHEN p <= floor((1.0::double - 0.2::double) * n) THEN 'train' ELSE 'val' END AS split
                 FROM pos p, n)
    SELECT s.doc_id, split, round((d.n_chars - (SELECT avg(n_chars) FROM documents))
        / (SELECT stddev_pop(n_chars) FROM documents), 6) AS score
    FROM s JOIN documents d ON d.doc_id = s.doc_id""",
)
def snk10(t):
    """Training and validation rows with scaled scores."""
    rows = t.documents.select("doc_id", "n_chars")
    scaled = prep.scale(rows, prep.fit_scaler(rows, ["n_chars"]), ["n_chars"])
    split = prep.holdout_split(scaled.select("doc_id", F.round("n_chars_scaled", 6).alias("score")), "doc_id", 2, 0.2)
    path = files.write_splits(split, t.scratch("fit"))
    return t.spark.read.parquet(path)


