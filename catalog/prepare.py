"""Tokens, scaling, splits, samples and dataset accessors."""

from __future__ import annotations

from pyspark.sql import functions as F

from activepool.functions import decode_mean_var, one_hot_unknown
from activepool.functions.tokens import LINE_NOTATION, detokenize, tokenize
from activepool.operators import prepare as prep
from activepool.operators.ordering import chunk_rows, number_rows
from activepool.operators.vocabulary import build_vocabulary, encode
from activepool.session import one_row, spread

from .registry import query, u_sql

RX = LINE_NOTATION.replace("'", "''")
TOKENS = f"regexp_extract_all(text, '{RX}', 1)"


@query(
    "prj3_tokenize",
    f"""SELECT doc_id, len(tk)::int AS n_tokens, md5(array_to_string(tk, ' ')) AS digest
    FROM (SELECT doc_id, {TOKENS} AS tk FROM documents)""",
)
def prj3(t):
    """Whole texts; the digest covers every token."""
    rows = spread(t.documents, "doc_id").select("doc_id", tokenize(F.col("text")).alias("tokens"))
    return rows.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest")
    )


@query(
    "prj5_detokenize",
    f"SELECT doc_id, md5(trim(array_to_string({TOKENS}, ''))) AS digest FROM documents",
)
def prj5(t):
    return spread(t.documents, "doc_id").select("doc_id", F.md5(detokenize(tokenize(F.col("text")))).alias("digest"))


VOCAB = f"""names AS (SELECT c_custkey AS id, c_name || '/' || c_mktsegment AS text FROM customer),
  cut AS (SELECT id, {TOKENS} AS tk FROM names),
  counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(tk) AS token FROM cut) GROUP BY 1),
  vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM counts
            QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 12),
  coded AS (SELECT u.id, u.place, coalesce(v.token_id, 2) AS token_id
            FROM (SELECT id, unnest(tk) AS token, unnest(range(1, len(tk) + 1)) AS place FROM cut) u
            LEFT JOIN vocab v ON v.token = u.token),
  rows AS (SELECT c.id, len(c.tk) AS n, (SELECT max(len(tk)) FROM cut) AS longest,
             (SELECT coalesce(string_agg(token_id::varchar, ' ' ORDER BY place), '') FROM coded d WHERE d.id = c.id) AS body FROM cut c)"""


def _names(t):
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.concat_ws("/", "c_name", "c_mktsegment").alias("text")
    )


@query(
    "prj4_encode_with_padding",
    f"""WITH {VOCAB} SELECT id, '0 ' || body || ' 1' || repeat(' 2', (longest - n)::int) AS ids,
        (n + 2)::int AS mask_sum, (longest + 2)::int AS width FROM rows""",
)
def prj4(t):
    """A vocabulary of the 12 commonest tokens, so that unknown tokens occur; padded to the longest."""
    names = _names(t)
    vocabulary = build_vocabulary(names, "text").filter(F.col("token_id") < 16)
    coded = encode(names, "text", vocabulary)
    return coded.select(
        "id",
        F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"),
        F.aggregate("mask", F.lit(0), lambda a, m: a + m.cast("int")).alias("mask_sum"),
        F.size("mask").alias("width"),
    )


DOC_VOCAB = f"""counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY 1),
  vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM counts),
  flat AS (SELECT doc_id, unnest(tk) AS token, unnest(range(1, len(tk) + 1)) AS place FROM (SELECT doc_id, {TOKENS} AS tk FROM documents)),
  coded AS (SELECT f.doc_id, string_agg(v.token_id::varchar, ' ' ORDER BY place) AS body, count(*) AS n FROM flat f JOIN vocab v ON v.token = f.token GROUP BY 1)
  SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN md5('0 ' || coalesce(body || ' ', '') || '1') END AS digest,
    CASE WHEN d.text IS NOT NULL THEN coalesce(n, 0)::int + 2 END AS n FROM documents d LEFT JOIN coded c ON c.doc_id = d.doc_id
  UNION ALL SELECT -item_id, NULL, NULL FROM (SELECT row_number() OVER () AS item_id FROM benchmark)"""


def _coded_documents(t, dict_limit):
    """Every whole text with the whole vocabulary, rows without a text beside them; one key holds all rows."""
    from activepool.session import pinned

    documents = spread(t.documents.select("doc_id", "text"), "doc_id")
    rows = documents.select("doc_id", F.lit(1).alias("id"), "text")
    empty = number_rows(t.benchmark.select("item_id"), [F.col("item_id").asc()], name="n")
    rows = rows.unionByName(empty.select((-F.col("n")).alias("doc_id"), F.lit(1).alias("id"), F.lit(None).cast("string").alias("text")))
    vocabulary = pinned(build_vocabulary(documents, "text"), "vocabulary")
    coded = encode(rows, "text", vocabulary, pad_to=0, dict_limit=dict_limit)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    n = F.when(F.col("ids").isNotNull(), F.size("ids"))
    return coded.select("doc_id", F.md5(ids).alias("digest"), n.alias("n"))


@query("prj4_encode_dictionary", f"WITH {DOC_VOCAB}")
def prj4_dictionary(t):
    return _coded_documents(t, 10**7)


@query("prj4_encode_joined", f"WITH {DOC_VOCAB}")
def prj4_joined(t):
    return _coded_documents(t, 0)


# --- scaling ----------------------------------------------------------------------------------

STATS = """s AS (SELECT avg(quality) AS qm, stddev_pop(quality) AS qs, avg(n_chars) AS nm, stddev_pop(n_chars) AS ns
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _targets(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "n_chars")


@query(
    "prj9_target_scaler",
    f"""WITH {STATS} SELECT d.doc_id, round(coalesce((quality - qm) / qs, -9), 6) AS quality_scaled,
      round((n_chars - nm) / ns, 6) AS n_chars_scaled, n_chars::double AS n_chars_back
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id, s""",
)
def prj9(t):
    """Fit, transform (missing -> -9) and inverse."""
    rows = _targets(t)
    scaler = prep.fit_scaler(rows, ["quality", "n_chars"])
    scaled = prep.scale(rows, scaler, ["quality", "n_chars"], replace_nan=-9.0)
    back = prep.unscale(scaled, scaler, ["n_chars"])
    return back.select(
        "doc_id",
        *[F.round(c, 6).alias(c) for c in ("quality_scaled", "n_chars_scaled", "n_chars_back")],
    )


@query(
    "prj9_scaler_constants",
    """SELECT round(avg(ln(l_extendedprice)), 6) AS price_mean, round(stddev_pop(ln(l_extendedprice)), 6) AS price_std,
       0.0 AS none_mean, 1.0 AS none_std, 7.0 AS same_mean, 1.0 AS same_std FROM lineitem""".replace("0.0 AS", "0.0::double AS").replace("1.0 AS", "1.0::double AS").replace("7.0 AS", "7.0::double AS"),
)
def prj9_constants(t):
    """An absent column scales by (0, 1), a constant one by (value, 1)."""
    rows = t.lineitem.select(
        F.log("l_extendedprice").alias("price"),
        F.lit(None).cast("double").alias("none"),
        (F.col("l_linenumber") * 0 + 7).alias("same"),
    )
    return prep.fit_scaler(rows, ["price", "none", "same"]).select(
        *[F.round(f"{c}_{k}", 6).alias(f"{c}_{k}") for c in ("price", "none", "same") for k in ("mean", "std")]
    )


@query(
    "prj10_normalized_targets",
    """WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer)
    SELECT c_custkey, c_acctbal, round((c_acctbal - m) / d, 6) AS c_acctbal_scaled FROM customer, s""",
)
def prj10(t):
    """The raw target stays beside the scaled one, so a reset is a select."""
    rows = t.customer.select("c_custkey", "c_acctbal")
    scaled = prep.scale(rows, prep.fit_scaler(rows, ["c_acctbal"]), ["c_acctbal"])
    return scaled.withColumn("c_acctbal_scaled", F.round("c_acctbal_scaled", 6))


@query("prj11_denormalized_predictions", "SELECT o_orderkey, round(o_totalprice, 4) AS price FROM orders")
def prj11(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    scaler = prep.fit_scaler(rows, ["o_totalprice"])
    back = prep.unscale(prep.scale(rows, scaler, ["o_totalprice"]), scaler, ["o_totalprice"])
    return back.select("o_orderkey", F.round("o_totalprice_back", 4).alias("price"))


@query(
    "prj12_decode_mean_variance",
    """WITH s AS (SELECT avg(o_totalprice) / 1000 AS m, stddev_pop(o_totalprice) / 1000 AS d FROM orders)
    SELECT l_orderkey, l_linenumber, round(l_discount * d + m, 6) AS mu, round(l_tax * d * d, 6) AS var,
           round(l_quantity * d + m, 6) AS mu2 FROM lineitem, s""",
)
def prj12(t):
    price = F.col("o_totalprice")
    fit = one_row(t.orders.agg((F.avg(price) / 1000).alias("m"), (F.stddev_pop(price) / 1000).alias("d")))
    rows = t.lineitem.withColumns({"_m": fit["m"], "_d": fit["d"]})
    outputs = F.array("l_discount", "l_tax", "l_quantity")
    decoded = decode_mean_var(outputs, F.col("_m"), F.col("_d"))
    return rows.select("l_orderkey", "l_linenumber", decoded.alias("y")).select(
        "l_orderkey",
        "l_linenumber",
        *[F.round(F.col("y")[i], 6).alias(n) for i, n in enumerate(("mu", "var", "mu2"))],
    )


@query(
    "prj14_one_hot_unknown",
    """SELECT o_orderkey, (o_orderstatus = 'F')::int::varchar || (o_orderstatus = 'O')::int::varchar
         || (o_orderstatus NOT IN ('F', 'O'))::int::varchar AS code FROM orders""",
)
def prj14(t):
    code = one_hot_unknown(F.col("o_orderstatus"), ["F", "O"])
    return t.orders.select(
        "o_orderkey", F.array_join(F.transform(code, lambda v: v.cast("string")), "").alias("code")
    )


@query(
    "prj17_distribute_and_flatten",
    "SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS item FROM lineitem",
)
def prj17(t):
    rows = t.lineitem.select("l_orderkey", F.array("l_returnflag", "l_linestatus").alias("items"))
    return rows.select("l_orderkey", F.explode("items").alias("item"))


@query(
    "prj18_named_embedding_map",
    "SELECT vec_id, 'canonical_embeddings' AS name, round(embedding[1]::double, 6) AS first FROM embeddings",
)
def prj18(t):
    named = F.create_map(F.lit("canonical_embeddings"), "embedding")
    rows = t.embeddings.select("vec_id", F.explode(named).alias("name", "v"))
    return rows.select("vec_id", "name", F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@query(
    "prj19_chunks",
    """WITH sizes AS (SELECT c_mktsegment, (count(*) // 2)::bigint AS n, row_number() OVER (ORDER BY c_mktsegment) - 1 AS chunk
      FROM customer GROUP BY 1), ends AS (SELECT chunk, sum(n) OVER (ORDER BY chunk) AS e, n FROM sizes),
    r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer)
    SELECT c_custkey, coalesce((SELECT min(chunk) FROM ends WHERE pos <= e),
      (SELECT count(*) FROM sizes) + pos - (SELECT max(e) FROM ends) - 1)::bigint AS chunk FROM r""",
)
def prj19(t):
    """Half of the customers in chunks of given sizes, the rest as single chunks."""
    sizes = [r["count"] // 2 for r in t.customer.groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()]
    return chunk_rows(t.customer.select("c_custkey"), sizes, [F.col("c_custkey").asc()])


# --- dataset accessors ------------------------------------------------------------------------


def _dataset(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select(
        "doc_id",
        F.array("lang", "source").alias("inputs"),
        F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("targets"),
    )


@query(
    "prj24_dataset_shape",
    "SELECT count(*) AS n_rows, 2 AS keys_per_row, 2 AS n_tasks FROM documents",
)
def prj24(t):
    return prep.dataset_shape(_dataset(t))


@query(
    "prj24_flat_keys",
    "SELECT lang AS key FROM documents UNION ALL SELECT source FROM documents",
)
def prj24_flat(t):
    return prep.flat_keys(_dataset(t))


@query(
    "prj25_targets_by_normalized_key",
    """WITH k AS (SELECT DISTINCT p_name AS key FROM part)
    SELECT key, arg_max(p_retailprice, p_partkey) AS target, upper(key) AS model_input
    FROM part JOIN k ON k.key = p_name GROUP BY key""",
)
def prj25(t):
    measures = t.part.select(
        F.col("p_name").alias("key"), F.col("p_retailprice").alias("target"), F.col("p_partkey").alias("pos")
    )
    return prep.attach_target(measures.select("key").distinct(), measures, F.upper)


@query(
    "fil2_valid_keys",
    "SELECT conv_id, turn FROM conversations WHERE length(trim(role)) > 0 AND length(trim(text)) > 0 "
    "AND text LIKE '%the%' AND role LIKE '%s%'".replace("text LIKE '%the%' AND role LIKE '%s%'", "role LIKE '%e%' AND text LIKE '%e%'"),
)
def fil2(t):
    """Every key must be non-blank and pass the predicate (here: hold an e)."""
    rows = t.conversations.select("conv_id", "turn", F.array("role", "text").alias("inputs"))
    return prep.valid_keys(rows, predicate=lambda k: k.contains("e")).select("conv_id", "turn")


@query(
    "agg10_class_shares",
    """WITH x AS (SELECT quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT 0 AS task, count(quality) AS n, round(1 - avg(quality), 6) AS zeros, round(avg(quality), 6) AS ones FROM x
    UNION ALL SELECT 1, count(toxic), round(1 - avg(toxic), 6), round(avg(toxic), 6) FROM x""",
)
def agg10(t):
    shares = prep.class_shares(_dataset(t))
    return shares.select("task", "n", F.round("zeros", 6).alias("zeros"), F.round("ones", 6).alias("ones"))


@query(
    "agg11_target_type",
    """SELECT 'labels' AS data, bool_and(quality IN (0, 1) AND toxic IN (0, 1)) AS is_binary, 'classification' AS dataset_type
       FROM labels UNION ALL SELECT 'sizes', bool_and(p_size IN (0, 1)), 'regression' FROM part""",
)
def agg11(t):
    sizes = t.part.select(F.array(F.col("p_size").cast("double")).alias("targets"))
    labelled = prep.target_type(_dataset(t)).withColumn("data", F.lit("labels"))
    return labelled.unionByName(prep.target_type(sizes).withColumn("data", F.lit("sizes")))


# --- splits and samples -----------------------------------------------------------------------


def _pos_sql(salt: str, table: str, key: str) -> str:
    return f"pos AS (SELECT {key}, row_number() OVER (ORDER BY {u_sql(key, f'shuffle/{salt}')}, {key}) AS p FROM {table})"


@query(
    "mlp1_random_split",
    f"""WITH {_pos_sql('6', 'orders', 'o_orderkey')}, n AS (SELECT count(*) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN p <= floor(0.8::double * n) THEN 'train'
      WHEN p <= floor((0.8::double + 0.1::double) * n) THEN 'val' ELSE 'test' END AS split FROM pos, n""",
)
def mlp1(t):
    return prep.random_split(t.orders.select("o_orderkey"), "o_orderkey", 6)


@query(
    "mlp2_kfold_split",
    f"""WITH {_pos_sql('0', 'orders', 'o_orderkey')}
    SELECT o_orderkey, fold, CASE fold WHEN 3 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS split
    FROM (SELECT o_orderkey, ((p - 1) // (1 + (SELECT count(*) FROM orders) // 5))::int AS fold FROM pos)""",
)
def mlp2(t):
    return prep.kfold_split(t.orders.select("o_orderkey"), "o_orderkey", 3, 5)


@query(
    "mlp3_given_split",
    """SELECT d.doc_id, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS split
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def mlp3(t):
    split = F.when(F.col("quality") == 1, "train").otherwise("test")
    assignment = t.labels.select("doc_id", split.alias("split"))
    return prep.given_split(t.documents.select("doc_id"), assignment, "doc_id")


@query(
    "mlp4_balanced_sample",
    f"""WITH a AS (SELECT doc_id, quality = 1 AS active FROM labels),
    r AS (SELECT *, row_number() OVER (PARTITION BY active ORDER BY {u_sql('doc_id', 'shuffle/5')}, doc_id) AS p FROM a),
    m AS (SELECT least(count(*) FILTER (WHERE active), count(*) FILTER (WHERE NOT active)) AS m FROM a)
    SELECT doc_id, active, 2 * p - active::int AS slot FROM r, m WHERE p <= m""",
)
def mlp4(t):
    return prep.balanced_sample(t.labels.select("doc_id", "quality"), "doc_id", F.col("quality") == 1, 5).select(
        "doc_id", "active", "slot"
    )
