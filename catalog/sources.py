"""Readers, each over files that Spark writes from a given table first."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from activepool.operators.ordering import top_n
from activepool.operators.prepare import valid_keys
from activepool.operators.rows import draw_rows
from activepool.sources import files, text
from activepool.sources.offsets import RowOffsets, draw_stored

from .registry import query, u_sql


def write_csv(df: DataFrame, path: str, order: str | None = None, header=True, sep=",", **options) -> str:
    """Text files whose file and line order follows ``order``; no single-task write."""
    if order is not None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, order).sortWithinPartitions(order)
    df.write.csv(path, header=header, sep=sep, quote='"', escape='"', emptyValue="", **options)
    return path


# --- libraries --------------------------------------------------------------------------------


@query(
    "src1_library_scan",
    "SELECT p_name AS key FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer",
)
def src1(t):
    """Three libraries of one format (';', title line, key in column 1), compressed and plain."""
    paths = []
    for table, key, name, codec in (
        (t.part, "p_partkey", "p_name", "gzip"),
        (t.supplier, "s_suppkey", "s_name", "none"),
        (t.customer, "c_custkey", "c_name", "gzip"),
    ):
        paths.append(write_csv(table.select(key, name), t.scratch("library"), sep=";", compression=codec))
    return text.read_library(t.spark, paths, delimiter=";", key_col=1)


@query("src2_cxsmiles_suffix", "SELECT p_name AS key FROM part")
def src2(t):
    """Some keys carry an extension block behind a blank."""
    extended = F.concat("p_name", F.lit(" |"), "p_brand", F.lit("|"))
    key = F.when(F.col("p_type") == "ECONOMY", F.col("p_name")).otherwise(extended)
    path = write_csv(t.part.select(key.alias("key")), t.scratch("cxsmiles"), header=False)
    return text.read_library(t.spark, path, title_line=False, cxsmiles=True)


def _oracle_file(t, where="lookup"):
    """Names repeat, and one brand's prices are no numbers."""
    score = F.when(F.col("p_brand") == "Brand#3", F.lit("failed")).otherwise(
        F.col("p_retailprice").cast("string")
    )
    rows = t.part.select("p_partkey", F.col("p_name").alias("key"), score.alias("score"))
    return write_csv(rows, t.scratch(where), order="p_partkey", compression="gzip")


@query(
    "src3_lookup_oracle",
    """SELECT p_name AS id, arg_max(p_retailprice, p_partkey) AS y FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1""",
)
def src3(t):
    return text.read_oracle(t.spark, _oracle_file(t), key_col=1, score_col=2)


@query(
    "src3_lookup_oracle_of_several_paths",
    """SELECT p_name AS id, arg_max(p_retailprice, (p_partkey % 2, p_partkey)) AS y FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1""",
)
def src3_paths(t):
    """Two folders whose names sort against the order in which they are given: the last one given counts."""
    base = t.scratch("lookup")
    score = F.when(F.col("p_brand") == "Brand#3", F.lit("failed")).otherwise(F.col("p_retailprice").cast("string"))
    rows = t.part.select("p_partkey", F.col("p_name").alias("key"), score.alias("score"))
    for name, half in (("z-even", 0), ("a-odd", 1)):
        write_csv(rows.filter(F.col("p_partkey") % 2 == half), f"{base}/{name}", order="p_partkey")
    return text.read_oracle(t.spark, [f"{base}/z-even", f"{base}/a-odd"], key_col=1, score_col=2)


@query(
    "src4_signed_oracle",
    """SELECT p_name AS id, -arg_max(p_retailprice, p_partkey) AS y FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1""",
)
def src4(t):
    return text.read_oracle(t.spark, _oracle_file(t), key_col=1, score_col=2, maximize=False)


def _score_file(t):
    """Customer rows as an acquisition log by segment/nation key; negative balances failed."""
    score = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string"))
    key = F.concat_ws("/", "c_mktsegment", "c_nationkey")
    rows = t.customer.select("c_custkey", key.alias("smiles"), score.alias("score"))
    path = t.scratch("scores")
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "c_custkey").sortWithinPartitions("c_custkey")
    rows.select("smiles", "score").write.csv(path, header=True)
    return path


SCORED = "s AS (SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS score FROM customer)"


@query(
    "src5_previous_scores",
    f"WITH {SCORED} SELECT id, (arg_max(struct_pack(v := score), c_custkey)).v AS score FROM s GROUP BY 1",
)
def src5(t):
    return text.read_scores(t.spark, _score_file(t))


@query(
    "src5_previous_scores_of_several_paths",
    f"""WITH {SCORED} SELECT id, (arg_max(struct_pack(v := score), (c_custkey % 3 <> 0, c_custkey))).v AS score FROM s GROUP BY 1""",
)
def src5_paths(t):
    """Logs of two runs; the later path's row of a key counts, also where it failed."""
    key, base = F.concat_ws("/", "c_mktsegment", "c_nationkey"), t.scratch("scores")
    score = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string"))
    for name, first in (("run-2", True), ("run-1", False)):
        rows = t.customer.filter((F.col("c_custkey") % 3 == 0) == first).select("c_custkey", key.alias("smiles"), score.alias("score"))
        parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(parts, "c_custkey").sortWithinPartitions("c_custkey")
        rows.select("smiles", "score").write.csv(f"{base}/{name}", header=True)
    return text.read_scores(t.spark, [f"{base}/run-2", f"{base}/run-1"])


@query(
    "src6_scores_and_failures",
    f"""WITH {SCORED} SELECT id, arg_max(score, c_custkey) AS score, 'score' AS kind FROM s WHERE score IS NOT NULL GROUP BY 1
    UNION ALL SELECT DISTINCT id, NULL, 'failure' FROM s WHERE score IS NULL""",
)
def src6(t):
    scored, failed = text.read_scores_and_failures(t.spark, _score_file(t))
    failed = failed.select("id", F.lit(None).cast("double").alias("score"), F.lit("failure").alias("kind"))
    return scored.withColumn("kind", F.lit("score")).unionByName(failed)


# --- features ---------------------------------------------------------------------------------


def feature_table(t) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


@query(
    "src7_feature_batches",
    """SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) AS norm
       FROM embeddings""",
)
def src7(t):
    """A written feature table, read back in batches."""
    path = t.scratch("features")
    feature_table(t).write.parquet(path)

    def norms(ids, matrix):
        return {"id": ids, "norm": (matrix**2).sum(axis=1) ** 0.5}

    out = files.map_feature_batches(files.read_features(t.spark, path), norms, "id bigint, norm double", 100)
    return out.withColumn("norm", F.round("norm", 5))


@query(
    "src8_extra_features",
    "SELECT c_custkey::double AS f0, c_acctbal AS f1, c_nationkey::double AS f2 FROM customer",
)
def src8(t):
    rows = t.customer.select("c_custkey", "c_acctbal", "c_nationkey")
    path = write_csv(rows, t.scratch("numeric"), order="c_custkey") + "/*.csv"
    loaded = files.load_features(t.spark, path)
    return loaded.select(*[F.col("features")[i].alias(f"f{i}") for i in range(3)])


@query(
    "src8_numpy_features",
    "SELECT vec_id::double AS f0, embedding[1]::double AS f1, embedding[2]::double AS f2 FROM embeddings",
)
def src8_numpy(t):
    """Array files of 100 rows each as made by the tasks, decoded one file at a time."""
    rows = t.embeddings.select("vec_id", "embedding", F.floor(F.col("vec_id") / 100).alias("part"))

    def dump(frame):
        import io

        import numpy as np
        import pandas as pd

        first = np.stack(frame["embedding"].to_numpy())[:, :2].astype("float64")
        buffer = io.BytesIO()
        np.save(buffer, np.column_stack([frame["vec_id"].to_numpy(dtype="float64"), first]))
        return pd.DataFrame({"path": [f"{frame['part'].iloc[0]}.npy"], "content": [buffer.getvalue()]})

    arrays = rows.groupBy("part").applyInPandas(dump, "path string, content binary")
    loaded = files.decode_numpy(arrays)
    return loaded.select(*[F.col("features")[i].alias(f"f{i}") for i in range(3)])


@query(
    "src9_keyed_descriptors",
    """WITH d AS (SELECT p_name AS key, arg_min(p_size::varchar || ',' || p_retailprice::varchar || ',' || p_partkey::varchar, p_partkey) AS d
      FROM part GROUP BY 1)
    SELECT key, n, len(string_split(d, ',')[1:n]) AS kept, round(list_sum(list_transform(string_split(d, ',')[1:n], lambda v: v::double)), 4) AS total
    FROM (SELECT key, d, (length(key) % 3 + 1)::int AS n FROM d)""",
)
def src9(t):
    """Repeated names take their first row; each key is cut to its own length."""
    descriptors = t.part.select(
        F.col("p_name").alias("key"),
        F.concat_ws(",", "p_size", "p_retailprice", "p_partkey").alias("d"),
        "p_partkey",
    )
    keys = t.part.select(F.col("p_name").alias("key")).distinct()
    keys = keys.withColumn("n", (F.length("key") % 3 + 1).cast("int"))
    out = files.keyed_descriptors(descriptors, keys, ["d"], F.col("p_partkey"), "n")
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    return out.select("key", "n", F.size("d").cast("bigint").alias("kept"), F.round(total, 4).alias("total"))


# --- training tables --------------------------------------------------------------------------


def _training_file(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        F.concat(F.lit("doc"), "doc_id").alias("smiles"), "lang", "quality", "toxic", "n_chars"
    )
    return write_csv(rows, t.scratch("training"))


@query(
    "src10_training_table",
    """SELECT 'doc' || d.doc_id AS key, l.quality::double AS quality, l.toxic::double AS toxic
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def src10(t):
    """Targets default to all columns but the key and the ignored ones; unlabelled rows are skipped."""
    rows = text.read_training(
        t.spark, _training_file(t), ignore_columns=["lang", "n_chars"], skip_none_targets=True
    )
    return rows.select(
        F.col("inputs")[0].alias("key"),
        F.col("targets")[0].alias("quality"),
        F.col("targets")[1].alias("toxic"),
    )


@query(
    "src11_key_columns_flat",
    "SELECT 'doc' || doc_id AS key FROM documents UNION ALL SELECT lang FROM documents",
)
def src11(t):
    return text.read_keys(t.spark, _training_file(t), ["smiles", "lang"], flatten=True)


@query(
    "src11_keys_without_title",
    "SELECT 'doc' || doc_id AS first, lang AS second FROM documents",
)
def src11_untitled(t):
    """A file without a title line: the first two columns are the keys."""
    path = t.scratch("keys")
    rows = t.documents.select(F.concat(F.lit("doc"), "doc_id").alias("a"), "lang", "source")
    rows.write.csv(path)
    keys = text.read_keys(t.spark, path, header=False, n_keys=2)
    return keys.select(F.col("inputs")[0].alias("first"), F.col("inputs")[1].alias("second"))


@query(
    "src10_training_rows_with_features",
    """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents)
    SELECT 'doc' || r.doc_id AS key, r.row, l.quality::double AS quality, r.row * 2 AS f
    FROM r LEFT JOIN labels l ON l.doc_id = r.doc_id WHERE l.quality IS NOT NULL""",
)
def src10_rows(t):
    """Row places survive the filter of unlabelled rows, so features by row join back."""
    table = t.documents.join(t.labels, "doc_id", "left").orderBy("doc_id")
    table = table.select(F.concat(F.lit("doc"), "doc_id").alias("smiles"), "quality")
    path = write_csv(table, t.scratch("training"))
    rows = text.read_training(t.spark, path, skip_none_targets=True, with_row=True)
    features = t.spark.range(t.documents.count()).select(F.col("id").alias("row"), (F.col("id") * 2).alias("f"))
    joined = text.attach_features(rows, features)
    return joined.select(F.col("inputs")[0].alias("key"), "row", F.col("targets")[0].alias("quality"), "f")


@query(
    "src12_dataset_from_keys",
    "SELECT conv_id, role, length(text)::int AS n FROM conversations WHERE length(trim(text)) > 0 AND length(trim(role)) > 0",
)
def src12(t):
    """Rows already in memory as a DataFrame, two keys per row, blank keys dropped."""
    rows = t.conversations.select("conv_id", F.array("role", "text").alias("inputs"))
    kept = valid_keys(rows)
    return kept.select("conv_id", F.col("inputs")[0].alias("role"), F.length(F.col("inputs")[1]).alias("n"))


# --- run directories, predictions, configs -----------------------------------------------------


def run_directory(t) -> str:
    """The clicks of the event table as the files of one run: a round is a day."""
    root = t.scratch("run")
    rounds = t.events.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("smiles"),
        F.col("value").alias("score"),
        F.concat(
            F.lit("explored_iter_"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
        ).alias("top"),
    )
    rounds.write.partitionBy("top").csv(f"{root}/data", header=True)
    return root


@query(
    "src13_run_directory",
    """SELECT date_diff('day', DATE '2024-01-01', ts::date)::int AS iter, event_id::varchar AS id, value AS score
       FROM events WHERE event_type = 'click'""",
)
def src13(t):
    return files.read_run_scores(t.spark, run_directory(t)).select("iter", "id", "score")


@query(
    "src14_predictions_of_a_round",
    """SELECT l_partkey AS id, round(avg(ln(l_extendedprice)), 6) AS mu, 3 AS iter
       FROM lineitem WHERE l_linenumber = 3 GROUP BY 1""",
)
def src14(t):
    path = t.scratch("preds")
    per_round = t.lineitem.groupBy(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("iter"))
    rows = per_round.agg(F.round(F.avg(F.log("l_extendedprice")), 6).alias("mu"))
    files.write_predictions(rows, path)
    return files.read_predictions(t.spark, path, 3, n_iters=8)


@query("src15_config", "SELECT n_name AS key, n_regionkey::varchar AS value FROM nation")
def src15(t):
    path = t.scratch("config")
    t.nation.select(F.concat_ws(" = ", "n_name", "n_regionkey").alias("value")).write.text(path)
    return text.read_config(t.spark, path)


@query(
    "src16_external_results",
    """WITH r AS (SELECT o_custkey, arg_min((o_totalprice - 250000) / 1000, o_orderkey) AS raw FROM orders GROUP BY 1)
    SELECT c_custkey AS id, round(-least(0, coalesce(raw, 0)) + 0.0, 6) AS score
    FROM customer LEFT JOIN r ON r.o_custkey = c_custkey""",
)
def src16(t):
    rows = t.orders.select(
        "o_orderkey",
        F.concat(F.lit('"d'), "o_custkey", F.lit('"')).alias("title"),
        ((F.col("o_totalprice") - 250000) / 1000).alias("docked"),
    )
    path = write_csv(rows, t.scratch("results"), order="o_orderkey")
    submitted = t.customer.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("d"), "c_custkey").alias("ext_id")
    )
    scores = text.read_external_results(submitted, t.spark, path, id_col=1, score_col=2, missing="zero")
    return scores.withColumn("score", F.round("score", 6))


@query(
    "src17_pose_index",
    """WITH top AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 200)
    SELECT o_orderpriority AS node_id, 'lig_' || o_orderkey AS name FROM orders WHERE o_orderkey IN (SELECT * FROM top)""",
)
def src17(t):
    rows = t.orders.select(
        "o_orderkey",
        F.concat(F.lit("lig_"), "o_orderkey").alias("name"),
        F.col("o_orderpriority").alias("node_id"),
        "o_totalprice",
    )
    path = write_csv(rows, t.scratch("extended"))
    best = top_n(t.orders.select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice", "o_orderkey"),
                 200, "o_totalprice", "o_orderkey")
    return text.read_pose_index(t.spark, path, best.select("id"))


@query(
    "src18_archive_members",
    """WITH top AS (SELECT page_id FROM pages ORDER BY length(html) DESC, page_id DESC LIMIT 40)
    SELECT 'node_' || (page_id // 25)::bigint AS node_id, 'poses/page_' || page_id || '_.html' AS member,
           strlen(html)::int AS n_bytes
    FROM pages WHERE page_id IN (SELECT page_id FROM top)""",
)
def src18(t):
    """Page files packed into one archive per 25 pages by the tasks, the wanted ones taken out."""
    pages = t.pages.select("page_id", "html", F.floor(F.col("page_id") / 25).alias("node"))

    def pack(frame):
        import io
        import tarfile

        import pandas as pd

        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            for page, html in zip(frame["page_id"], frame["html"]):
                data = html.encode("utf-8")
                info = tarfile.TarInfo(f"poses/page_{page}_.html")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"node_id": [f"node_{frame['node'].iloc[0]}"], "content": [buffer.getvalue()]})

    archives = pages.groupBy("node").applyInPandas(pack, "node_id string, content binary")
    sized = t.pages.select("page_id", F.length("html").alias("n"))
    wanted = top_n(sized, 40, "n", "page_id").select(
        F.concat(F.lit("node_"), F.floor(F.col("page_id") / 25).cast("string")).alias("node_id"),
        F.concat(F.lit("page_"), "page_id", F.lit("_")).alias("name"),
    )
    members = files.extract_members(archives, wanted)
    return members.select("node_id", "member", F.octet_length("content").alias("n_bytes"))


@query("src19_distinct_values", "SELECT DISTINCT lang || '_' || source AS protein FROM documents")
def src19(t):
    rows = t.documents.select("doc_id", F.concat_ws("_", "lang", "source").alias("protein"))
    return text.read_distinct_values(t.spark, write_csv(rows, t.scratch("affinity")), "protein")


@query(
    "src20_random_lines",
    f"""WITH n AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS pos FROM part),
    d AS (SELECT i // 400 AS rep, i % 400 AS draw, floor({u_sql('i', 'draw/4')} * (SELECT count(*) FROM part)) + 1 AS pos
          FROM range(1200) r(i))
    SELECT rep::bigint AS rep, draw, p_partkey, p_name FROM d JOIN n ON n.pos = d.pos""",
)
def src20(t):
    """Three samples of 400 lines, with replacement."""
    lines = t.part.select("p_partkey", "p_name")
    return draw_rows(lines, 400, 3, 4, [F.col("p_partkey").asc()])


def stored_parts(t) -> RowOffsets:
    """The parts in files by key; their positions are those of the key order."""
    path = t.scratch("lines")
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = t.part.select("p_partkey", "p_name").repartitionByRange(parts, "p_partkey").sortWithinPartitions("p_partkey")
    rows.write.parquet(path)
    return RowOffsets(t.spark, path)


@query(
    "src20_random_stored_lines",
    f"""WITH n AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
    d AS (SELECT i // 400 AS rep, i % 400 AS draw, floor({u_sql('i', 'draw/4')} * (SELECT count(*) FROM part)) AS pos
          FROM range(1200) r(i))
    SELECT rep::bigint AS rep, draw, p_partkey, p_name FROM d JOIN n ON n.pos = d.pos""",
)
def src20_stored(t):
    """Three samples of 400 stored lines by their positions, with replacement: no line is moved."""
    return draw_stored(stored_parts(t), 400, 3, 4)


@query(
    "src21_prediction_shards",
    """SELECT p_partkey AS idx, p_name AS key, round(ln(p_retailprice), 6) AS mu FROM part""",
)
def src21(t):
    """Shards written per worker (here per brand), matched to the input rows and in input order."""
    path = t.scratch("shards")
    shards = t.part.select(
        F.col("p_partkey").alias("idx"), F.round(F.log("p_retailprice"), 6).alias("mu"), F.col("p_brand").alias("rank")
    )
    shards.write.partitionBy("rank").parquet(path)
    keys = t.part.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("key"))
    return files.gather_shards(t.spark, path, keys).select("idx", "key", "mu")


@query(
    "agg12_data_audit",
    """SELECT 'bad_key' AS code, count(*) + 1 AS n FROM part WHERE p_brand = 'Brand#3'
    UNION ALL SELECT 'target_not_number', count(*) + 1 FROM part WHERE p_brand = 'Brand#4'""",
)
def agg12(t):
    """A training file with blank keys, text targets, quoted commas and a data row like the title."""
    key = F.when(F.col("p_brand") != "Brand#3", F.concat("p_name", F.lit(", "), "p_brand"))
    target = F.when(F.col("p_brand") == "Brand#4", F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    rows = t.part.select(key.alias("smiles"), target.alias("size"), F.col("p_retailprice").cast("string"))
    title = rows.limit(1).select(*[F.lit(c).alias(c) for c in rows.columns])
    path = write_csv(rows.unionByName(title), t.scratch("audit"))
    return text.audit_training(t.spark, path, lambda c: c.rlike("^[a-zA-Z ]+, Brand#[0-9]+$"))


