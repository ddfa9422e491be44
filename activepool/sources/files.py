"""Feature files, archives, run directories, prediction shards and all writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import parse_float
from ..operators.ordering import number_rows
from ..operators.scores import final_scores
from ..session import pinned
from .text import LINE, line_key, read_columns

# --- features ---------------------------------------------------------------------------------


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature table ``(id, features)``; readers that need only ids do not touch the features."""
    return spark.read.parquet(path)


def map_feature_batches(features: DataFrame, fn, schema: str, batch: int = 6144) -> DataFrame:
    """Runs ``fn(ids, matrix) -> dict of columns`` on Arrow batches of the feature table."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                matrix = np.stack(part["features"].to_numpy()).astype("float64")
                yield pd.DataFrame(fn(part["id"].to_numpy(), matrix))

    return features.select("id", "features").mapInPandas(run, schema)


def read_numeric_csv(spark: SparkSession, paths, width: int, title_line: bool = True) -> DataFrame:
    """``features ARRAY<DOUBLE>`` from purely numeric CSV files, with the line order key."""
    raw = read_columns(spark, paths, list(range(width)), title_line=title_line, line=True)
    return raw.select(LINE, F.array(*[parse_float(F.col(f"_c{i}")) for i in range(width)]).alias("features"))


def read_numpy(spark: SparkSession, paths) -> DataFrame:
    """``(file, row, features)`` from .npy files, or the array ``features`` of .npz files.

    One task per file (a file must fit in a task); pickled content is refused.
    """
    return decode_numpy(spark.read.format("binaryFile").load(paths).select("path", "content"))


def decode_numpy(files: DataFrame) -> DataFrame:
    """``(path, content)`` of array files to one row per matrix row."""

    def rows(frames):
        import io

        import numpy as np
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                matrix = loaded["features"] if path.endswith(".npz") else loaded
                for start in range(0, len(matrix), 4096):
                    part = matrix[start : start + 4096].astype("float64")
                    yield pd.DataFrame(
                        {"file": path, "row": range(start, start + len(part)), "features": list(part)}
                    )

    return files.mapInPandas(rows, "file string, row bigint, features array<double>")


def load_features(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """Extra features by file type: csv, txt, npy, npz or Parquet."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "txt"):
        if width is None:
            width = len(spark.read.csv(path, header=True).columns)
        return read_numeric_csv(spark, path, width)
    if suffix in ("npy", "npz"):
        return read_numpy(spark, path)
    if suffix in ("pkl", "pckl", "pickle"):
        raise ValueError("pickled features are not read: loading them runs code from the file")
    return spark.read.parquet(path)


def keyed_descriptors(
    descriptors: DataFrame, keys: DataFrame, columns: Sequence[str], order: Column, size: str
) -> DataFrame:
    """Per key the first row's comma-separated descriptors as arrays, cut to ``size`` entries.

    ``keys`` holds ``(key, <size>)``. A key without descriptors stops the job.
    """
    first = descriptors.groupBy("key").agg(
        F.min_by(F.struct(*[F.col(c) for c in columns]), order).alias("_d")
    )
    joined = keys.join(first, "key", "left")

    def parsed(c):
        text = F.col("_d")[c]
        gone = text.isNull()
        clean = F.regexp_replace(text, "[\r\n]", "")
        values = F.transform(F.split(clean, ","), lambda v: v.cast("double"))
        message = F.concat(F.lit("no descriptors for key "), F.col("key"))
        return F.when(gone, F.raise_error(message).cast("array<double>")).otherwise(
            F.slice(values, 1, F.col(size))
        )

    return joined.select(*keys.columns, *[parsed(c).alias(c) for c in columns])


# --- archives ---------------------------------------------------------------------------------


def read_archives(spark: SparkSession, paths) -> DataFrame:
    """``(node_id, content)`` of ``<node_id>.tar.gz`` files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(paths)
    return files.select(F.regexp_extract("path", r"([^/]+)\.tar\.gz$", 1).alias("node_id"), "content")


def extract_members(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node_id, member, content)`` of members whose file name contains a wanted name.

    ``wanted(node_id, name)`` is a top-k list, so its per-node lists are bounded by k. It is written
    first: with its true size known the join is a broadcast and no archive content is shuffled.
    Archives without a wanted name are never opened; the others one at a time in their task.
    """
    lists = pinned(wanted.groupBy("node_id").agg(F.collect_set("name").alias("names")), "wanted")

    def pull(frames):
        import io
        import tarfile

        import pandas as pd

        for frame in frames:
            for node, content, names in zip(frame["node_id"], frame["content"], frame["names"]):
                found = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        if member.isfile() and any(n in member.name for n in names):
                            found.append((node, member.name, tar.extractfile(member).read()))
                yield pd.DataFrame(found, columns=["node_id", "member", "content"])

    return archives.join(lists, "node_id").mapInPandas(
        pull, "node_id string, member string, content binary"
    )


def extraction_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("node_id").agg(F.count(F.lit(1)).alias("extracted"))


# --- run directories --------------------------------------------------------------------------


def write_round_scores(scores: DataFrame, run_dir: str, iteration: int, n_scored: int) -> str:
    """Scores in acquisition order as CSV; count and round are in the name."""
    path = f"{run_dir}/data/top_{n_scored}_explored_iter_{iteration}.csv"
    scores.orderBy("pos").select("id", "score").write.csv(path, header=True, mode="overwrite")
    return path


def write_final_scores(scores: DataFrame, run_dir: str) -> str:
    """All scored rows, best first, failures last."""
    path = f"{run_dir}/data/all_explored_final.csv"
    final_scores(scores).select("id", "score").write.csv(path, header=True, mode="overwrite")
    return path


def read_run_scores(spark: SparkSession, run_dir: str) -> DataFrame:
    """``(iter, id, score)`` of all rounds; the round is the last number in the file's name."""
    raw = read_columns_with_path(spark, [f"{run_dir}/data/*iter_*"])
    return raw.select(
        F.regexp_extract("_path", r"iter_(\d+)(\.csv)?(/[^/]*)?$", 1).cast("int").alias("iter"),
        F.col("_c0").alias("id"),
        parse_float(F.col("_c1")).alias("score"),
        LINE,
    )


def read_columns_with_path(spark: SparkSession, paths) -> DataFrame:
    df = spark.read.csv(paths, schema="_c0 string, _c1 string", header=True, quote='"', escape='"')
    return df.select("_c0", "_c1", line_key().alias(LINE), F.col("_metadata.file_path").alias("_path"))


def read_ordered_scores(spark: SparkSession, path: str) -> DataFrame:
    """A sorted score file with its order as ``pos`` (exact over many part files)."""
    rows = read_columns(spark, path, [0, 1], line=True)
    rows = rows.select(F.col("_c0").alias("id"), parse_float(F.col("_c1")).alias("score"), LINE)
    return number_rows(rows, [F.col(LINE).asc()], name="pos").drop(LINE)


def write_predictions(preds: DataFrame, path: str) -> str:
    """Predictions partitioned by round: reading one round lists one directory."""
    preds.write.partitionBy("iter").mode("overwrite").parquet(path)
    return path


def read_predictions(spark: SparkSession, path: str, iteration: int, n_iters: int | None = None) -> DataFrame:
    """Predictions of one round; rounds count from 1, the initial batch has none."""
    if iteration < 1 or (n_iters is not None and iteration >= n_iters):
        raise ValueError(f"no predictions for round {iteration}")
    return spark.read.parquet(path).filter(F.col("iter") == iteration)


def gather_shards(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Prediction shards of many workers, matched to the rows by ``idx`` and in input order."""
    shards = spark.read.option("recursiveFileLookup", "true").parquet(path)
    joined = shards if keys is None else keys.join(shards, "idx")
    return joined.orderBy("idx")


# --- other writers ----------------------------------------------------------------------------


def write_feature_table(df: DataFrame, path: str, features: Column, key: str = "id") -> tuple[str, DataFrame]:
    """Writes ``(id, features)`` of the valid rows once; returns the path and the invalid ids."""
    built = df.select(F.col(key).alias("id"), features.alias("features"))
    flagged = built.withColumn("valid", F.col("features").isNotNull().cast("int"))
    flagged.write.mode("overwrite").partitionBy("valid").parquet(path)
    spark = df.sparkSession
    written = spark.read.schema(flagged.schema).parquet(path)
    return path, written.filter(F.col("valid") == 0).select("id")


def write_splits(df: DataFrame, path: str) -> str:
    """Rows and source row numbers of each split, one directory per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def write_scoring_input(batch: DataFrame, path: str, order: Sequence[Column], prefix: str = "d") -> DataFrame:
    """Rows for an external scorer with generated ids d0, d1, ... in the given order."""
    numbered = number_rows(batch, order, name="_pos")
    rows = numbered.select("id", F.concat(F.lit(prefix), (F.col("_pos") - 1).cast("string")).alias("ext_id"))
    rows.write.mode("overwrite").csv(path, header=True)
    return batch.sparkSession.read.csv(path, schema="id string, ext_id string", header=True)


def write_extended(results: DataFrame, path: str) -> str:
    """One row per scored item: key, name, node, score."""
    results.select("id", "name", "node_id", "score").write.mode("overwrite").csv(path, header=True)
    return path


def write_config(spark: SparkSession, settings: dict, path: str) -> str:
    """Effective settings as ``key = value`` lines; None and False are left out."""
    lines = []
    for name, value in settings.items():
        if value is None or value is False:
            continue
        if isinstance(value, (list, tuple, set, frozenset)):
            value = "[" + ", ".join(map(str, value)) + "]"
        lines.append((f"{name.replace('_', '-')} = {value}",))
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def collate_runs(results: DataFrame, variants: Sequence[str] = ("full", "prune")) -> DataFrame:
    """``(target, variant, rep, value)`` to one row per target and repeat, one column per variant."""
    return results.groupBy("target", "rep").pivot("variant", list(variants)).agg(F.max("value"))
