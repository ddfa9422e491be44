"""Delimited text: libraries, score tables, training tables, configs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import parse_float, signed
from ..operators.ordering import number_rows
from ..operators.scores import first_per_key, last_per_key

CXSMILES_SUFFIX = r"\s\|.*\|"
LINE = "_line"


def _string_schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])


def line_key(path: Column | None = None) -> Column:
    """Orders rows as they stand in the files: place of the path, file name, split start, row within the split."""
    return F.struct(
        (F.lit(0) if path is None else path).alias("path"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


def path_places(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """``(file, place)`` of every file below ``paths``; a file that several paths name counts by the last.

    Files are listed as the readers list them (folders, patterns, several files a path); no file is read.
    """
    listed = spark.createDataFrame([], "file string, place int")
    for place, path in enumerate(paths):
        files = spark.read.format("binaryFile").options(**options).load(path).select(F.col("_metadata.file_path").alias("file"))
        listed = listed.unionByName(files.withColumn("place", F.lit(place)))
    return listed.groupBy("file").agg(F.max("place").alias("place"))


def read_columns(
    spark: SparkSession,
    paths,
    columns: Sequence[int],
    delimiter: str = ",",
    title_line: bool = True,
    line: bool = False,
) -> DataFrame:
    """String columns ``_c<n>`` by number. Compressed files are opened by suffix.

    The schema is built from the highest column number, so no file is read to infer it and only
    the asked columns are parsed. With ``line`` rows carry their order: that of the paths as given, then that
    of the files below a path.
    """
    df = spark.read.csv(
        paths,
        schema=_string_schema(max(columns) + 1),
        sep=delimiter,
        header=title_line,
        quote='"',
        escape='"',
        enforceSchema=True,
    )
    wanted = [F.col(f"_c{i}") for i in dict.fromkeys(columns)]
    if not line:
        return df.select(*wanted)
    if isinstance(paths, str) or len(paths) == 1:
        return df.select(*wanted, line_key().alias(LINE))
    # One row a file: the place of its path is joined by the name that the scan gives.
    keyed = df.select(*wanted, line_key().alias(LINE))
    places = path_places(spark, paths).withColumnRenamed("place", "_place")
    joined = keyed.join(places, F.col(f"{LINE}.file") == F.col("file"), "left")
    return joined.select(*wanted, F.struct(F.col("_place").alias("path"), *[F.col(f"{LINE}.{c}") for c in ("file", "start", "row")]).alias(LINE))


def read_library(
    spark: SparkSession,
    paths,
    title_line: bool = True,
    delimiter: str = ",",
    key_col: int = 0,
    cxsmiles: bool = False,
) -> DataFrame:
    """Candidate keys of many files of one format."""
    key = F.col(f"_c{key_col}")
    if cxsmiles:
        key = F.split(key, CXSMILES_SUFFIX, 2)[0]
    return read_columns(spark, paths, [key_col], delimiter, title_line).select(key.alias("key"))


def read_oracle(
    spark: SparkSession,
    paths,
    delimiter: str = ",",
    title_line: bool = True,
    key_col: int = 0,
    score_col: int = 1,
    maximize: bool = True,
) -> DataFrame:
    """``(id, y)``: rows that are no number vanish, of a repeated key the last row counts."""
    rows = read_columns(spark, paths, [key_col, score_col], delimiter, title_line, line=True)
    rows = rows.select(
        F.col(f"_c{key_col}").alias("id"),
        signed(parse_float(F.col(f"_c{score_col}")), maximize).alias("y"),
        LINE,
    ).filter(F.col("y").isNotNull())
    return last_per_key(rows, "id", LINE).drop(LINE)


def read_scores(spark: SparkSession, paths) -> DataFrame:
    """``(id, score)``: no number means a failed evaluation (NULL); the last row of a key counts."""
    rows = read_columns(spark, paths, [0, 1], line=True)
    rows = rows.select(F.col("_c0").alias("id"), parse_float(F.col("_c1")).alias("score"), LINE)
    return last_per_key(rows, "id", LINE).drop(LINE)


def read_scores_and_failures(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Scored keys (last number counts) and keys with at least one failed row."""
    rows = read_columns(spark, paths, [0, 1], line=True)
    rows = rows.select(F.col("_c0").alias("id"), parse_float(F.col("_c1")).alias("score"), LINE)
    scored = last_per_key(rows.filter(F.col("score").isNotNull()), "id", LINE).drop(LINE)
    failed = rows.filter(F.col("score").isNull()).select("id").distinct()
    return scored, failed


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV with a title line (reads one line)."""
    return spark.read.csv(path, header=True, quote='"', escape='"').columns


def read_training(
    spark: SparkSession,
    path: str,
    key_columns: Sequence[str] | None = None,
    target_columns: Sequence[str] | None = None,
    ignore_columns: Sequence[str] = (),
    skip_none_targets: bool = False,
    max_data_size: int | None = None,
    n_keys: int = 1,
    with_row: bool = False,
) -> DataFrame:
    """``(inputs ARRAY<STRING>, targets ARRAY<DOUBLE>)`` by column name.

    Keys default to the first column(s), targets to all columns that are neither key nor ignored.
    An empty cell is a missing target. ``with_row`` adds ``row``, the row's place in the file from 0
    (skipped rows counted), by which extra features are attached.
    """
    columns = read_header(spark, path)
    keys = list(key_columns) if key_columns else columns[:n_keys]
    targets = (
        list(target_columns)
        if target_columns
        else [c for c in columns if c not in keys and c not in ignore_columns]
    )
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')
    df = raw.select(
        F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in keys]).alias("inputs"),
        F.array(*[parse_float(F.col(f"`{c}`")) for c in targets]).alias("targets"),
        *([line_key().alias(LINE)] if max_data_size or with_row else []),
    )
    if with_row:
        df = number_rows(df, [F.col(LINE).asc()], name="row").withColumn("row", F.col("row") - 1)
    if skip_none_targets:
        df = df.filter(F.exists("targets", lambda t: t.isNotNull()))
    if max_data_size:
        df = number_rows(df, [F.col(LINE).asc()], name="_pos").filter(F.col("_pos") <= max_data_size).drop("_pos")
    return df.drop(LINE)


def attach_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Training rows read ``with_row`` joined to extra features ``(row, ...)`` of the same file order."""
    return rows.join(features, "row", "left")


def read_keys(
    spark: SparkSession, path: str, key_columns=None, flatten: bool = False, header: bool = True, n_keys: int = 1
) -> DataFrame:
    """Key columns of a CSV, one array per row or one row per key.

    Keys are the named columns, or the first ``n_keys``; a file without a title line (``header=False``)
    has keys by position only.
    """
    if header:
        columns = list(key_columns) if key_columns else read_header(spark, path)[:n_keys]
        df = read_training(spark, path, columns, target_columns=columns).select("inputs")
    else:
        if key_columns:
            raise ValueError("a file without a title line has no named columns")
        cells = [F.coalesce(F.col(f"_c{i}"), F.lit("")) for i in range(n_keys)]
        df = read_columns(spark, path, list(range(n_keys)), title_line=False).select(F.array(*cells).alias("inputs"))
    return df.select(F.explode("inputs").alias("key")) if flatten else df


def read_distinct_values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct values of one named column over a directory of CSV files."""
    return spark.read.csv(path, header=True, quote='"', escape='"').select(column).distinct()


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """``key = value`` lines as rows."""
    parts = F.split(F.trim("value"), " = ", 2)
    return spark.read.text(path).select(parts[0].alias("key"), parts[1].alias("value"))


def config_map(config: DataFrame) -> DataFrame:
    """The same as one row with a map; a config is a handful of lines."""
    return config.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("config"))


def read_external_results(
    submitted: DataFrame,
    spark: SparkSession,
    paths,
    id_col: int,
    score_col: int,
    maximize: bool = False,
    missing: str = "null",
) -> DataFrame:
    """Scores of an external program for the submitted ``(id, ext_id)`` rows.

    Quotes are taken off the ids, the first row of an id counts, positive scores are set to 0. A
    submitted row without result fails (``missing='null'``) or scores 0 (``missing='zero'``).
    """
    rows = read_columns(spark, paths, [id_col, score_col], line=True).select(
        F.regexp_replace(f"_c{id_col}", '"', "").alias("ext_id"),
        parse_float(F.col(f"_c{score_col}")).alias("raw"),
        LINE,
    )
    results = first_per_key(rows, "ext_id", LINE)
    raw = F.coalesce(F.col("raw"), F.lit(0.0)) if missing == "zero" else F.col("raw")
    capped = F.when(raw.isNotNull(), F.least(F.lit(0.0), raw))
    return submitted.join(results, "ext_id", "left").select(
        "id", (signed(capped, maximize) + F.lit(0.0)).alias("score")
    )


def read_pose_index(spark: SparkSession, paths, top_keys: DataFrame) -> DataFrame:
    """``(node_id, name)`` of the wanted keys, from rows ``key, name, node_id, score``."""
    index = read_columns(spark, paths, [0, 1, 2]).toDF("id", "name", "node_id")
    return index.join(top_keys.select("id"), "id", "left_semi").select("node_id", "name")


def audit_training(spark: SparkSession, path: str, is_key=None) -> DataFrame:
    """``(code, n)``: what is wrong with a training CSV, with the number of rows hit; no row, no fault.

    Codes: ``no_header``, ``no_targets_in_header``, ``header_is_key`` (each once), ``no_rows``,
    ``bad_key``, ``row_width`` (more or fewer cells than the header), ``target_not_number``,
    ``no_target`` (counted when no row has any target). The CSV reader splits the cells, so quoted
    delimiters belong to their cell, and the title is skipped by its position: a data row that repeats
    it is a row like others. ``is_key`` is the validity predicate for keys. One pass over the file.
    """
    is_key = is_key or (lambda c: F.length(F.trim(c)) > 0)
    names = read_header(spark, path)
    if not names:
        return spark.createDataFrame([("no_header", 1)], "code string, n bigint")
    cells = [f"c{i}" for i in range(len(names))]
    fields = [T.StructField(c, T.StringType()) for c in [*cells, "_broken"]]
    rows = spark.read.csv(
        path, schema=T.StructType(fields), header=True, quote='"', escape='"', columnNameOfCorruptRecord="_broken",
        enforceSchema=True,
    )
    targets = F.array(*[F.col(c) for c in cells[1:]]) if len(cells) > 1 else F.array().cast("array<string>")
    some = F.exists(targets, lambda t: t.isNotNull() & (t != ""))
    no_number = F.exists(targets, lambda t: t.isNotNull() & (t != "") & parse_float(t).isNull())
    rows = rows.select(
        (~F.coalesce(is_key(F.col("c0")), F.lit(False))).alias("bad_key"),
        F.col("_broken").isNotNull().alias("row_width"),
        no_number.alias("target_not_number"),
        some.alias("some"),
    )
    counted = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(c).alias(c) for c in ("bad_key", "row_width", "target_not_number", "some")],
    )
    first = F.lit(names[0])
    found = {
        "no_targets_in_header": F.lit(int(len(names) == 1)),
        "header_is_key": F.coalesce(is_key(first), F.lit(False)).cast("int"),
        "no_rows": (F.col("n") == 0).cast("int"),
        "bad_key": F.col("bad_key"),
        "row_width": F.col("row_width"),
        "target_not_number": F.col("target_not_number"),
        "no_target": F.when(F.col("some") == 0, F.col("n")).otherwise(F.lit(0)),
    }
    table = F.array(*[F.struct(F.lit(c).alias("code"), n.cast("bigint").alias("n")) for c, n in found.items()])
    return counted.select(F.inline(F.filter(table, lambda r: r["n"] > 0)))
