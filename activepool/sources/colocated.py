"""Tables that stay where their key puts them: pool, predictions and scores bucketed alike.

Rows are hashed by key into a fixed number of files, and Spark is told so when it reads them. Joins of two
such tables of the same number need no shuffle, and a join with any other table moves the other side only,
as long as the buckets are at least ``spark.sql.shuffle.partitions``.

Spark knows bucketed files through its catalog alone. Each table is entered under a name of its own and the
name is dropped at once: the files stay where the path says, and the returned DataFrame still knows them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _entered(spark: SparkSession, path: str, schema, buckets: int, key: str) -> DataFrame:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    name = f"colocated_{uuid.uuid4().hex}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def write_colocated(df: DataFrame, path: str, buckets: int, key: str = "id", moved: bool = True) -> DataFrame:
    """``df`` written below ``path`` in ``buckets`` files by ``key``, and read back.

    ``moved=False`` says that the rows lie by ``key`` already (a column added to a colocated table), so they
    are not shuffled before they are written; wrong, it costs more and smaller files, not rows.
    """
    spark = df.sparkSession
    if moved:
        df = df.repartition(buckets, key)
    name = f"colocated_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").mode("overwrite").option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def read_colocated(spark: SparkSession, path: str, buckets: int, key: str = "id") -> DataFrame:
    """A table that ``write_colocated`` left with this key and number of buckets."""
    return _entered(spark, path, spark.read.parquet(path).schema, buckets, key)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` came to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
