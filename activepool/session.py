"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("activepool")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


_local_roots: dict[str, str] = {}
_scope: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver gets a temporary folder of its own
    without that setting; no session setting is changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="activepool-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (below the open scope, if there is one); never reused."""
    base = _scope.get() or f"{scratch_root(spark)}/activepool"
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables made inside are deleted at the end; what is to stay is written elsewhere before.

    Scopes nest; an inner scope's tables go first.
    """
    base = scratch_path(spark, "scope")
    token = _scope.set(base)
    try:
        yield base
    finally:
        _scope.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors, and fixes values that depend on the partitioning
    (row slots, range bounds). Readers still prune columns and skip row groups.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spreads a table before CPU-heavy work on its rows if its splits would leave cores idle.

    The rows of a file come in row groups, and a split in which none begins has no row, so the rows of each split
    are counted (Parquet's footers tell them) and not the splits. A table of which no split holds more than twice
    a core's even share (any large one in many files) is returned as it is, without a shuffle.
    """
    from pyspark.sql import functions as F

    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    seen = splits.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if (seen["most"] or 0) * cores <= 2 * (seen["n"] or 0):
        return df
    return df.repartition(max(cores, df.rdd.getNumPartitions()), key)


def one_row(df: DataFrame):
    """A one-row aggregate as a struct column (scalar subquery), so no join is planned."""
    from pyspark.sql import functions as F

    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()
