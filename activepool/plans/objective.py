"""Objectives: ``score(batch) -> (id, score)`` with NULL for a failed row."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import nan_to_null, signed
from ..operators.rows import lookup_scores
from ..session import pinned

log = logging.getLogger(__name__)

OBJECTIVES: dict[str, Callable[..., "Objective"]] = {}


def build_objective(name: str, **options) -> "Objective":
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective {name!r}; one of {sorted(OBJECTIVES)}")
    return OBJECTIVES[name](**options)


class Objective:
    """Scores are returned in the direction in which larger is better."""

    def __init__(self, maximize: bool = True):
        self.maximize = maximize

    def score(self, batch: DataFrame, batch_rows: int | None = None) -> DataFrame:
        raise NotImplementedError

    def keep_journal(self, path: str) -> None:
        """Where scores that are paid for may be kept as they come in; free scores need none."""


class LookupObjective(Objective):
    """Replays known scores from a table ``(id, y)``."""

    def __init__(self, oracle: DataFrame, maximize: bool = True, **_):
        super().__init__(maximize)
        self.oracle = oracle

    def score(self, batch: DataFrame, batch_rows: int | None = None) -> DataFrame:
        return lookup_scores(batch.select("id"), self.oracle, self.maximize, batch_rows)


class FunctionObjective(Objective):
    """Runs a user's function row by row inside the tasks; an error or NaN is a failed row.

    ``fn(payload) -> float``; one score may take minutes, so the batch is spread over ``partitions``
    tasks (by default one row a task, up to four tasks a core) and the scores are written before they
    are used. Failures are counted and logged with an example; when every row of a batch fails with
    an error, the example is raised, since that is more often a broken function than a bad batch
    (``raise_if_all_fail=False`` takes it as a batch of failed rows).

    With a ``journal`` (a shared folder) every task's rows are kept as soon as the task ends, also if the
    batch as a whole never does. Scoring the batch again then buys only what is left: rows that have a
    journal entry, and only rows that raised an error are tried again. A task scores at most
    ``journal_rows`` rows, which bounds what a lost executor or driver costs.
    """

    def __init__(
        self,
        fn,
        payload: str = "id",
        maximize: bool = True,
        partitions: int | None = None,
        raise_if_all_fail: bool = True,
        journal: str | None = None,
        journal_rows: int = 16,
        **_,
    ):
        super().__init__(maximize)
        self.fn, self.payload, self.partitions = fn, payload, partitions
        self.raise_if_all_fail = raise_if_all_fail
        self.journal, self.journal_rows = journal, journal_rows
        self._given_journal = journal is not None

    def keep_journal(self, path: str) -> None:
        """Keeps the journal at ``path``, unless one was given when the objective was made."""
        if not self._given_journal:
            self.journal = path

    def _spread(self, rows: DataFrame, batch_rows: int | None) -> DataFrame:
        cores = 4 * rows.sparkSession.sparkContext.defaultParallelism
        n = self.partitions or (min(batch_rows, cores) if batch_rows else cores)
        if self.journal and batch_rows:
            n = max(n, -(-batch_rows // self.journal_rows))
        # Keys are dealt by their rank in the batch, not by a hash that may leave tasks empty.
        return rows.repartition(max(n, 1))

    def score(self, batch: DataFrame, batch_rows: int | None = None) -> DataFrame:
        fn = self.fn

        def run(frames):
            import pandas as pd

            for frame in frames:
                out, errors = [], []
                for value in frame["payload"]:
                    try:
                        out.append(float(fn(value)))
                        errors.append(None)
                    except Exception as e:
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame(
                    {"id": frame["id"], "score": pd.Series(out, dtype="float64"), "error": pd.Series(errors, dtype=object)}
                )

        rows = batch.select("id", F.col(self.payload).alias("payload"))
        id_type = dict(rows.dtypes)["id"]
        paid = None
        if self.journal:
            paid = paid_scores(rows.sparkSession, self.journal, id_type).join(rows.select("id"), "id", "left_semi")
            # Fixed now: the journal grows while the rest is bought.
            paid = pinned(paid, "paid")
            known = paid.count()
            if known:
                log.info("%d rows of the batch are paid for already", known)
                rows = rows.join(paid.select("id"), "id", "left_anti")
                batch_rows = None if batch_rows is None else max(batch_rows - known, 0)
        seen = Observation("scored")
        scored = self._spread(rows, batch_rows).mapInPandas(run, f"id {id_type}, score double, error string").observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.count("error").alias("failed"),
            F.max("error").alias("example"),
        )
        if self.journal:
            # Files appear when their task ends, not when the job does.
            path = f"{self.journal}/bought-{uuid.uuid4().hex}"
            scored.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
            scored = rows.sparkSession.read.schema(scored.schema).parquet(path)
        else:
            scored = pinned(scored, "scored")
        told = seen.get
        if told["failed"]:
            log.warning("%d of %d rows failed, one with %s", told["failed"], told["n"], told["example"])
            if told["failed"] == told["n"] and self.raise_if_all_fail:
                raise RuntimeError(f"all {told['n']} rows failed, one with {told['example']}")
        if paid is not None:
            # A task that was run twice may have left its rows twice; one of them counts.
            scored = _one_each(scored.select("id", "score")).unionByName(paid)
        return scored.select("id", signed(nan_to_null(F.col("score")), self.maximize).alias("score"))


def _one_each(rows: DataFrame) -> DataFrame:
    """One row for each id; a score goes before none, of several the largest."""
    return rows.groupBy("id").agg(F.max("score").alias("score"))


def paid_scores(spark: SparkSession, journal: str, id_type: str) -> DataFrame:
    """``(id, score)`` of every row that a journal holds and that raised no error; scores as the function gave them.

    Files of tasks that never ended are not seen; a journal that was never begun is empty.
    """
    schema = f"id {id_type}, score double, error string"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(journal)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "id " + id_type + ", score double")
    # Attempts are folders of their own; one that never finished a task is empty.
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(journal)
    return _one_each(rows.filter("error IS NULL").select("id", "score"))


OBJECTIVES["lookup"] = LookupObjective
OBJECTIVES["function"] = FunctionObjective
