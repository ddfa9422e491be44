"""The training-text pipeline: five stages over the documents, each written and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. Labels and benchmark items are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from activepool.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from activepool.llm.queries import table, tokenizer_path
from activepool.session import scratch_path, scratch_scope


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of three-line windows; documents left without any word go.

    Documents that had no word before (null or blank texts) lose nothing and stay.
    """
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", "\\s+", " ")) == "")
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that are left."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("near dedup", one_of_near_copies),
    ("decontamination", no_benchmark),
    ("bpe encoding", encoded),
]

#: Three stages fit or hash what SQL can't say; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next reads it.

    The tables that a stage makes on its way are deleted when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        with scratch_scope(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
