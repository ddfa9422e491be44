import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def small():
    """The smallest scale folder, if the driver's tables are there."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not Path(folder, "documents.parquet").exists():
        pytest.skip("no test tables")
    return folder


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text) pairs, with extra columns whose names the operators use inside."""

    def build(pairs, extra=True):
        df = spark.createDataFrame([(i, t) for i, t in pairs], "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F

            for name in ("cid", "shard", "n", "key", "w", "token", "kind", "pos", "ids", "range"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build
