"""Helpers shared by the text operators: column picking, batch loops, hashes, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from activepool.session import pinned

#: A table of ids is broadcast only while it has at most this many rows (8 bytes each); beyond, joins shuffle.
BROADCAST_IDS = 1_000_000


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so further columns of ``df`` can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def texts_of(column: pa.Array | pa.ChunkedArray):
    """The values of a string column as UTF-8 bytes (None for null), one after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return (x.as_py() for x in column.cast(pa.binary()))


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker lives on from task to task, and what it keeps
    for itself is missed by the stages after, whose work may lie in the JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other systems go without
    if trim is not None:
        trim(0)


def gives_back(run):
    """A task function over whole groups; what it and the one before have freed is given back at both its ends."""

    def lean(*tables):
        give_back()
        try:
            return run(*tables)
        finally:
            give_back()

    # Spark looks at the number of arguments.
    return (lambda left, right: lean(left, right)) if run.__code__.co_argcount == 2 else (lambda table: lean(table))


def bounded(batches, most_bytes: int = 8 << 20):
    """Slices Arrow batches so that one slice holds about ``most_bytes`` (one row at least).

    What the worker's task before has freed, and this one at its last batch, is given back.
    """
    give_back()
    yield from _sliced(batches, most_bytes)
    give_back()


def _sliced(batches, most_bytes: int):
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * most_bytes / max(batch.nbytes, 1)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an unsigned array; overflow wraps."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from mixed 64-bit keys: the same on every run and partitioning."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def bucket(column: Column, of: int) -> Column:
    """The remainder of a document's CRC-32, taken over its id as text (folds of the contracts)."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % of


def maybe_broadcast(ids: DataFrame) -> DataFrame:
    """Marks a written table of ids for broadcast if its counted size is within BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node in ``links(a, b)``; label is the smallest node reachable.

    Minimum labels travel along links and each round then follows label to label, so long chains
    shorten to half; every round is a written table. A node with very many links only meets partial
    minima and skew-split joins.
    """
    edges = pinned(
        links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), f"{name}-edges"
    )
    labels = pinned(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), name)
    few = labels.count() <= BROADCAST_IDS
    sent = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    while True:
        near = (
            edges.join(sent(labels.select(F.col("node").alias("b"), "label")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = near.join(sent(labels), "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        step = pinned(
            lower.join(sent(jump), "low", "left").select(
                "node", F.least("low", F.coalesce("further", "low")).alias("new"), "label"
            ),
            name,
        )
        changed = step.where("new != label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
