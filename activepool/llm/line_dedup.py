"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Lines of a document are numbered; each run of ``window`` consecutive lines is one window, named by the
hashes of its lines. Windows that occur more than once anywhere are found by one aggregate (their first
occurrence is the smallest document id and position); every later occurrence covers its lines, covered
positions are merged, and the document is put together again without them. Blank lines neither count as
lines nor end a window.

A document of fewer filled lines than a window has is one window of its own, padded: it meets only documents of
exactly these lines. Texts are not moved with the windows: windows are a few numbers, and only documents that lose lines are
joined back. A window that a large part of all documents share is counted by partial aggregates, and its
occurrences meet its one first place in a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from activepool.llm.common import picked
from activepool.session import pinned


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(text: Column) -> Column:
    """(position, hash) of the lines that aren't blank, outer blanks trimmed."""
    blank = "\\s+$|^\\s+"
    numbered = F.transform(
        _lines(text), lambda line, i: F.struct(i.alias("pos"), F.regexp_replace(line, blank, "").alias("line"))
    )
    filled = F.filter(numbered, lambda x: x["line"] != "")
    return F.transform(filled, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("h")))


def _bound(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with the array as a column that lambdas may index without computing it again."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """(doc_id, text_hash, left): for each document that loses lines, the positions (from 0) that stay."""
    rows = picked(docs, doc_id=id_col, text=text_col).where("text IS NOT NULL")
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(_lines(F.col("text"))).alias("n"), "text")
    lined = _bound(rows, "ls", _filled(F.col("text"))).where(F.size("ls") > 0)
    parts = lambda i: [F.element_at("ls", i + k) for k in range(window)]

    def struct(hashes, first: Column, last: Column, size) -> Column:
        return F.struct(
            F.xxhash64(*hashes).alias("w1"), F.xxhash64(size, *reversed(hashes)).alias("w2"), first["pos"].alias("at"), last["pos"].alias("to")
        )

    # A place past the end gives null, which a window's hash passes over; the size in the second hash tells it apart.
    short = [F.get("ls", F.lit(k))["h"] for k in range(window - 1)]
    padded = struct(short, F.element_at("ls", 1), F.element_at("ls", -1), -F.size("ls"))
    whole = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("ls") - (window - 1), F.lit(1))),
        lambda i: struct([p["h"] for p in parts(i)], parts(i)[0], parts(i)[-1], F.lit(window)),
    )
    windows = F.when(F.size("ls") >= window, whole).otherwise(F.array(padded))
    wide = pinned(
        lined.select("doc_id", "text_hash", "n", F.explode(windows).alias("w")).select("doc_id", "text_hash", "n", "w.*"),
        "line-windows",
    )
    here = F.struct("doc_id", "text_hash", "at")
    repeated = wide.groupBy("w1", "w2").agg(F.count("*").alias("times"), F.min(here).alias("first")).where("times > 1")
    later = wide.join(repeated.drop("times"), ["w1", "w2"]).where(here > F.col("first"))
    return (
        later.select("doc_id", "text_hash", "n", F.explode(F.sequence("at", "to")).alias("pos")).distinct()
        .groupBy("doc_id", "text_hash", "n").agg(F.collect_list("pos").alias("covered"))
        .select("doc_id", "text_hash", F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "covered").alias("left"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with later occurrences of repeated windows removed from the text, and ``n_removed`` lines.

    The first occurrence (smallest id, then position) stays whole; blank lines inside a removed window go
    with it. Documents left without lines get an empty text and stay as rows. Edge cases: null texts stay
    null; a document of fewer than ``window`` filled lines loses them if an earlier document has exactly
    these; windows repeated inside one document count too; rows that repeat both id and text count as one document and
    get the same result, so do rows without an id and of the same text; an empty table gives an empty
    one. Other columns are untouched (a column named ``n_removed`` is replaced).
    """
    left = covered_lines(docs, id_col, text_col, window).toDF("__id", "__hash", "__left")
    others = [c for c in docs.columns if c != "n_removed"]
    text = F.col(f"`{text_col}`")
    joined = docs.select(*[F.col(f"`{c}`") for c in others]).join(
        left, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left"
    )
    joined = _bound(joined, "__lines", F.when(F.col("__left").isNotNull(), _lines(text)))
    stay = F.array_join(F.transform("__left", lambda i: F.element_at("__lines", i + 1)), "\n")
    cleaned = F.when(F.col("__left").isNull(), text).otherwise(stay)
    return joined.select(
        *[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in others],
        F.coalesce(F.size("__lines") - F.size("__left"), F.lit(0)).cast("long").alias("n_removed"),
    )
