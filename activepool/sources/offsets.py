"""Positions in a Parquet table without an order over its rows.

The index has one row for each file: how many rows it holds and how many stand before it, in the order of the
file names. A position then names a file and a row in it, which the reader knows (``_metadata.row_index``), so a
slice or a draw reads the files that hold wanted rows, and no row of the table is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import number_rows, running_totals
from ..session import pinned

#: Wanted files are named in the scan up to this many; beyond, the scan goes over all files.
MOST_FILES = 1_000
#: Wanted positions go to the scan as a broadcast up to this many rows; beyond, wanted rows are shuffled.
MOST_SENT = 1_000_000

_FILE, _ROW = "_metadata.file_path", "_metadata.row_index"


class RowOffsets:
    """Rows of the Parquet table at ``path`` by position, from 0, in the order of file names and rows in a file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = spark.read.parquet(path)
        # Only footers are read: a count needs no column.
        sizes = self.table.groupBy(F.col(_FILE).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        numbered = number_rows(sizes, [F.col("file").asc()], name="_n")
        ended = running_totals(numbered, "_n", {"ends": F.col("rows")})
        self.index = pinned(ended.select("file", "rows", (F.col("ends") - F.col("rows")).alias("start")), "offsets")
        self.n = self.index.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def _holding(self, position: int) -> tuple[str, int]:
        """The file that holds a position, and the row in it."""
        row = self.index.filter((F.col("start") <= position) & (F.col("start") + F.col("rows") > position)).first()
        return row["file"], position - row["start"]

    def slice(self, start: int, stop: int) -> DataFrame:
        """Rows at positions start..stop-1; files before the first and behind the last are not read."""
        start, stop = max(start, 0), min(stop, self.n)
        if start >= stop:
            return self.table.limit(0)
        first, a = self._holding(start)
        last, b = self._holding(stop - 1)
        file, row = F.col(_FILE), F.col(_ROW)
        inside = (file >= first) & (file <= last)
        edges = ((file > first) | (row >= a)) & ((file < last) | (row <= b))
        return self.table.filter(inside & edges)

    def positions(self) -> DataFrame:
        """The whole table with its positions as ``_pos``; rows stay where they are."""
        named = self.table.select("*", F.col(_FILE).alias("_file"), F.col(_ROW).alias("_row"))
        index = self.index.select(F.col("file").alias("_file"), "start")
        if self.index.count() <= MOST_SENT:
            index = F.broadcast(index)
        return named.join(index, "_file").withColumn("_pos", F.col("start") + F.col("_row")).drop("_file", "_row", "start")

    def take(self, wanted: DataFrame, position: str = "pos") -> DataFrame:
        """``wanted`` joined to the rows at its positions; positions outside the table give no row.

        Positions may repeat. The wanted ones are counted: while they are few they are sent to the scan of the
        files that hold them.
        """
        wanted = pinned(wanted.filter((F.col(position) >= 0) & (F.col(position) < self.n)), "wanted")
        placed = pinned(_place(wanted, self.index, position), "placed")
        table, files = self.table, placed.select("_file").distinct()
        names = [r["_file"] for r in files.limit(MOST_FILES + 1).collect()]
        if len(names) <= MOST_FILES:
            table = table.filter(F.col(_FILE).isin(names)) if names else table.limit(0)
        rows = table.select("*", F.col(_FILE).alias("_file"), F.col(_ROW).alias("_row"))
        if wanted.count() <= MOST_SENT:
            placed = F.broadcast(placed)
        return rows.join(placed, ["_file", "_row"]).drop("_file", "_row")


def _place(wanted: DataFrame, index: DataFrame, position: str) -> DataFrame:
    """Each wanted position with its file and its row there.

    Files and positions are brought into blocks of the position axis; a file lies in every block that it
    reaches, so the join is one on equal blocks.
    """
    held = index.filter("rows > 0")
    width = held.agg(F.greatest(F.avg("rows").cast("long"), F.lit(1))).first()[0] or 1
    block = lambda c: F.floor(c / F.lit(width))
    files = held.select(
        F.col("file").alias("_file"), "start", "rows",
        F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("rows") - 1))).alias("_block"),
    )
    at: Column = F.col(position)
    joined = wanted.withColumn("_block", block(at)).join(files, "_block")
    inside = joined.filter((at >= F.col("start")) & (at < F.col("start") + F.col("rows")))
    return inside.withColumn("_row", at - F.col("start")).drop("_block", "start", "rows")


def draw_positions(spark: SparkSession, n: int, k: int, repeats: int, seed) -> DataFrame:
    """``(rep, draw, pos)``: ``repeats`` samples of k positions below n each, with replacement."""
    from ..functions import hash_uniform

    pos = F.floor(hash_uniform(F.col("id"), f"draw/{seed}") * F.lit(n))
    return spark.range(k * repeats).select(
        F.floor(F.col("id") / F.lit(k)).alias("rep"), F.pmod(F.col("id"), F.lit(k)).alias("draw"), pos.alias("pos")
    )


def draw_stored(offsets: RowOffsets, k: int, repeats: int, seed) -> DataFrame:
    """``repeats`` samples of k stored rows each, with replacement: ``(rep, draw, row)``."""
    return offsets.take(draw_positions(offsets.spark, offsets.n, k, repeats, seed)).drop("pos")
