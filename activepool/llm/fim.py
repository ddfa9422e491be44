"""Fill-in-the-middle: texts are cut at two ranks of an indexable skip list and put together anew.

A text's units are runs of the letters A to Z and single other characters. The units of a batch of texts form
one skip list a text: lane 0 has a link for each unit, and a link of a higher lane spans the links between two
promoted nodes (one in four, by a hash of the node's place). Every link carries its width in units and in code
points. A cut rank is reached from the top lane: while a link's unit width still fits it is taken, else the
search goes one lane down; the code-point widths taken add up to the cut's place in the text. All cuts of a
batch go down together, each by its own links.

Where the cuts fall and which form a text takes are hashes of its id and a seed, so they are the same on every
run and partitioning. Rows stay where they are: there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from activepool.llm.common import bounded, mix64, picked

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares, in percent: texts that are transformed, and of these the ones with the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: One node in so many is promoted to the next lane.
PROMOTE = 4


class SkipLists:
    """One skip list for each text of a batch; ``texts`` gives the owner of each code point, in order."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        letter = ((codes | np.uint32(32)) - np.uint32(97)) < 26
        begins = np.ones(len(codes) + 1, bool)
        begins[1:-1] = ~(letter[1:] & letter[:-1])
        begins[ends] = True  # a text's end is a boundary whatever its neighbours are
        at = np.flatnonzero(begins[:-1])
        chars = np.diff(np.append(at, len(codes)))
        first = np.searchsorted(at, np.append(0, ends))  # each text's first link, and the end
        self.units = np.diff(first)
        place = np.arange(len(at)) - np.repeat(first[:-1], self.units)
        hashed = mix64(place.astype(np.uint64) + np.uint64(1))
        #: For each lane: unit widths, code-point widths, first link of each text, first link below of each link.
        self.lanes = [(np.ones(len(at), np.int64), chars.astype(np.int64), first, None)]
        while len(at) and (np.diff(self.lanes[-1][2]) > PROMOTE).any():
            units, chars, first, _ = self.lanes[-1]
            up = (hashed & np.uint64(PROMOTE - 1)) == 0
            up[first[:-1][np.diff(first) > 0]] = True
            nodes = np.flatnonzero(up)
            hashed = hashed[nodes] >> np.uint64(PROMOTE.bit_length() - 1)
            self.lanes.append(
                (np.add.reduceat(units, nodes), np.add.reduceat(chars, nodes), np.searchsorted(nodes, first), np.append(nodes, len(units)))
            )

    def chars_before(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Code points before the unit of each rank, of the text given with it."""
        units, chars = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        link = self.lanes[-1][2][texts]
        for lane_units, lane_chars, first, below in reversed(self.lanes):
            stop, moving = first[texts + 1], np.arange(len(ranks))
            while True:
                moving = moving[link[moving] < stop[moving]]
                moving = moving[units[moving] + lane_units[link[moving]] <= ranks[moving]]
                if not len(moving):
                    break
                units[moving] += lane_units[link[moving]]
                chars[moving] += lane_chars[link[moving]]
                link[moving] += 1
            if below is not None:
                link = below[link]
        return chars


_CUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                  ("middle_chars", pa.int64()), ("output", pa.string())])
_CUT_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _cut(changed: int, suffix_first: int):
    def run(batches):
        for batch in bounded(batches, 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            lists = SkipLists(codes, np.cumsum([len(t) for t in texts]))
            h = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
            a, b = h[0] % (lists.units + 1), h[1] % (lists.units + 1)
            every = np.arange(len(texts))
            heads = lists.chars_before(every, np.minimum(a, b))
            tails = lists.chars_before(every, np.maximum(a, b))
            forms, outputs = [], []
            for t, i, j, share, order in zip(texts, heads.tolist(), tails.tolist(), h[2] % 100, h[3] % 100):
                if not t or share >= changed or any(mark in t for mark in (PREFIX, SUFFIX, MIDDLE)):
                    forms.append("plain")
                    outputs.append(t)
                elif order < suffix_first:
                    forms.append("spm")
                    outputs.append(f"{SUFFIX}{t[j:]}{PREFIX}{t[:i]}{MIDDLE}{t[i:j]}")
                else:
                    forms.append("psm")
                    outputs.append(f"{PREFIX}{t[:i]}{SUFFIX}{t[j:]}{MIDDLE}{t[i:j]}")
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lists.units, pa.int64()), pa.array(forms, pa.string()),
                 pa.array(heads, pa.int64(), mask=plain), pa.array(tails - heads, pa.int64(), mask=plain), pa.array(outputs, pa.string())],
                schema=_CUT,
            )

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; n counts the text's units.

    ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain: the text as it is, for an
    empty text, one that holds a mark itself, or one beyond the share that is ``changed``. Cuts and form follow
    the SHA-256 of ``seed:id``.

    Edge cases: null is an empty text; a null id hashes as an empty one; repeated rows stay repeated and are cut
    alike; plain texts have null widths; an empty table gives an empty one.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *hashes).mapInArrow(_cut(changed, suffix_first), _CUT_DDL)


def restore(cut: DataFrame) -> DataFrame:
    """``cut`` with a column ``restored``: the text rebuilt from ``output`` and ``form`` alone.

    A changed text holds no mark, and no mark overlaps another, so each mark is found at its first occurrence.
    """
    body = F.substr(F.col("output"), F.lit(len(PREFIX) + 1))
    second = F.when(F.col("form") == "psm", SUFFIX).otherwise(PREFIX)
    rows = cut.withColumn("_first", F.substring_index(body, SUFFIX, 1)).withColumn("_first", F.when(F.col("form") == "psm", F.col("_first")).otherwise(F.substring_index(body, PREFIX, 1)))
    rows = rows.withColumn("_rest", F.substr(body, F.length("_first") + F.length(second) + 1))
    rows = rows.withColumn("_second", F.substring_index("_rest", MIDDLE, 1))
    middle = F.substr(F.col("_rest"), F.length("_second") + len(MIDDLE) + 1)
    whole = (
        F.when(F.col("form") == "plain", F.col("output"))
        .when(F.col("form") == "psm", F.concat("_first", middle, "_second"))
        .otherwise(F.concat("_second", middle, "_first"))
    )
    return rows.withColumn("restored", whole).drop("_first", "_rest", "_second")
