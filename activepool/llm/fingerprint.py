"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. Runs of one symbol are one symbol; then deterministic coin tossing gives
each symbol a label from the lowest bit in which it differs from the symbol before it, four times, which
leaves six labels with no two equal neighbours; blocks begin at local maxima of the labels, so they have
two to a few symbols; a block's name is a hash of its symbols. A name depends on nothing but the symbols
of its block and a few around it, so equal substrings get equal names in their interior wherever they
stand. A document's phrases are the names of two levels (about ten and thirty characters); its
fingerprint is the smallest SKETCH of their hashes, and the likeness of two fingerprints is the share of
common phrases estimated from these.

Documents are brought into id order by range: boundaries are computed first, the first document of each
range is sent to the range before it as well, and each task walks its range once, so no order over all
documents is ever in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from activepool.llm.common import bounded, mix64, picked

SKETCH = 64
LEVELS = 3
#: Characters that are parsed together.
PARSE_CHARS = 150_000

_LOWEST = np.array([(x & -x).bit_length() - 1 if x else 0 for x in range(256)], np.uint8)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * (lowest bit that differs from the symbol before) + that bit; the first of a text takes bit 0."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = x[first] ^ np.array(1, x.dtype)
    if x.dtype == np.uint64:
        d = x ^ before
        at = np.frexp((d & (~d + np.uint64(1))).astype(np.float64))[1] - 1
        return (2 * at + ((x >> at.astype(np.uint64)) & np.uint64(1)).astype(np.int64)).astype(np.uint8)
    at = _LOWEST[x ^ before]
    return (2 * at + ((x >> at) & 1)).astype(np.uint8)


def parse_level(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the blocks of one level; ``text`` numbers the text of each symbol, in order."""
    change = np.empty(len(names), bool)
    change[0] = True
    np.not_equal(text[1:], text[:-1], out=change[1:])
    first = np.nonzero(change)[0]
    start = change.copy()
    start[1:] |= names[1:] != names[:-1]
    at = np.nonzero(start)[0]
    run = np.diff(np.append(at, len(names)))
    symbols, of = names[at], text[at]
    long = run > 1
    symbols = np.where(long, mix64(symbols + run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), symbols)
    first = np.searchsorted(at, first)
    # A run's new name may equal its neighbour's only by a hash collision; equal neighbours then share a label.
    label = symbols
    for _ in range(4):
        label = _toss(label, first)
    label = label.astype(np.int8)
    before, after = np.empty_like(label), np.empty_like(label)
    before[1:], after[:-1] = label[:-1], label[1:]
    before[first], after[-1] = 127, 127
    after[first[1:] - 1] = 127
    begin = (label > before) & (label > after)
    begin[first] = True
    at = np.nonzero(begin)[0]
    place = np.arange(len(symbols)) - np.repeat(at, np.diff(np.append(at, len(symbols))))
    parts = mix64(symbols ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return mix64(np.add.reduceat(parts, at)), of[at]


def phrases(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct phrase names (levels 2 and 3) of each text; an empty text has none."""
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    out = [np.empty(0, np.uint64)] * len(texts)
    if not len(of):
        return out
    names = mix64(np.concatenate(codes).astype(np.uint64) + np.uint64(1))
    found, owner = [], []
    for level in range(1, LEVELS + 1):
        names, of = parse_level(names, of)
        if level > 1:
            found.append(mix64(names + np.uint64(level)))
            owner.append(of)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[keep], owner[keep]
    ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
    return [found[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The smallest SKETCH phrase hashes (top 32 bits) of each text, a bounded number of characters at a time."""
    out, part, size = [], [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= PARSE_CHARS:
            out += [(p >> np.uint64(32)).astype(np.uint32)[:SKETCH] for p in phrases(part)]
            part, size = [], 0
    return out + [(p >> np.uint64(32)).astype(np.uint32)[:SKETCH] for p in phrases(part)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases; two fingerprints without phrases are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    whole = np.union1d(a, b)
    if len(a) >= SKETCH or len(b) >= SKETCH:
        whole = whole[:SKETCH]
    return float(np.isin(whole, np.intersect1d(a, b)).mean())


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; null is an empty text, whose fingerprint is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in bounded(batches, 4 << 20):
            marks = [_hex(s) for s in sketches([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(marks, pa.string())], schema=schema)

    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, fingerprint string")


_COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(batches):
    """Rows come by range and id, each range's last one being the first of the next range."""
    texts, ids, ranges, guests = [], [], [], []

    def out():
        """All but the last row, which waits for the row behind it."""
        n = len(ids) - 1
        pairs = [i for i in range(n) if not guests[i] and ranges[i] == ranges[i + 1]]
        edited = []
        for i in pairs:
            q = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - q] + texts[i + 1][:q])
        marks = sketches(texts + edited)
        rows = []
        for k, i in enumerate(pairs):
            mark, changed = marks[i], marks[len(texts) + k]
            rows.append((ids[i], len(texts[i]), hashlib.sha256(edited[k].encode()).hexdigest(), _hex(mark), _hex(changed),
                         likeness(mark, changed), likeness(mark, marks[i + 1])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COMPARED.types)], schema=_COMPARED)
        for column in (texts, ids, ranges, guests):
            del column[:n]

    for batch in bounded(batches, 2 << 20):
        texts += [t or "" for t in batch.column("text").to_pylist()]
        ids += batch.column("doc_id").to_pylist()
        ranges += batch.column("range").to_pylist()
        guests += batch.column("guest").to_pylist()
        yield from out()
    if ids:
        yield from out()


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses to that and to the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The edited
    text has its last quarter (rounded down) replaced by as many characters from the start of the next
    document by id; the last document is followed by the first.

    Edge cases: null is an empty text; rows that repeat an id follow each other by text; rows without an
    id come first; a single row follows itself; an empty table gives an empty one. Rows of one id are one
    range.
    """
    spark = docs.sparkSession
    rows = picked(docs, doc_id=id_col, text=text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = ordered.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000) if parts > 1 else F.lit(None)).first()[0]
    splits = [-float("inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    keyed = ordered.withColumn("key", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)))
    ranged = Bucketizer(splits=splits, inputCol="key", outputCol="range", handleInvalid="keep").transform(keyed)
    # The least (id, text) of each range: one row a range.
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("f")).collect()
    firsts = sorted((r["range"], r["f"]["doc_id"]) for r in firsts) if firsts else []
    heads = [(first, float(firsts[k - 1][0]), float(r)) for k, (r, first) in enumerate(firsts)]
    schema = "head long, before double, own double"
    heads = F.broadcast(spark.createDataFrame(heads, schema))
    guests = ranged.join(heads, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("range") == F.col("own")))
    # Of rows that repeat the first id, any may go: the task takes the least text.
    walk = ranged.select("doc_id", "text", "range", F.lit(0).alias("guest")).union(
        guests.select("doc_id", "text", F.col("before").alias("range"), F.lit(1).alias("guest"))
    )
    return (
        walk.repartition(parts, "range").sortWithinPartitions("range", "guest", F.asc_nulls_first("doc_id"), "text")
        .mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
