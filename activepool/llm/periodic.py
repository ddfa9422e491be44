"""Periodic runs of words: seeds on diagonals, extended once each.

A run is a stretch of words with smallest period q, at least ``least`` words and two periods long, that can't
grow on either side. On the diagonal of lag q (each word against the one q later) it is a stretch of equal pairs
of at least max(least - q, q), so each class of lags has a least overlap M that every run of it is certain to
have. The class indexes k-grams, k below M, and looks them up at every (M - k + 1)-th word: one of these seeds
lies inside the overlap. Same-document occurrence pairs (seed, later place) with a lag of the class are listed;
classes double, and k with them, so there are at most about two pairs a word in a class even where one word
fills the text.

On each diagonal the seeds come in order, and a table of the furthest place covered so far (by lag) passes over
every seed that follows the one before it: such seeds lie in one stretch, which is extended once, to the left of
its first and to the right of its last seed. Extension goes by names of 1, 2, 4, ... words (64-bit hashes of
pairs of names), halving the step. Of stretches that are the same words with several lags the smallest is the
period. At the end every run's words are compared themselves, and a document where a hash misled (none is known)
is searched diagonal by diagonal.

A document is one row; documents are worked on in bounded batches where they are read, without a shuffle.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from activepool.llm.common import bounded, mix64, picked, texts_of

#: Least words of a run.
LEAST = 12
#: Text of a batch whose words are looked at together.
BATCH_BYTES = 1 << 20


def _classes(least: int, longest: int):
    """(first lag, end of lags, least overlap) of each class, for documents of up to ``longest`` words."""
    overlap = (least + 1) // 2
    low, high = 1, 1 << overlap.bit_length()
    while 2 * low <= longest:
        yield low, high, overlap
        low, high, overlap = high, 2 * high, high


class _Names:
    """Names of the 1, 2, 4, ... words from each place on; a place too near the end has none of its own."""

    def __init__(self, codes: np.ndarray):
        self.levels = [mix64(codes.astype(np.uint64) + np.uint64(1))]

    def __getitem__(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            last = self.levels[-1]
            step = 1 << (len(self.levels) - 1)
            after = np.zeros_like(last)
            after[:-step] = last[step:]
            self.levels.append(mix64(last * np.uint64(0x9E3779B97F4A7C15) ^ mix64(after + np.uint64(len(self.levels)))))
        return self.levels[level]


def _pairs(names: np.ndarray, k: int, stride: int, low: int, high: int, begin: np.ndarray, end: np.ndarray, scale: int):
    """(place, later place) of every pair of equal k-grams, the first at a seed, with a lag of the class."""
    at = np.flatnonzero((end - begin >= 2 * low) & (np.arange(len(names)) + k <= end))
    seeds = at[((at - begin[at]) % stride == 0) & (at + low + k <= end[at])]
    grams = np.unique(names[seeds])
    if not len(grams):
        return seeds, seeds
    which = np.minimum(np.searchsorted(grams, names[at]), len(grams) - 1)
    same = grams[which] == names[at]
    at, which = at[same], which[same]
    often = np.bincount(which, minlength=len(grams)) > 1
    index = np.sort((which * scale + at)[often[which]])
    gram = np.searchsorted(grams, names[seeds])
    seeds, gram = seeds[often[gram]], gram[often[gram]]
    first = np.searchsorted(index, gram * scale + seeds + low)
    last = np.searchsorted(index, gram * scale + np.minimum(seeds + high - 1, end[seeds] - k), side="right")
    n = np.maximum(last - first, 0)
    ends = np.cumsum(n)
    later = index[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    return np.repeat(seeds, n), later - np.repeat(gram, n) * scale


def _by_diagonals(codes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of one document, by a look at each whole diagonal."""
    found = {}
    for q in range(1, len(codes) // 2 + 1):
        equal = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        turns = np.flatnonzero(equal[1:] != equal[:-1])
        for s, t in turns.reshape(-1, 2).tolist():
            if t - s >= max(least - q, q):
                found.setdefault((s, t + q), q)
    return [(s, e, q) for (s, e), q in found.items()]


def find_runs(codes: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period), by start and period, of the runs of documents that follow each other in ``codes``."""
    starts = np.append(0, ends[:-1]).astype(np.int64)
    sizes = ends - starts
    begin, end = np.repeat(starts, sizes), np.repeat(ends, sizes)
    names, scale, found = _Names(codes), len(codes) + 1, []
    top = len(codes) - 1
    for low, high, overlap in _classes(least, int(sizes.max(initial=0))):
        level = max(0, (overlap - 1).bit_length() - 1)
        k = 1 << level
        stride = overlap - k + 1
        i, j = _pairs(names[level], k, stride, low, high, begin, end, scale)
        if not len(i):
            continue
        i = np.sort((j - i) * scale + i)
        lag, i = i // scale, i % scale
        # A seed one stride behind the one before it, on the same diagonal, lies in what that one covers.
        new = np.ones(len(i), bool)
        new[1:] = (lag[1:] != lag[:-1]) | (i[1:] != i[:-1] + stride) | (begin[i[1:]] != begin[i[:-1]])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(i)) - 1
        q, s, t = lag[head], i[head], i[tail] + k
        first, last = begin[s], end[s]
        for step in range(level, -1, -1):
            of, w = names[step], 1 << step
            s = np.where((s - w >= first) & (of[np.maximum(s - w, 0)] == of[np.maximum(s - w + q, 0)]), s - w, s)
            t = np.where((t + q + w <= last) & (of[np.minimum(t, top)] == of[np.minimum(t + q, top)]), t + w, t)
        whole = t - s >= np.maximum(least - q, q)
        found.append(np.stack([s[whole], t[whole] + q[whole], q[whole]], axis=1))
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[keep]
    misled = {int(begin[s]) for s, e, q in runs.tolist() if not np.array_equal(codes[s : e - q], codes[s + q : e])}
    if misled:
        runs = runs[~np.isin(begin[runs[:, 0]], list(misled))]
        again = [(b + s, b + e, q) for b in misled for s, e, q in _by_diagonals(codes[b : int(end[b])], least)]
        runs = np.concatenate([runs, np.array(again, np.int64).reshape(-1, 3)])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_FOUND_DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _found(least: int):
    def run(batches):
        for batch in bounded(batches, BATCH_BYTES):
            words = [(t or b"").split() for t in texts_of(batch.column("text"))]  # bytes: ASCII blanks only
            known: dict[bytes, int] = {}
            codes = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64)
            sizes = np.array([len(ws) for ws in words], np.int64)
            ends = np.cumsum(sizes)
            runs = find_runs(codes, ends, least)
            dropped = np.zeros(len(codes) + 1, np.int64)
            np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
            np.add.at(dropped, runs[:, 1], -1)
            stays = np.cumsum(dropped)[:-1] == 0
            of = np.searchsorted(ends, runs[:, 0], side="right")
            texts = []
            hit = np.zeros(len(words), bool)
            hit[of] = True
            for k, ws in enumerate(words):
                texts.append(b" ".join(compress(ws, stays[ends[k] - sizes[k] : ends[k]].tolist()) if hit[k] else ws).decode())
            rows = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (runs[:, 0] - (ends - sizes)[of], runs[:, 1] - runs[:, 0], runs[:, 2])], fields=list(_RUN)
            )
            bounds = np.searchsorted(of, np.arange(len(words) + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.string())], schema=_FOUND
            )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` lists (start, length, period) in words, by start and period; ``collapsed`` is the text without the
    words of a run behind its first period, the words that stay joined by one space. Words are what stands
    between ASCII blanks.

    Edge cases: null and blank texts have no words, no runs and an empty collapsed text; null ids stay; repeated
    rows stay repeated; an empty table gives an empty one.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    rows = picked(docs, doc_id=id_col, text=text_col)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found(least), _FOUND_DDL)
