"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; everything else is unlabelled web text (documents
labelled 0 are only among it). A logistic model over features of the whole text minimises the
non-negative unbiased risk

    prior * R(positives, +) + max(0, R(unlabelled, -) - prior * R(positives, -))

where a step that would push the second part below zero goes the other way instead. The class prior is
estimated first: the share of unlabelled text at or above a score, over the same share of positives, can
not be less than the prior, so its smallest value over all thresholds (with a margin for few documents)
bounds it. The histograms for it are counted over the whole corpus; the fit reads a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from activepool.llm.common import bounded, maybe_broadcast, picked, texts_of
from activepool.session import pinned

#: Documents that the fit reads, of positives and of unlabelled text each, chosen by a hash of the id.
FIT_ROWS = 8_000
STEPS = 400
BINS = 1_000
REJECT_BELOW = 0.7
FEW_WORDS = 12

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True
FEATURES = 20


def text_features(text: bytes | None) -> np.ndarray:
    """Shares of character kinds, word forms and repetitions over the whole text; an empty text has its own mark."""
    out = np.zeros(FEATURES)
    if not text:
        out[0] = 1
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    n = counts.sum()
    letters = counts[_UPPER].sum() + counts[_LOWER].sum()
    marks = n - letters - counts[_DIGIT].sum() - counts[_SPACE].sum()
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[1] = counts[_UPPER].sum() / max(letters, 1)
    out[2] = marks / n
    out[3] = (marks - counts[_STOP].sum()) / n
    out[4] = counts[33] / n
    out[5] = counts[_DIGIT].sum() / n
    out[6] = counts[_SPACE].sum() / n
    share = counts[counts > 0] / n
    out[7] = -(share * np.log2(share)).sum() / 8
    if words:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        kinds, times = np.unique(words, return_counts=True)
        out[8] = min(lens.mean() / 20, 2)
        out[9] = min(lens.std() / 20, 2)
        out[10] = len(kinds) / len(words)
        out[11] = times.max() / len(words)
        out[12] = np.mean([a == b for a, b in zip(words, words[1:])]) if len(words) > 1 else 0
        out[13] = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / len(words)
        out[14] = sum(w.isupper() for w in words) / len(words)
        out[15] = np.log1p(len(words)) / 10
        out[16] = sum(not any(_LOWER[c] or _UPPER[c] for c in w) for w in words) / len(words)
    if lines:
        out[17] = 1 - len(set(lines)) / len(lines)
        out[18] = min(len(words) / len(lines) / 100, 2)
        out[19] = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
    return out


def _featured(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("x", pa.list_(pa.float32()))])
    for batch in bounded(batches):
        x = [text_features(t).astype(np.float32) for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(x, pa.list_(pa.float32()))], schema=schema)


class Scaled:
    """A logistic model over standardised features and their squares."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        self.mean, self.deviation = mean, deviation
        self.w = np.zeros(2 * len(mean) + 1)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        # Shares of a few words say little: they count less, as if the rest of the text were an average one.
        words = np.expm1(10 * x[:, 15])
        z = z * (words / (words + FEW_WORDS))[:, None]
        return np.hstack([z, z * z - 1, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.w, -30, 30)))


def fit_nonnegative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05,
                    ridge: float = 1e-3) -> Scaled:
    """Full-batch Adam on the non-negative risk with the logistic loss."""
    every = np.vstack([positive, unlabelled])
    model = Scaled(every.mean(axis=0), every.std(axis=0) + 1e-6)
    p, u = model.design(positive), model.design(unlabelled)
    m, v = np.zeros_like(model.w), np.zeros_like(model.w)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ model.w, -30, 30))) for x in (p, u))
        plus = p.T @ (sp - 1) / len(p)
        minus_p, minus_u = p.T @ sp / len(p), u.T @ su / len(u)
        rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gradient = prior * plus + minus_u - prior * minus_p if rest >= 0 else prior * minus_p - minus_u
        gradient = gradient + ridge * model.w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        model.w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Bound of the share of positives in unlabelled text from two score histograms (low to high)."""
    if not positive.sum() or not unlabelled.sum():
        return 0.5
    p, u = (np.cumsum(h[::-1]) / h.sum() for h in (positive, unlabelled))
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(positive.sum()) + 1 / np.sqrt(unlabelled.sum()))
    ratio = (u + margin) / np.maximum(p - margin, 1e-9)
    best = int(np.argmin(np.where(p > 4 * margin, ratio, np.inf))) if (p > 4 * margin).any() else len(p) - 1
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.05, 0.95))


def _scored(model: Scaled):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(model.score(x))], schema=schema)

    return run


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    few = rows.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id", F.xxhash64("x")).limit(most)
    return np.array([r["x"] for r in few.select("x").collect()], np.float64).reshape(-1, FEATURES)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   learn=None, fit_rows: int = FIT_ROWS, threshold: float = REJECT_BELOW) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; score is the chance that its quality is 1.

    ``learn`` is a condition on ``doc_id``: only labels of these ids are looked at. The fit reads at most
    ``fit_rows`` positives and as many unlabelled documents; features, prior and scores cover all rows.

    Edge cases: null and empty texts are scored like each other; without any positive label every score is
    1 (nothing is rejected); repeated rows stay, a label repeated for an id counts once (the largest); an
    empty table gives an empty one.
    """
    return _scores(docs, labels, id_col, text_col, label_col, learn, fit_rows, threshold).drop("text_hash")


def _scores(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality", learn=None,
            fit_rows: int = FIT_ROWS, threshold: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``quality_scores`` with the hash of their text."""
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    featured = pinned(rows.mapInArrow(_featured, "doc_id long, text_hash long, x array<float>"), "quality-features")
    known = picked(labels, doc_id=id_col, label=label_col)
    if learn is not None:
        known = known.where(learn(F.col("doc_id")))
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    trusted = pinned(known.where("label = 1").select("doc_id"), "quality-trusted")
    marked = featured.join(trusted.withColumn("trusted", F.lit(1)), "doc_id", "left")
    marked = pinned(marked.select("doc_id", "x", F.coalesce("trusted", F.lit(0)).alias("trusted")), "quality-marked")
    positive, unlabelled = _sample(marked.where("trusted = 1"), fit_rows), _sample(marked.where("trusted = 0"), fit_rows)
    if not len(positive) or not len(unlabelled):
        return featured.select("doc_id", "text_hash", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    prior = 0.5
    for _ in range(3):
        # The prior is read off the scores of all rows, not of the sample.
        model = fit_nonnegative(positive, unlabelled, prior)
        bins = (
            marked.mapInArrow(_binned(model), "trusted int, bin int, n long").groupBy("trusted", "bin").agg(F.sum("n").alias("n")).collect()
        )  # at most 2 * BINS rows
        histogram = np.zeros((2, BINS))
        for r in bins:
            histogram[r["trusted"], r["bin"]] += r["n"]
        found = estimate_prior(histogram[1], histogram[0])
        if abs(found - prior) < 0.01:
            break
        prior = found
    return featured.mapInArrow(_scored(model), "doc_id long, text_hash long, score double").select(
        "doc_id", "text_hash", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _binned(model: Scaled):
    schema = pa.schema([("trusted", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, FEATURES)
                at = np.minimum((model.score(x) * BINS).astype(np.int64), BINS - 1)
                np.add.at(counts, (np.asarray(batch.column("trusted")), at), 1)
        of, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[of, at])], schema=schema)

    return run


def without_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns unchanged, rows without id stay.

    Decided by row: of an id that repeats with several texts, only the rejected ones go.
    """
    gone = _scores(docs, labels, id_col, text_col, **options).where("predicted = 0 AND doc_id IS NOT NULL")
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    same = (F.col(f"`{id_col}`") == F.col("__gone")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__hash"))
    return docs.join(maybe_broadcast(pinned(gone, "quality-gone")), same, "left_anti")
