"""Language identification by hierarchical discrimination.

A first linear classifier names the language family; inside the family, one-versus-one linear support
vector machines vote between its languages. Features are hashed pairs and triples of bytes of the whole
text, lower-cased, with everything but letters as one blank. The machines are fitted on a bounded sample
of labelled documents (FIT_ROWS for each language, chosen by a hash of the id) and applied where the texts
are read; a text is a sum over its bytes, so no vector leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from activepool.llm.common import bounded, picked
from activepool.session import pinned

#: Labelled documents of each language that the fit reads.
FIT_ROWS = 1_500
WIDTH = 1 << 12
UNDETERMINED = "und"

#: Closely related languages; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es pt it ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk ky uz tt".split(),
    "indic": "hi bn mr gu pa ur ne".split(),
}
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a character is of Unicode category L; number signs such as superscripts are none."""
    return any(map(str.isalpha, text or ""))


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def grams(text: str) -> np.ndarray:
    """Normalised square roots of the hashed counts of byte pairs and triples."""
    data = b" " + b" ".join(text.encode().translate(_FOLD).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    pair = b[:-1] << np.uint32(8) | b[1:]
    triple = pair[:-1] << np.uint32(8) | b[2:]
    codes = np.concatenate([pair + np.uint32(1 << 25), triple])
    x = np.sqrt(np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=WIDTH)).astype(np.float32)
    return x / np.linalg.norm(x)


def fit_machine(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Linear support vector machine (squared hinge) for y of -1 and 1, classes weighted alike; bias last."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    y, weight = y.astype(x.dtype), weight.astype(x.dtype)  # one type: no copy of x in a step
    w, look, speed = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype), 1.0
    rate = x.dtype.type(1 / (2 * 2 + ridge))  # rows have a norm of sqrt(2)
    ridge = x.dtype.type(ridge)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - rate * (ridge * look - 2 * (x.T @ (weight * y * slack)))
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        look, w, speed = new + x.dtype.type((speed - 1) / faster) * (new - w), new, faster
    return w


def _votes(machines: dict, names: list[str], x: np.ndarray) -> tuple[str, float]:
    """Winner of one-versus-one votes (ties: the larger sum of margins) and its weakest squashed margin."""
    if len(names) == 1:
        return names[0], 1.0
    votes, margins, weakest = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
    for (a, b), w in machines.items():
        margin = float(x @ w[:-1] + w[-1])
        for name, m in ((a, margin), (b, -margin)):
            votes[name] += m > 0
            margins[name] += m
            weakest[name] = min(weakest[name], 1 / (1 + np.exp(-np.clip(3 * m, -30, 30))))
    best = max(names, key=lambda n: (votes[n], margins[n]))
    return best, weakest[best]


class Hierarchy:
    """The family classifier and the machines inside each family."""

    def __init__(self, languages: list[str], machines: dict[tuple[str, str, str], np.ndarray]):
        """``machines`` has one for each pair of families and for each pair of languages of one family."""
        self.languages = {f: sorted(n for n in languages if family_of(n) == f) for f in sorted(set(map(family_of, languages)))}
        self.top = {(a, b): machines["/", a, b] for a, b in combinations(self.languages, 2)}
        self.inside = {f: {(a, b): machines[f, a, b] for a, b in combinations(names, 2)} for f, names in self.languages.items()}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.languages:
            return UNDETERMINED, 0.0
        x = grams(text)
        family, sure = _votes(self.top, list(self.languages), x)
        language, surer = _votes(self.inside[family], self.languages[family], x)
        return language, sure * surer


def _grams_of(batches):
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])
    for batch in bounded(batches):
        at = [k for k, t in enumerate(batch.column("text")) if has_letter(t.as_py())]
        x = [grams(batch.column("text")[k].as_py()).astype(np.float16).tobytes() for k in at]
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(at, pa.int64())), pa.array(x, pa.binary())], schema=schema)


def _pairs_of(languages: list[str]) -> list[tuple[str, str, str, str]]:
    """(level, first, second, language) for each machine and each language whose texts it is fitted on.

    The level is ``/`` between families, else the family.
    """
    families = sorted(set(map(family_of, languages)))
    out = [("/", a, b, n) for a, b in combinations(families, 2) for n in languages if family_of(n) in (a, b)]
    for f in families:
        out += [(f, a, b, n) for a, b in combinations(sorted(n for n in languages if family_of(n) == f), 2) for n in (a, b)]
    return out


def _fit_pair(key, table):
    level, a, b = (k.as_py() for k in key)
    table = table.sort_by([("lang", "ascending"), ("x", "ascending")])  # sums don't depend on the order of arrival
    of = np.array([family_of(n) if level == "/" else n for n in table.column("lang").to_pylist()])
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    w = fit_machine(x, np.where(of == a, 1.0, -1.0))
    return pa.table({"level": [level], "a": [a], "b": [b], "w": [w.astype(np.float64).tobytes()]})


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Hierarchy:
    """The hierarchy learned from a bounded sample of ``docs`` (null languages and texts are left out).

    The sample is the ``fit_rows`` rows of each language with the smallest hashes of their ids, found in one pass.
    Each machine is fitted in a task of its own, from the sample rows of its two sides; weights alone come back.
    """
    rows = picked(docs, doc_id=id_col, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("langid")), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= fit_rows)
    chosen = pinned(chosen.select("doc_id", "lang"), "langid-sample").distinct()
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"])  # at most fit_rows ids a language
    found = pinned(texts.select("lang", "text").mapInArrow(_grams_of, "lang string, x binary"), "langid-grams")
    languages = sorted(r["lang"] for r in found.select("lang").distinct().collect())  # one row a language
    pairs = _pairs_of(languages)
    if not pairs:
        return Hierarchy(languages, {})
    of = F.broadcast(docs.sparkSession.createDataFrame(pairs, "level string, a string, b string, lang string"))
    machines = (
        found.join(of, "lang").groupBy("level", "a", "b").applyInArrow(_fit_pair, "level string, a string, b string, w binary").collect()
    )
    return Hierarchy(languages, {(r["level"], r["a"], r["b"]): np.frombuffer(r["w"]) for r in machines})


def identify(docs: DataFrame, model: Hierarchy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` with score 0 where the text is null or has no letter.

    Edge cases: repeated rows stay; very long texts are read whole; a model without languages says
    ``und``; an empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in bounded(batches):
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([n for n, _ in found], pa.string()), pa.array([float(s) for _, s in found])],
                schema=schema,
            )

    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_held_out(docs: DataFrame, learn: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang") -> DataFrame:
    """Fits on the rows whose id meets ``learn`` and identifies all: (doc_id, held_out, lang_pred, score)."""
    learns = F.coalesce(learn(F.col(f"`{id_col}`")), F.lit(False))
    model = fit(docs.where(learns), lang_col, id_col, text_col)
    found = identify(docs, model, id_col, text_col)
    return found.select("doc_id", (~F.coalesce(learn(F.col("doc_id")), F.lit(False))).alias("held_out"), "lang_pred", "score")
