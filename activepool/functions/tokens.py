"""Text keys to tokens, vocabulary ids and hashed token features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from .numbers import let

# The token pattern of the chemical line notation and the special tokens.
LINE_NOTATION = (
    r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|\%[0-9]{2}|[0-9])"
)
#: The same tokens: single symbols are one class, so a symbol is tested once and not against each in turn.
LINE_TOKENS = r"(\[[^\]]+]|Br?|Cl?|[NOSPFIbcnosp().=#\-+\\/:~@?>*$0-9]|%[0-9]{2})"
SPECIAL_TOKENS = ("<bos>", "<eos>", "<pad>", "<mask>")
BOS, EOS, PAD, MASK = range(4)

WORDS = r"([^ \n\t\r]+)"

KEY_SYMBOLS = tuple("BCNOSPFIbcnosp()=#-+/:@*0123456789")
KEY_COUNT = 167
#: How far a minimum hash moves for each empty bin that borrows it.
EMPTY_STEP = 40_503


def tokenize(text: Column, pattern: str = LINE_NOTATION) -> Column:
    pattern = LINE_TOKENS if pattern == LINE_NOTATION else pattern
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def detokenize(tokens: Column) -> Column:
    return F.trim(F.array_join(tokens, ""))


def fully_tokenized(text: Column, pattern: str = LINE_NOTATION) -> Column:
    """Non-blank and made of tokens only. Linear in the text: no repeated group is matched."""
    rest = F.regexp_replace(text, pattern, "")
    return F.coalesce((F.length(F.trim(text)) > 0) & (F.length(rest) == 0), F.lit(False))


def slot_of(gram: Column, length: int) -> Column:
    """Hash slot in 0..length-1, as a column; ``feature_slots`` takes the same slots in its tasks."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint"), F.lit(length)).cast(
        "int"
    )


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens; empty when the text is shorter."""
    last = F.size(tokens) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def token_pairs(tokens: Column, gap: int) -> Column:
    """Pairs of tokens ``gap`` apart, tagged with the gap."""
    last = F.size(tokens) - gap
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.concat_ws(
            " ", F.element_at(tokens, i), F.lit(str(gap)), F.element_at(tokens, i + F.lit(gap))
        ),
    )


def grams(tokens: Column, kind: str, radius: int = 2) -> Column:
    """The text pieces that a feature kind hashes (repeats included: they share a slot)."""
    if kind == "pair":
        parts = [token_pairs(tokens, gap) for gap in range(1, 2 + radius)]
    elif kind == "morgan":
        parts = [ngrams(tokens, 2 * half + 1) for half in range(radius + 1)]
    elif kind in ("rdkit", "map4"):
        parts = [ngrams(tokens, n) for n in range(1, 2 + radius)]
    else:
        raise ValueError(f"unknown feature kind: {kind}")
    return F.concat(*parts)


def count_keys(text: Column) -> Column:
    """167 0/1 keys: key j says that symbol ``j mod S`` occurs more than ``j div S`` times."""
    n = len(KEY_SYMBOLS)
    counts = F.array(
        *[F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in KEY_SYMBOLS]
    )
    keys = F.sequence(F.lit(0), F.lit(KEY_COUNT - 1))
    return let(
        counts,
        lambda c: F.transform(
            keys,
            lambda j: (F.element_at(c, (j % n + 1).cast("int")) > F.floor(j / n)).cast("int"),
        ),
    )


def min_hashes(pieces: Column, length: int) -> Column:
    """``length`` minimum hashes over the pieces, from one hash of each; empty without pieces.

    A column for pieces of any origin; ``feature_slots`` takes the same hashes of its tokens in its tasks.

    A piece's hash names one of ``length`` bins and a value; a bin keeps its smallest value. A bin that got
    none takes that of the next filled bin to its right (past the last comes the first), moved on by a fixed
    step for each bin between, so that equal texts agree in it and others seldom do.
    """
    half = lambda digest, at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    cell = lambda digest: F.struct(F.pmod(half(digest, 1), F.lit(length)).alias("bin"), half(digest, 9).alias("v"))
    cells = F.array_sort(F.transform(pieces, lambda g: let(F.md5(g), cell)))

    def filled(cells):
        return F.filter(cells, lambda x, i: (i == 0) | (x["bin"] != F.element_at(cells, F.greatest(i, F.lit(1)))["bin"]))

    def spread(bins):
        def stretch(x, i):
            around = F.element_at(bins, -1)["bin"] - F.lit(length)
            before = F.when(i == 0, around).otherwise(F.element_at(bins, F.greatest(i, F.lit(1)))["bin"])
            return F.transform(F.sequence(F.lit(0).cast("bigint"), x["bin"] - before - 1), lambda d: x["v"] + d * F.lit(EMPTY_STEP))

        return F.flatten(F.transform(bins, stretch))

    return let(let(cells, filled), spread)


def _slots(kind: str, radius: int, length: int):
    """Tokens of each row to the sorted slots of their pieces, as ``grams`` names them.

    A piece's slot comes from the first 32 bits of its MD5. For map4 these bits name one of ``length`` bins and
    the next 32 are a value; a bin keeps its smallest value. A bin that got none takes that of the next filled
    bin to its right (past the last comes the first), moved on by a fixed step for each bin between, so that
    equal texts agree in it and others seldom do.
    """
    if kind not in ("pair", "morgan", "rdkit", "map4"):
        raise ValueError(f"unknown feature kind: {kind}")
    step = EMPTY_STEP

    @F.pandas_udf("array<int>")
    def slots(batch: pd.Series) -> pd.Series:
        from hashlib import md5

        import numpy as np

        def pieces(tk):
            n, found = len(tk), set()
            if kind == "pair":
                for gap in range(1, 2 + radius):
                    mid = f" {gap} "
                    found.update(a + mid + b for a, b in zip(tk, tk[gap:]))
            else:
                for k in [2 * half + 1 for half in range(radius + 1)] if kind == "morgan" else range(1, 2 + radius):
                    if k == 1:
                        found.update(tk)
                    else:
                        found.update(map(" ".join, zip(*[tk[i : n - k + 1 + i] for i in range(k)])) if n >= k else ())
            return found

        def one(tk):
            if tk is None:
                return None
            digests = b"".join([md5(g.encode()).digest()[:8] for g in pieces(tk.tolist())])
            at, value = np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 2).T
            if kind == "map4" and len(at):
                order = np.lexsort((value, at % length))
                bins, first = np.unique(at[order] % length, return_index=True)
                gaps = np.diff(bins, prepend=bins[-1] - length)
                moved = np.arange(length) - np.repeat(np.cumsum(gaps) - gaps, gaps)
                at = np.repeat(value[order][first], gaps) + moved * step
            return np.unique(at % length).astype(np.int32)

        return batch.map(one)

    return slots


def feature_slots(
    text: Column, kind: str = "pair", radius: int = 2, length: int = 2048, pattern: str = LINE_NOTATION
) -> Column:
    """Sorted positions of the ones in a 0/1 feature vector; NULL for an invalid text.

    The sparse form is what is stored: a dense 2048-wide array per row would be mostly zeros.
    """
    if kind == "maccs":
        ones = F.transform(count_keys(text), lambda v, i: F.when(v == 1, i))
        slots = F.filter(ones, lambda i: i.isNotNull())
    else:
        slots = _slots(kind, radius, length)(tokenize(text, pattern))
    return F.when(F.length(F.trim(text)) > 0, slots)


def dense(slots: Column, length: int) -> Column:
    """Sorted slots to a 0/1 array: zeros up to each slot, a one, zeros to the end."""
    zero, one = F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint")

    def fill(at):
        def stretch(slot, i):
            before = F.when(i == 0, F.lit(-1)).otherwise(F.element_at(at, F.greatest(i, F.lit(1))))
            return F.concat(F.array_repeat(zero, slot - before - 1), F.array(one))

        last = F.when(F.size(at) > 0, F.element_at(at, -1)).otherwise(F.lit(-1))
        tail = F.array_repeat(zero, F.lit(length - 1) - last)
        return F.concat(F.flatten(F.transform(at, stretch)), tail)

    return let(slots, fill)
