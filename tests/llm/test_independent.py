"""Operators that SQL can't express, against plain Python written from their descriptions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from activepool.llm import fingerprint, langid, lm, quality

M64 = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


# --- fingerprints: one symbol after the other ---------------------------------------------------


def parse(names):
    """Names of the blocks of one level."""
    symbols = []
    for x in names:
        if symbols and symbols[-1][0] == x:
            symbols[-1][1] += 1
        else:
            symbols.append([x, 1])
    symbols = [x if n == 1 else mix((x + n * 0x9E3779B97F4A7C15) & M64) for x, n in symbols]
    label = symbols
    for _ in range(4):
        new = []
        for i, x in enumerate(label):
            before = label[i - 1] if i else x ^ 1
            low = next(b for b in range(64) if (x ^ before) >> b & 1)
            new.append(2 * low + (x >> low & 1))
        label = new
    blocks = []
    for i, x in enumerate(symbols):
        peak = 0 < i < len(label) - 1 and label[i - 1] < label[i] > label[i + 1]
        if i == 0 or peak:
            blocks.append([])
        blocks[-1].append(x)
    return [mix(sum(mix(x ^ (k + 1) * 0xD6E8FEB86659FD93 & M64) for k, x in enumerate(b)) & M64) for b in blocks]


def plain_fingerprint(text):
    names, found = [mix(ord(c) + 1) for c in text], set()
    for level in (1, 2, 3):
        names = parse(names) if names else []
        if level > 1:
            found |= {mix((x + level) & M64) for x in names}
    return [x >> 32 for x in sorted(found)[:64]]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    whole = sorted(set(a) | set(b))
    if len(a) >= 64 or len(b) >= 64:
        whole = whole[:64]
    return sum(x in a and x in b for x in whole) / len(whole)


def test_fingerprints_by_hand(spark, docs):
    rng = random.Random(1)
    texts = ["", "a", "aa", "ab", "aaaa bbbb", "日本語🙂" * 9, None, "abcabcabc" * 40, "\n" * 50]
    texts += ["".join(rng.choice("abcdef ghi,.\nXYZé日") for _ in range(rng.randrange(0, 900))) for _ in range(40)]
    pairs = [(3 * i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprint.compare_edited(docs(pairs)).collect()}
    marks = [plain_fingerprint(t or "") for t in texts]
    code = lambda m: "".join(f"{x:08x}" for x in m)
    for k, (i, t) in enumerate(pairs):
        t, n = t or "", texts[(k + 1) % len(texts)] or ""
        edited = plain_fingerprint(t[: len(t) - len(t) // 4] + n[: len(t) // 4])
        assert got[i]["fingerprint"] == code(marks[k]) and got[i]["edited_fingerprint"] == code(edited)
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(marks[k], edited))
        assert got[i]["near_next"] == pytest.approx(plain_likeness(marks[k], marks[(k + 1) % len(texts)]))


# --- quality: features and risk written out -------------------------------------------------------


def plain_shares(text):
    """A few of the features, counted character by character and word by word."""
    data, words = text.encode(), text.encode().split()
    letters = [c for c in data if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128]
    return {
        1: sum(65 <= c <= 90 for c in letters) / max(len(letters), 1),
        4: data.count(b"!") / len(data),
        5: sum(48 <= c <= 57 for c in data) / len(data),
        10: len(set(words)) / len(words),
        11: max(Counter(words).values()) / len(words),
        14: sum(w.isupper() for w in words) / len(words),
        15: math.log1p(len(words)) / 10,
        17: 1 - len(set(text.split("\n"))) / len(text.split("\n")),
    }


def test_quality_features_by_hand():
    for text in ("A quiet hill. A quiet house!", "BUY NOW 99!!! BUY\nBUY NOW 99!!! BUY", "été é 12 12\nx"):
        found = quality.text_features(text.encode())
        for k, value in plain_shares(text).items():
            assert found[k] == pytest.approx(value), (text, k)


def plain_risk(model, w, p, u, prior):
    """prior * R(p, +) + max(0, R(u, -) - prior * R(p, -)) with the logistic loss, and the ridge of the fit."""
    loss = lambda z, sign: np.log1p(np.exp(-sign * z)).mean()
    zp, zu = model.design(p) @ w, model.design(u) @ w
    return prior * loss(zp, 1) + max(0.0, loss(zu, -1) - prior * loss(zp, -1)) + 1e-3 * (w @ w) / 2


def test_the_fit_beside_a_plain_descent():
    """The risk by a descent with differences of the risk itself; the fit, which turns back where the second part
    would fall below zero, ends near it and decides alike."""
    rng = np.random.default_rng(2)
    p = rng.normal(0.8, 1, (300, quality.FEATURES))
    u = np.concatenate([rng.normal(0.8, 1, (300, quality.FEATURES)), rng.normal(-0.8, 1, (700, quality.FEATURES))])
    p[:, 15] = u[:, 15] = math.log1p(100) / 10  # this feature says how many words the others stand on
    model = quality.fit_nonnegative(p, u, 0.3)
    at, w, eye = plain_risk(model, model.w, p, u, 0.3), np.zeros_like(model.w), np.eye(len(model.w)) * 1e-5
    low, rate = plain_risk(model, w, p, u, 0.3), 1.0
    start = low
    for _ in range(120):
        slope = np.array([plain_risk(model, w + e, p, u, 0.3) - plain_risk(model, w - e, p, u, 0.3) for e in eye]) / 2e-5
        while rate > 1e-6 and plain_risk(model, w - rate * slope, p, u, 0.3) >= low:
            rate /= 2
        w = w - rate * slope
        low, rate = plain_risk(model, w, p, u, 0.3), 1.5 * rate
    assert at < 0.6 * start and abs(at - low) < 0.06
    plain = 1 / (1 + np.exp(-model.design(u) @ w))
    assert np.mean((plain >= 0.5) == (model.score(u) >= 0.5)) > 0.96
    # The truth behind the unlabelled rows, which the fit never saw: a positive one mostly scores higher.
    score = model.score(u)
    assert np.mean(score[:300, None] > score[None, 300:]) > 0.98


# --- languages: the machine's own optimum, and votes counted anew -----------------------------------


def test_machines_are_at_their_optimum():
    """The squared-hinge objective in float64: its slope at the fitted weights is small, and no scaling is better."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 30))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.normal(size=200) > 0.05, 1.0, -1.0)
    w = langid.fit_machine(x, y, steps=600).astype(np.float64)
    z = np.hstack([x, np.ones((200, 1))]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def objective(w):
        return (weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum() + 1e-4 * (w @ w) / 2

    slack = np.maximum(0, 1 - y * (z @ w))
    slope = 1e-4 * w - 2 * z.T @ (weight * y * slack)
    assert np.abs(slope).max() < 2e-3
    assert objective(w) <= min(objective(s * w) for s in (0.9, 0.97, 1.03, 1.1)) + 1e-6


def test_votes_by_hand(spark):
    rng = random.Random(4)
    kinds = {"de": "der die und nicht wasser haus".split(), "nl": "de het een niet water huis".split(), "en": "the and not water house of".split(), "ja": "日本 語の 水家".split()}
    rows = [(i, " ".join(rng.choice(kinds[n]) for _ in range(rng.randrange(3, 20))), n) for i, n in enumerate(rng.choices(list(kinds), k=240))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == {"germanic": ["de", "en", "nl"], "ja": ["ja"]}
    for _, text, _ in rows[:60]:
        x = langid.grams(text)
        (a, b), w = next(iter(model.top.items()))
        family = a if x @ w[:-1] + w[-1] > 0 else b
        names = model.languages[family]
        wins, margins = Counter(), defaultdict(float)
        for (a, b), w in model.inside[family].items():
            m = float(x @ w[:-1] + w[-1])
            wins[a if m > 0 else b] += 1
            margins[a] += m
            margins[b] -= m
        assert model.predict(text)[0] == max(names, key=lambda n: (wins[n], margins[n]))


# --- language model: a sampler that seats one customer at a time -------------------------------------


TINY = ["a b a b c", "a b", "c a b", "b b a", "a c", "c c a b", "a b c", "", "b a b a b"] * 4


def exact_model(texts, discount, root_discount, sweeps, seed):
    """Chinese restaurants with tables of their own, a customer removed and seated anew at a time.

    Returns the mean predictive probability of every (word before, word).
    """
    rng = random.Random(seed)
    tokens = [["^", *t.split(), "$"] for t in texts]
    total = Counter(w for t in tokens for w in t[1:])
    n, v = sum(total.values()), len(total)
    base = lambda w: (total[w] + 0.1) / (n + 0.1 * (v + 1))
    rooms = defaultdict(lambda: defaultdict(list))  # context -> word -> customers of each table; None is the root

    def weight(c, w):
        """Of a new table: strength and tables of the restaurant, times what stands above it."""
        tables = sum(len(x) for x in rooms[c].values())
        return (lm.STRENGTH + (discount if c is not None else root_discount) * tables) * (probability(None, w) if c is not None else base(w))

    def probability(c, w):
        d = discount if c is not None else root_discount
        own = sum(x - d for x in rooms[c][w])
        return (own + weight(c, w)) / (lm.STRENGTH + sum(sum(x) for x in rooms[c].values()))

    def seat(c, w):
        d = discount if c is not None else root_discount
        shares = [x - d for x in rooms[c][w]] + [weight(c, w)]
        k = rng.choices(range(len(shares)), shares)[0]
        if k < len(rooms[c][w]):
            rooms[c][w][k] += 1
        else:
            rooms[c][w].append(1)
            if c is not None:
                seat(None, w)

    def leave(c, w):
        at = rng.choices(range(len(rooms[c][w])), rooms[c][w])[0]
        rooms[c][w][at] -= 1
        if not rooms[c][w][at]:
            rooms[c][w].pop(at)
            if c is not None:
                leave(None, w)

    pairs = [(t[i], t[i + 1]) for t in tokens for i in range(len(t) - 1)]
    for c, w in pairs:
        seat(c, w)
    words, sums = sorted(total) + ["?"], Counter()
    for s in range(sweeps):
        for c, w in pairs:
            leave(c, w)
            seat(c, w)
        if s >= sweeps // 4:
            for c in ["^", *sorted(total), "?"]:
                for w in words:
                    sums[c, w] += probability(c, w)
    return {k: x / (sweeps - sweeps // 4) for k, x in sums.items()}


@pytest.fixture(scope="module")
def tiny(spark, docs):
    """log10 probabilities of probe texts, and the tables of the fit."""
    probes = ["", "a", "b", "c", "?", "a b", "b a", "? ?", "a b c", "c c c", "b b b b", "a ?", "? a"]
    seen, fitted = [], lm._fitted

    def spy(*args):
        seen.append(fitted(*args))
        return seen[0]

    lm._fitted = spy
    try:
        rows = lm.lm_scores(docs([*enumerate(TINY)] + [(1000 + k, t) for k, t in enumerate(probes)]), F.col("doc_id") >= 1000, buckets=8).collect()
    finally:
        lm._fitted = fitted
    scores = {r["doc_id"]: r["score"] for r in rows}
    state = {r["at"]: [lm._unpack(bytes(x)) for x in r["d"]] for r in seen[0].state.collect()}
    seated = {}
    for r in seen[0].seated.collect():
        d = [bytes(x) for x in r["d"]]
        seated |= dict(zip(np.frombuffer(d[5], np.uint64).tolist(), lm._unpack(d[4]).tolist()))
    return {t: scores[1000 + k] for k, t in enumerate(probes)}, seen[0].numbers, state, seated


def test_lm_near_the_exact_sampler(tiny):
    """Texts' log10 probabilities beside a sampler that seats customers one by one: a few hundredths a token."""
    scores, numbers, _, _ = tiny
    exact = exact_model(TINY, numbers["discount"], numbers["root"], 400, 1)
    gaps = []
    for text, score in scores.items():
        words = ["^", *text.split(), "$"]
        want = sum(math.log10(exact[c, w]) for c, w in zip(words, words[1:]))
        gaps.append(abs(score - want) / (len(words) - 1))
    print("gaps a token:", max(gaps), np.mean(gaps))
    assert max(gaps) < 0.1 and np.mean(gaps) < 0.04, gaps


def test_lm_probabilities_sum_to_one_in_every_context(tiny):
    """Over all words, the end and the unknown one, from the tables of the fit; and they give the scores."""
    scores, numbers, state, seated = tiny
    tokens = [[b"", *t.encode().split(), b"\n"] for t in TINY]
    pairs = Counter((c, w) for t in tokens for c, w in zip(t, t[1:]))
    totals = Counter(w for t in tokens for w in t[1:]) + Counter({b"": len(TINY)})
    hashes = {w: xxhash.xxh3_64_intdigest(w) for w in [*totals, b"?"]}
    ids = {}
    for b in range(8):
        ranked = sorted((w for w in hashes if hashes[w] % 8 == b), key=lambda w: (-totals[w], hashes[w]))
        ids |= {w: k * 8 + b for k, w in enumerate(ranked)}
    of = lambda w, k: int(state[ids[w] % 8][k][ids[w] // 8])
    n, v = sum(totals.values()) - len(TINY), len(totals) - 1
    assert all(of(w, lm.TOTAL) == (totals[w] if w else 0) for w in totals)
    root = {
        w: np.array([lm._root(of(w, lm.KEEPS + 3 * s), of(w, lm.KEEPS + 3 * s + 1), of(w, lm.TOTAL), sums, numbers["root"], n, v) for s, sums in enumerate(numbers["sums"])])
        for w in [*totals, b"?"] if w
    }
    assert sum(root.values()) == pytest.approx(np.ones(lm.KEPT))
    found = {}
    for c in hashes:
        tables = np.array([of(c, lm.KEEPS + 3 * s + 2) for s in range(lm.KEPT)], float)
        ctx_n = of(c, lm.CTX_TOTAL) if c != b"?" else 0
        assert ctx_n == sum(x for (a, _), x in pairs.items() if a == c)
        for w, p in root.items():
            x = pairs[c, w]
            total = seated[mix((mix(ids[w]) + ids[c]) & M64)] if x > 1 else lm.KEPT * x
            found[c, w] = 10 ** float(lm.log_probability(x, total, tables[:, None], p[:, None], ctx_n, numbers["discount"])[0])
        assert sum(found[c, w] for w in root) == pytest.approx(1, abs=1e-9)
    for text, score in scores.items():
        words = [b"", *text.encode().split(), b"\n"]
        assert score == pytest.approx(sum(math.log10(found[c, w]) for c, w in zip(words, words[1:])), abs=1e-9)
