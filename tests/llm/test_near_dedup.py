import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from activepool.llm import near_dedup
from activepool.llm.near_dedup import POSTED, _WordHashes, shingle_set, sketch


def words(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def changed(rng, base, share):
    return [f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in base]


def brute(pairs, size, percent=80):
    sets, parent = {}, {}
    for d, t in pairs:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posted = defaultdict(list)
    for d in sorted(sets):
        common = Counter(e for s in sets[d] for e in posted[s])
        for e, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            posted[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def compare(spark, docs, pairs, size):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(pairs), size=size).collect()}
    expected = brute(pairs, size)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == expected
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def corpus(seed):
    rng = random.Random(seed)
    pairs, k = [], 0

    def add(w):
        nonlocal k
        pairs.append((k, " ".join(w)))
        k += 1

    for _ in range(40):
        add(words(rng, rng.randrange(1, 300)))
    for spread in (0.02, 0.04, 0.06, 0.1):  # groups of near copies, some too far from each other
        base = words(rng, 200)
        for _ in range(25):
            add(changed(rng, base, rng.random() * spread))
        for _ in range(5):
            add(base)
    passage = words(rng, 80)
    for _ in range(40):  # one passage that many unlike documents share
        add(words(rng, 100) + passage)
    base = words(rng, 150)  # a chain: each is near the one before only
    for _ in range(12):
        base = changed(rng, base, 0.05)
        add(base)
    ids = list(range(k))
    rng.shuffle(ids)
    return [(i, t) for i, (_, t) in zip(ids, pairs)]


@pytest.mark.parametrize("size", [1, 2])
def test_against_brute_force(spark, docs, size):
    compare(spark, docs, corpus(size), size)


def test_large_group(spark, docs):
    rng = random.Random(5)
    base = words(rng, 120)
    pairs = [(i, " ".join(changed(rng, base, 0.12 * rng.random() ** 2))) for i in range(300)]
    pairs += [(1000 + i, " ".join(base)) for i in range(300)]
    compare(spark, docs, pairs, 2)


def test_edges(spark, docs):
    text = " ".join(f"word{i}" for i in range(60))
    pairs = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (9, "one"), (3, text), (4, text.upper()), (3, text), (None, text), (None, None)]
    rows = near_dedup.near_duplicates(docs(pairs), size=5).collect()
    assert len(rows) == len(pairs)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got == {
        (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (3, 56, 3, True), (4, 56, 3, False),
        (None, 56, None, True), (None, 0, None, True),
    }
    assert near_dedup.near_duplicates(docs([])).collect() == []
    kept = near_dedup.keep_one(docs(pairs))
    assert kept.columns == docs([]).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "5", "6", "7", "8", "None", "None"]
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(docs(pairs), percent=70)


def test_one_id_with_two_texts(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = near_dedup.near_duplicates(docs([(1, a), (1, b), (2, a), (3, b)]), size=2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_a_near_copy_leaves_other_texts_of_its_id(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    kept = near_dedup.keep_one(docs([(1, a), (5, a), (5, b), (7, b), (None, a), (5, None)])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, a), (5, b), (None, a), (5, None)], key=repr)


def test_very_long_sets_near_the_threshold(spark, docs):
    """Sets of 72,000 shingles, one common one short of the threshold and exactly at it: in doubt by halves."""
    n, pairs = 72_000, []
    for k, common in enumerate((63_999, 64_000)):
        shared = [f"s{k}x{i}" for i in range(common)]
        pairs += [(10 * k + j, " ".join(shared + [f"{side}{k}x{i}" for i in range(n - common)])) for j, side in enumerate("pq")]
    rows = near_dedup.near_duplicates(docs(pairs), size=1).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == [(0, n, 0), (1, n, 1), (10, n, 10), (11, n, 10)]


def test_halves_that_coincide_are_in_doubt():
    """Sets whose upper halves repeat: what they say of the pair may be wrong both ways."""
    low = np.arange(10, dtype=np.uint64)
    x = np.sort(np.concatenate([low, (np.arange(30, dtype=np.uint64) + np.uint64(9)) << np.uint64(32)]))
    y = np.sort(np.concatenate([low + np.uint64(5), (np.arange(30, dtype=np.uint64) + np.uint64(9)) << np.uint64(32)]))
    halves = [near_dedup._short(s) for s in (x, y)]
    columns = {"a": [1], "b": [2]} | {f"{name}_{side}": [h[k]] for side, h in zip("ab", halves) for k, name in enumerate(("set", "low", "n"))}
    batch = pa.RecordBatch.from_pydict(columns)
    found = next(near_dedup._confirmed(80)([batch])).to_pylist()[0]
    assert found["doubt"] and found["total"] == 80
    assert next(near_dedup._exact([batch])).to_pylist() == [{"a": 1, "b": 2, "common": 35, "total": 80}]


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    hashes = _WordHashes()
    shares, posted = [], []
    for _ in range(150):
        base = words(rng, 400, 10**6)
        other = changed(rng, base, 0.06)
        x, y = (shingle_set(" ".join(w).encode(), 2, hashes) for w in (base, other))
        true = len(set(x) & set(y)) / len(set(x) | set(y))
        (p, c), (q, d) = sketch(x), sketch(y)
        posted.append((p == q).mean() - true)
        shares.append(sum(a == b for a, b in zip(c, d)) / (POSTED + near_dedup.CHECKED) - true)
    for found, error in ((shares, 0.035), (posted, 0.065)):
        assert abs(sum(found) / len(found)) < 0.015
        assert (sum(s * s for s in found) / len(found)) ** 0.5 < error


def test_freed_memory_of_a_task_is_given_back():
    """A worker that had large batches is small again when they are through."""
    import psutil
    import pyarrow as pa

    from activepool.llm.common import bounded

    def batches():
        yield pa.RecordBatch.from_pydict({"text": [b"x" * 1000] * 100})

    size = psutil.Process().memory_info
    list(bounded(batches()))
    before = size().rss
    kept = [bytes(1000) for _ in range(200_000)]
    spread_out = kept[::1000]
    del kept
    list(bounded(batches()))
    assert size().rss - before < 60 << 20 and len(spread_out) == 200
