import hashlib
import random
import zlib

import numpy as np
import pytest

from activepool.llm import periodic


def all_runs(words, least=12):
    """(start, length, period) of every run: each period, each start, word by word."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def cases():
    rng = random.Random(5)
    out = [[], ["x"], ["x"] * 11, ["x"] * 12, ["x"] * 1000, list("ab") * 6, list("ab") * 5 + ["a"], list("abcdef") * 2, list("abcdefg") * 2]
    out += [fibonacci(400), [str(bin(i).count("1") % 2) for i in range(512)], list("abcdefgh" * 2) + list("ijklmnop" * 2) * 3]
    out += [[rng.choice("ab") for _ in range(rng.randrange(1, 200))] for _ in range(60)]
    out += [[rng.choice("abc") for _ in range(rng.randrange(1, 300))] for _ in range(30)]
    for _ in range(80):  # a period somewhere between other words, and periods of periods
        period = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 70))]
        run = (period * rng.randrange(2, 6))[: rng.randrange(2 * len(period), 6 * len(period) + 1)]
        noise = lambda: [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 40))]
        out.append(noise() + run + noise() + run + noise())
    return out


def test_against_every_period(docs):
    words = cases()
    pairs = [(i, "\n \t".join(w)) for i, w in enumerate(words)] + [(900, None), (901, " \t\n "), (None, "a " * 20), (7, "b " * 20), (7, "b " * 20)]
    rows = periodic.periodic_runs(docs(pairs).coalesce(2)).collect()
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows), key=repr)
    want = []
    for i, t in pairs:
        w = (t or "").split()
        runs = all_runs(w)
        want.append((i, len(w), runs, kept(w, runs)))
    assert got == sorted(want, key=repr)
    assert sum(len(r[2]) for r in got) > 300


@pytest.mark.parametrize("least", [2, 3, 7, 30])
def test_other_least_lengths(least):
    for words in cases()[:60]:
        names = {}
        codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
        rows = [(s, e - s, q) for s, e, q in periodic.find_runs(codes, np.array([len(codes)]), least).tolist()]
        assert sorted(rows) == all_runs(words, least)


def test_a_hash_that_misleads(monkeypatch):
    """With names of four bits nearly every look-up misleads; what is found is still right."""
    monkeypatch.setattr(periodic, "mix64", lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60))
    rng = random.Random(6)
    words = [rng.randrange(40) for _ in range(60)] + [1, 2, 3, 4, 5, 6] * 4 + [rng.randrange(40) for _ in range(60)]
    rows = periodic.find_runs(np.array(words, np.int64), np.array([len(words)]))
    assert sorted((s, e - s, q) for s, e, q in rows.tolist()) == all_runs(words)


def test_pairs_stay_in_proportion():
    """One word that fills a long text: as many pairs in a class as there are words, not their square."""
    n = 200_000
    names, begin, end = np.ones(n, np.uint64), np.zeros(n, np.int64), np.full(n, n)
    for low, high, overlap in periodic._classes(12, n):
        k = 1 << max(0, (overlap - 1).bit_length() - 1)
        assert len(periodic._pairs(names, k, overlap - k + 1, low, high, begin, end, n + 1)[0]) <= 3 * n
    assert periodic.find_runs(np.zeros(n, np.int64), np.array([n])).tolist() == [[0, n, 1]]


def test_empty_and_refused(docs):
    assert periodic.periodic_runs(docs([])).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs([]), least=1)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_whole_table(spark, small):
    """Short documents of the smallest tables, with their planted periods, against every period."""
    from activepool.llm.queries import op12

    rows = {r["doc_id"]: r for r in op12(spark, small).collect()}
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(table)
    seen = 0
    for r in table:
        words = [w for w in (r["text"] or "").encode().split()]
        if len(words) > 1500:
            continue
        words = planted(r["doc_id"], [w.decode() for w in words])
        runs = all_runs(words)
        got = rows[r["doc_id"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (got["start"], got["length"], got["period"]) == best and got["n_runs"] == len(runs)
        assert got["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(kept(words, runs).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5


def test_planted_query_rows(spark, tmp_path):
    from activepool.llm.queries import op12

    rows = [(i, None if i == 3 else "" if i == 4 else " ".join(f"w{(i * j) % 17}" for j in range(40))) for i in range(120)] + [(None, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op12(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        words = planted(i, (t or "").split())
        assert got[i]["n_runs"] == len(all_runs(words))
        assert got[i]["collapsed_sha256"] == hashlib.sha256(kept(words, all_runs(words)).encode()).hexdigest()
