import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from activepool.llm import langid, lm, quality
from activepool.llm.common import bucket


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def test_fold_matches_crc32(spark):
    import zlib

    ids = [0, 1, 17, 123456789, -5]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", bucket(F.col("doc_id"), 10).alias("b")).collect()
    assert [r["b"] for r in rows] == [zlib.crc32(str(i).encode()) % 10 for i in ids]


def quality_case():
    rng = random.Random(1)
    words = ["stone", "river", "walks", "under", "light", "morning", "of", "the", "and", "quiet", "hill", "house"]
    # Texts of a few words are scored towards the average on purpose, so the good ones have three lines or more.
    good = ["\n".join(sentence(rng, words, rng.randrange(5, 15)) for _ in range(rng.randrange(3, 11))) for _ in range(300)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randrange(10, 90))) for _ in range(60)]
    bad += [(rng.choice(words) + " ") * rng.randrange(20, 60) for _ in range(60)]
    pairs = [*enumerate(good + bad)]
    labels = [(i, 1) for i in range(0, 300, 2)] + [(i, 0) for i in range(300, 420, 2)]
    return pairs, labels


def test_quality_separates_held_out(spark, docs):
    pairs, labels = quality_case()
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.quality_scores(docs([*pairs, (900, None), (901, ""), (None, "a"), (3, pairs[3][1])]), table).collect()
    assert len(rows) == len(pairs) + 4 and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[900] == score[901]
    assert np.mean([score[i] >= 0.7 for i in range(1, 300, 2)]) > 0.95
    assert np.mean([score[i] < 0.7 for i in range(301, 420, 2)]) > 0.95
    left = quality.without_rejected(docs(pairs + [(None, "a")]), table)
    assert left.columns == docs([]).columns and None in {r["doc_id"] for r in left.collect()}


def test_a_rejected_text_leaves_other_texts_of_its_id(spark, docs):
    pairs, labels = quality_case()
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    twice = [*pairs, (1, pairs[350][1]), (1, pairs[350][1]), (None, pairs[350][1])]
    left = sorted((str(r["doc_id"]), r["text"]) for r in quality.without_rejected(docs(twice), table).collect() if r["doc_id"] in (1, None))
    assert left == [("1", pairs[1][1]), ("None", pairs[350][1])]


def test_quality_reads_only_labels_to_learn(spark, docs):
    pairs, labels = quality_case()
    flipped = [(i, 1 - q) if i % 4 == 1 else (i, q) for i, q in labels + [(i, 0) for i in range(1, 300, 4)]]
    learn = lambda d: d % 4 != 1
    score = lambda table: sorted((r["doc_id"], r["score"]) for r in quality.quality_scores(
        docs(pairs), spark.createDataFrame(table, "doc_id long, quality int"), learn=learn).collect())
    assert score(labels) == score(flipped)


def test_quality_without_positives(spark, docs):
    table = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert [(r["score"], r["predicted"]) for r in quality.quality_scores(docs([(1, "a")]), table).collect()] == [(1.0, 1)]
    assert quality.quality_scores(docs([]), table).collect() == []


def test_prior_estimate():
    rng = np.random.default_rng(0)
    bins = lambda x: np.histogram(x, bins=1000, range=(0, 1))[0]
    positive = bins(rng.beta(8, 2, 4000))
    for prior in (0.3, 0.6, 0.85):
        n = int(20_000 * prior)
        mixed = bins(np.concatenate([rng.beta(8, 2, n), rng.beta(2, 8, 20_000 - n)]))
        assert abs(quality.estimate_prior(positive, mixed) - prior) < 0.06


def lm_case():
    rng = random.Random(2)
    a, b = [f"{x}a" for x in "klmnoprs"], [f"{x}b" for x in "cdfghjk"]
    texts = [" ".join(rng.choice(ws) for _ in range(rng.randrange(1, 40))) for ws in [a, b] * 60]
    return [*enumerate(texts)] + [(500, None), (501, " "), (502, "Ka KA ka"), (7, texts[7]), (503, "new words only"), (504, "ka " * 400)]


def test_lm_against_direct_counts(spark, docs):
    import zlib

    pairs = lm_case()
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = Counter(w for d, t in pairs if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in pairs)
    rows = lm.lm_scores(docs(pairs), bucket(F.col("doc_id"), 10) == 0).collect()
    got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert got == expected
    out = [r for r in rows if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_does_not_depend_on_shards(spark, docs, monkeypatch):
    pairs = lm_case()
    score = lambda df: sorted((r["doc_id"], round(r["score"], 9)) for r in lm.lm_scores(df).collect())
    whole = score(docs(pairs).coalesce(1))
    monkeypatch.setattr(lm, "SHARD_WORDS", 30)
    assert score(docs(pairs).repartition(3)) == whole


def test_lm_edges(spark, docs):
    assert lm.lm_scores(docs([])).collect() == []
    rows = lm.lm_scores(docs([(1, "a b"), (None, None)]), F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["score"] == r["base_score"]) for r in rows) == [(1, 0, 0, True), (3, 0, 0, True)]


def test_lm_does_not_depend_on_splits_of_a_context(spark, docs, monkeypatch):
    """A context of many tokens is dealt to several buckets; what comes out is the same model."""
    pairs = lm_case()
    score = lambda: sorted((r["doc_id"], round(r["score"], 9)) for r in lm.lm_scores(docs(pairs), buckets=11).collect())
    whole = score()
    monkeypatch.setattr(lm, "HOT", 20)
    assert score() == whole


def test_lm_packs_any_numbers():
    rng = np.random.default_rng(0)
    for x in (np.empty(0, np.int64), np.zeros(5, np.int64), np.arange(70_000), rng.integers(0, 1 << 40, 1000), np.array([255, 256, 65_535, 65_536])):
        assert (lm._unpack(lm._pack(x)) == x).all() and (lm._risen(lm._rising(np.sort(x))) == np.sort(x)).all()


def test_lm_learns_word_pairs(spark, docs):
    """The words before end in the same byte, and in the same byte of another character."""
    pairs = [(i, ["new york", "few books", "новый город", "дикий берег"][i % 4]) for i in range(120)]
    probes = {1000: "new york", 1001: "few york", 1002: "новый город", 1003: "дикий город", 1004: "unseen york"}
    rows = lm.lm_scores(docs(pairs + [*probes.items()]), F.col("doc_id") >= 1000).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1000] - score[1001] > 1 and score[1002] - score[1003] > 1
    # york after new: 30 customers of a restaurant that serves nothing else.
    base = {r["doc_id"]: r["base_score"] for r in rows}
    assert all(r["n_known"] == (2 if r["doc_id"] == 1004 else 3) for r in rows)
    assert score[1000] > base[1000] and score[1004] < score[1001]


def test_reseat_matches_a_simulation():
    rng = np.random.default_rng(1)
    for customers, weight, d in ((1, 0.5, 0.5), (2, 0.3, 0.7), (30, 1.2, 0.6), (3000, 2.0, 0.5)):
        keys = lm.mix64(np.arange(2000, dtype=np.uint64))
        found = lm.reseat(np.full(2000, customers), np.full(2000, weight), d, keys)
        exact = []
        for _ in range(60 if customers > 100 else 1500):
            t = 1
            for i in range(1, customers):
                t += rng.random() < weight / (weight + i - d * t)
            exact.append(t)
        spread = np.std(exact) / math.sqrt(len(exact)) + np.std(found) / math.sqrt(2000)
        assert abs(found.mean() - np.mean(exact)) < 4 * spread + 0.03 * np.mean(exact) * (customers > 100) + 1e-9


LANGUAGES = {
    "en": "the and of to that with from this water house walking thing which".split(),
    "de": "der die und nicht wasser haus schnell über für zwischen gehen dieses".split(),
    "fr": "le les et dans avec pour maison être vous nous rivière très beaucoup".split(),
    "es": "el los y con para casa está nosotros río muy mucho también señor".split(),
    "xx": "zzk qqk wvv kkz vqq zwk".split(),
}


def test_language_identification(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, LANGUAGES[n], rng.randrange(3, 30)), n) for i, n in enumerate(rng.choices(list(LANGUAGES), k=400))]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 ... 45", "de"), (1004, "½ ² ① Ⅻ ٣ _", "de"), (1003, "the house", None), (1003, "the house", None), (None, "la casa", "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    found = langid.identify_held_out(df, lambda d: d % 5 != 0).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    truth = {i: n for i, _, n in rows}
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert held and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1000, 1001, 1002, 1004)} == {"und"}
    assert {r["lang_pred"] for r in found if r["doc_id"] == 1003} == {"en"}
    only = langid.identify_held_out(df.limit(0), lambda d: d % 5 != 0)
    assert only.collect() == []
    unlearned = langid.identify_held_out(df.where("doc_id = 1003"), lambda d: d % 5 != 0).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}
