import hashlib
import random

from activepool.llm import decontaminate
from activepool.llm.decontaminate import words_of


def brute(docs, items, window=10):
    out = []
    for d, t in docs:
        w = words_of(t.encode() if t is not None else None)
        hit, found = set(), set()
        for item, text in items:
            q = words_of(text.encode() if text is not None else None)
            n = min(window, len(q))
            for i in range(len(q) - n + 1) if q and item is not None else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == q[i : i + n]:
                        hit |= set(range(k, k + n))
                        found.add(str(item))
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, pairs, items, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs(pairs), table, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in rows), key=repr)


def case():
    rng = random.Random(3)
    words = lambda n: [f"t{rng.randrange(40)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.randrange(1, 30)))) for i in range(15)] + [(20, "aa"), (3, "aa bb"), (21, None), (22, "!!"), (None, "t1 t2")]
    pairs = []
    for i in range(40):
        w = words(rng.randrange(0, 60))
        if i % 2:
            source = rng.choice(items[:15])[1].split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = source[: rng.randrange(1, len(source) + 1)] * rng.choice([1, 2])
        pairs.append((i, ("; " if i % 3 else "\n").join(w)))
    return pairs + [(50, None), (51, ""), (52, "AA, bb AA!"), (52, "AA, bb AA!"), (None, "aa")], items


def test_against_brute_force(spark, docs):
    pairs, items = case()
    assert found(spark, docs, pairs, items) == brute(pairs, items)
    assert found(spark, docs, pairs, items, window=3) == brute(pairs, items, 3)


def test_small_shards_and_whole_index(spark, docs, monkeypatch):
    pairs, items = case()
    expected = brute(pairs, items)
    monkeypatch.setattr(decontaminate, "VOCABULARY", 5)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
    assert found(spark, docs, pairs, items) == expected


def test_empty_tables(spark, docs):
    assert found(spark, docs, [], [(1, "a b")]) == []
    assert found(spark, docs, [(1, "a b c")], []) == [(1, 3, 0, 0, "", False)]


def test_proximity(spark, docs):
    items = [(1, "red fox jumps")]
    pairs = [(1, "red fox jumps"), (2, "red quick fox jumps"), (3, "red a b c fox jumps"), (4, "jumps fox")]
    assert [r[0] for r in found(spark, docs, pairs, items) if r[-1]] == [1]
    assert [r[0] for r in found(spark, docs, pairs, items, slop=1) if r[-1]] == [1, 2]


def test_words():
    assert words_of("Ab{c}é~Ü_9`z\x7fq".encode()) == ["ab".encode(), b"c", "é".encode(), "Ü".encode() + b"", b"9", b"z", b"q"][:2] + ["é".encode(), "Ü".encode(), b"9", b"z", b"q"]


def test_removal_keeps_columns(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    left = decontaminate.without_contaminated(docs([(1, "x a b c y"), (2, "x"), (None, "a b c"), (3, None)]), items)
    assert left.columns == docs([]).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "3", "None"]
    assert hashlib  # digests are built by the query


def test_removal_leaves_other_texts_of_an_id(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    left = decontaminate.without_contaminated(docs([(1, "x a b c y"), (1, "x"), (1, None), (2, "a b c"), (3, "x"), (3, "x")]), items)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(1, "x"), (1, None), (3, "x"), (3, "x")], key=repr)
