import hashlib

import corpus_pipeline
from activepool.llm import bpe, decontaminate, near_dedup, quality
from activepool.llm.queries import ORACLE, QUERIES, table
from test_lines_and_urls import brute_lines
from test_near_dedup import brute

import pytest


def test_registered():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_stages_against_brute_force(spark, small):
    """Every stage on what the one before it kept."""
    docs = table(spark, small, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = {}

    def go(name):
        nonlocal docs
        before = [tuple(r) for r in docs.collect()]
        docs = stages[name](spark, docs, small)
        if name != "bpe encoding":
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = before
        return before, [tuple(r) for r in docs.collect()]

    before, after = go("quality classifier")
    scores = quality.quality_scores(spark.createDataFrame(before, columns), table(spark, small, "labels"))
    rejected = {r["doc_id"] for r in scores.collect() if r["score"] < 0.7}
    assert sorted(after) == sorted(r for r in before if r[0] not in rejected) and rejected

    before, after = go("line dedup")
    cleaned = {d: (t, n) for d, t, n in brute_lines([(r[0], r[1]) for r in before])}
    expected = [(r[0], cleaned[r[0]][0], *r[2:]) for r in before if not (cleaned[r[0]][1] and not cleaned[r[0]][0].split())]
    assert sorted(after) == sorted(expected) and any(n for _, n in cleaned.values())

    before, after = go("near dedup")
    roots = brute([(r[0], r[1]) for r in before], 5)
    assert sorted(after) == sorted(r for r in before if roots[r[0]][1] == r[0])

    before, after = go("decontamination")
    windows = set()
    for r in table(spark, small, "benchmark").collect():
        w = decontaminate.words_of(r["text"].encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def leaks(text):
        w = decontaminate.words_of(text.encode())
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    assert sorted(after) == sorted(r for r in before if not leaks(r[1]))

    before, after = go("bpe encoding")
    tokenizers = pytest.importorskip("tokenizers")
    from activepool.llm.queries import tokenizer_path

    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in before:
        ids = library.encode(r[1], add_special_tokens=False).ids
        expected.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(r[1])))
    assert sorted(after) == sorted(expected)
    assert bpe and near_dedup


def test_edge_rows(spark, small, docs):
    """Nulls, empty texts, repeated rows and an empty table go through every stage."""
    pairs = [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "short"), (10**9 + 2, "short"), (None, "no id"), (None, None)]
    for rows in (pairs, []):
        df = docs(rows)
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, small)
        assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert len(df.collect()) <= len(rows)
