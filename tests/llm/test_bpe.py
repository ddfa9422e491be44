import random

import pytest

from activepool.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [
    "", "Hello  world", "it's we'LL they've 'tis 'S", "  lead\n\n\ttail  ", "a b c　", "x²½Ⅳ٣ ३४", "naïve Straße été ﬁ", "日本語 テスト 한국어",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "!!<|endoftext|>??", "🙂👍🏽 é ‍", "\x00\x01\x7f\x85 z",
    "tab\tnew\r\nline \x0b\x0c", "12345 6.7e-8", "___ __init__ a_b", "՘࢏ᛮᴬ", "word " * 3000, "z" * 20000, "İı", "­͏",
]


def test_against_the_library(spark, docs, library):
    rng = random.Random(1)
    letters = "abc DEF\n\t '!é日٣½ ́_0<|>"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    pairs = [*enumerate(texts), (900, None), (3, "again"), (3, "again"), (None, "no id")]
    rows = bpe.encode(docs(pairs), PATH).collect()
    got = sorted(((str(r["doc_id"]), list(r["ids"])) for r in rows))
    assert got == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in pairs)
    decoded = bpe.decode(bpe.encode(docs(pairs), PATH), PATH).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in decoded) == sorted((str(i), t or "") for i, t in pairs)


def test_agreed_ranges_split_as_the_library(library):
    """Every character that takes the fast way, alone, between letters, digits, marks and blanks."""
    fast = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not bpe.AGREED.search(chr(c))]
    assert len(fast) > 30_000
    split = library.pre_tokenizer.pre_tokenize_str
    for c in fast:
        for text in (f"a{c}b", f" {c}1", f"!{c}{c} "):
            assert [text[a:b] for _, (a, b) in split(text)] == bpe.WORD.findall(text), hex(ord(c))


def test_decode_of_any_ids(spark, library):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randrange(20))]) for i in range(200)] + [(500, None), (501, [])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(df, PATH).collect()}
    assert got == {i: library.decode(ids or [], skip_special_tokens=False) for i, ids in rows}


def test_small_shards(spark, docs, library, monkeypatch):
    monkeypatch.setattr(bpe, "SHARD_WORDS", 50)
    pairs = [(i, f"some text number {i} " * (i % 7)) for i in range(60)]
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs(pairs).coalesce(1), PATH).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in pairs}


def test_empty_and_refused(spark, docs, tmp_path):
    assert bpe.digests(docs([]), PATH).collect() == []
    other = tmp_path / "t.json"
    other.write_text('{"model": {"type": "WordPiece"}, "pre_tokenizer": {"type": "Whitespace"}}')
    with pytest.raises(ValueError):
        bpe.encode(docs([]), str(other))


def test_a_worker_does_not_grow_with_its_buckets():
    """Buckets of new words, encoded one after the other as in one Python worker, leave no memory behind."""
    import psutil
    import pyarrow as pa

    run = bpe._encoded_bucket(bpe.tokenizer_json(PATH))

    def bucket(k):
        data = bpe._text_block([f" word{j}x{k}" for j in range(12_000)])
        run(pa.table({"shard": pa.array([0], pa.int64()), "bucket": pa.array([k], pa.int32()), "data": pa.array([data], pa.binary())}))
        return psutil.Process().memory_info().rss

    first = [bucket(k) for k in range(4)][-1]
    assert [bucket(k) for k in range(4, 20)][-1] - first < 16 << 20


def test_putting_ids_together_takes_little_more_than_its_result():
    """A shard's texts are put together block by block: blocks are small beside the shard."""
    import pyarrow as pa

    from pyspark import TaskContext

    class Task:
        partitionId = staticmethod(lambda: 0)

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4000), pa.int64()), "text": pa.array([f"some words of text {i} " * 50 for i in range(4000)])})
    held, TaskContext.get = TaskContext.get, staticmethod(lambda: Task)
    try:
        rows = pa.Table.from_batches(list(bpe._split(bpe.tokenizer_json(PATH), 8)(iter([batch]))))
    finally:
        TaskContext.get = held
    lens = [sum(x) for x, kind in zip(rows["lens"].to_pylist(), rows["kind"].to_pylist()) if kind == 0]
    assert len(lens) > 3 and max(lens) <= 400_000
