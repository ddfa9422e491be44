import random

import pytest

from activepool.llm import sentence_pieces as sp

sentencepiece = pytest.importorskip("sentencepiece")
PATH = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


TEXTS = [
    "", " ", "  ", "Hello  world", " lead and tail ", "a\nb\tc\r\n", "▁a ▁▁", "日本 x🙂", " é́", "a\0b", "<s></s><unk><0x0A>", "⁇ ⁇", "�", "​﻿x",
    "z" * 3000, "ab" * 2000, " " * 1500 + "x", "\n" * 60, "abcdefghij klm" * 300, "日本語テスト" * 300, "ſK İı", "👍🏽 é ‍", "\U0010ffff",
]


def texts():
    rng = random.Random(1)
    alpha = "ab cthe  \n\t▁é́日本語🙂\0<s>0x0A>zzz"
    out = TEXTS + ["".join(rng.choice(alpha) for _ in range(rng.randrange(80))) for _ in range(600)]
    return out + [" " * n for n in range(70)] + ["the " * 5 + " " * n + "the" for n in range(40)]


def test_against_the_library(spark, docs, library):
    pairs = [*enumerate(texts()), (9000, None), (3, "again"), (3, "again"), (None, "no id")]
    rows = sp.decode(sp.encode(docs(pairs), PATH), PATH).collect()
    got = sorted((str(r["doc_id"]), list(r["ids"]), r["text"]) for r in rows)
    want = []
    for i, t in pairs:
        ids = library.encode(t or "")
        want.append((str(i), ids, library.decode(ids)))
    assert got == sorted(want)


def test_rounds_and_queue_agree(monkeypatch, library):
    """Segments of any length through the queue, and through the rounds, give the library's ids."""
    some = [t for t in texts() if len(t) < 400]
    model = sp.Model(PATH)
    for long in (1, 10_000):
        monkeypatch.setattr(sp, "LONG", long)
        bounds, ids = sp.Encoder(model).texts(some)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library.encode(some)


def test_words_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(sp, "HELD_CHARS", 50)
    encoder = sp.Encoder(sp.Model(PATH))
    for k in range(30):
        part = [f"word{k} and more words {j}" for j in range(k % 4)] + [""]
        bounds, ids = encoder.texts(part)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library.encode(part)


def test_decode_of_any_ids(spark, library):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(32000) for _ in range(rng.randrange(12))]) for i in range(200)]
    rows += [(300 + i, [rng.choice([0, 1, 2, 259, 264, 28705, *range(3, 259)]) for _ in range(rng.randrange(12))]) for i in range(600)]
    df = spark.createDataFrame([*rows, (2000, None), (2001, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in sp.decode(df, PATH).collect()}
    assert got == {i: library.decode(ids) for i, ids in rows} | {2000: "", 2001: ""}


def test_ids_outside_the_table_are_skipped(spark):
    df = spark.createDataFrame([(1, [264, 32000, -4, 28726])], "doc_id long, ids array<int>")
    assert sp.decode(df, PATH).first()["text"] == "ab"


def test_characters_of_every_length(library):
    """Every fifth-hundredth character and all small ones, alone and doubled."""
    chars = [chr(c) for c in [*range(0x300), *range(0x300, 0x110000, 499)] if not 0xD800 <= c < 0xE000]
    some = [f"{c}{c} a{c}b" for c in chars]
    bounds, ids = sp.Encoder(sp.Model(PATH)).texts(some)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library.encode(some)


def test_empty_and_refused(spark, docs, tmp_path):
    assert sp.digests(docs([]), PATH).collect() == []
    other = tmp_path / "m.model"
    other.write_bytes(b"")
    with pytest.raises(ValueError):
        sp.encode(docs([]), str(other))
