import hashlib
import random

import numpy as np
import pytest

from activepool.llm import chat, fingerprint

NASTY = ["\\### Assistant: </turn> ok", "", "a\\", "\\\\", "### user: </turn>\n", "#<\\#", "line\nbreak: x", "🙂<é", "</turn", "\\"]


def test_format_is_reversible():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "o:dd ", ""]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))) for _ in range(rng.randrange(1, 6))]
        text, starts, ends = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in zip(starts, ends)] == [t for r, t in turns if r == "assistant"]


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")


def test_trees(spark):
    rows = [
        (1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "bad", 0.0), (1, 3, 1, "assistant", "good", 3.0), (1, 4, 3, "user", "more", 0.0),
        (1, 5, 4, "assistant", "end", 3.0), (2, 9, 77, "user", "orphan", None), (None, 1, None, "user", None, None), (2, 9, 77, "user", "orphan", None),
    ]
    found = chat.branches(messages(spark, rows)).collect()
    of = {}
    for r in found:
        of.setdefault((r["conv_id"], r["rank"], r["leaf"]), []).append((r["dist"], r["node"]))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in of.items()} == {
        (1, 1, 5): [1, 3, 4, 5], (1, 2, 2): [1, 2], (2, 1, 9): [9], (None, 1, 1): [1],
    }
    best = {r["conv_id"]: chat.parse_turns(r["formatted"]) for r in chat.format_conversations(messages(spark, rows)).collect()}
    assert best == {
        1: [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")], 2: [("user", "orphan")], None: [("user", "")],
    }
    assert chat.format_conversations(messages(spark, rows), top=None).count() == 4


def test_paths_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(12):
        for node in range(rng.randrange(1, 60)):
            rows.append((conv, node, rng.randrange(node) if node and rng.random() < 0.95 else None, "user", "t", rng.random()))
    parent = {(c, n): p for c, n, p, *_ in rows}
    inner = {(c, p) for c, n, p, *_ in rows}
    expected = set()
    for c, n in parent:
        if (c, n) not in inner:
            at, dist = n, 0
            while at is not None:
                expected.add((c, n, at, dist))
                at, dist = parent[c, at], dist + 1
    assert {tuple(r) for r in chat.paths(messages(spark, rows)).collect()} == expected


def test_circle_is_refused(spark):
    rows = [(1, 1, 2, "user", "a", None), (1, 2, 1, "user", "b", None), (1, 3, 1, "user", "c", None)]
    with pytest.raises(ValueError):
        chat.paths(messages(spark, rows))


def test_conversations_by_turn(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*NASTY, None]), "x") for c in range(20) for t in range(rng.randrange(1, 12))]
    rows += [(50, 1, "user", "same", "x")] * 2 + [(51, t, "assistant", f"{t}", "x") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.chain(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t, r is not None, r or "", x is not None, x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, _, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, _, x in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.format_conversations(chat.chain(df.limit(0))).collect() == []


def test_equal_substrings_share_phrases():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    core = text(3000)
    a, b, c = fingerprint.phrases([text(137) + core, core + text(500), text(3000)])
    common = np.intersect1d(a, b)
    assert len(common) > 0.75 * min(len(a), len(b))
    assert len(np.intersect1d(a, c)) < 0.02 * len(a)


def test_parse_does_not_depend_on_neighbours():
    rng = random.Random(5)
    texts = ["", "a", "aaaa", "ab" * 50, "x" * 1000] + ["".join(rng.choice("ab c") for _ in range(rng.randrange(200))) for _ in range(40)]
    together = fingerprint.phrases(texts)
    assert all((fingerprint.phrases([t])[0] == p).all() for t, p in zip(texts, together))
    assert all(len(p) for t, p in zip(texts, together) if t)


def test_blocks_are_short():
    rng = random.Random(6)
    names = fingerprint.mix64(np.array([rng.randrange(60) for _ in range(50_000)], np.uint64))
    blocks, _ = fingerprint.parse_level(names, np.zeros(len(names), np.int64))
    assert 2 < len(names) / len(blocks) < 6


def brute_compared(pairs):
    rows = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        x, y, z = fingerprint.sketches([t, edited, after])
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint._hex(x), fingerprint._hex(y), fingerprint.likeness(x, y), fingerprint.likeness(x, z)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 150])
def test_compared_with_the_next(spark, docs, n):
    rng = random.Random(n)
    pairs = [(rng.randrange(10**12), "".join(rng.choice("abc 🙂") for _ in range(rng.randrange(300)))) for _ in range(n)]
    if n > 2:
        pairs += [(pairs[0][0], "again"), (None, "no id"), (None, None), (5, None), (6, ""), (7, pairs[3][1])]
    got = sorted((tuple(r) for r in fingerprint.compare_edited(docs(pairs)).collect()), key=repr)
    assert got == brute_compared(pairs)


def test_equal_texts_have_equal_fingerprints(spark, docs):
    rows = fingerprint.fingerprints(docs([(1, "some text here"), (2, "some text here"), (3, "else"), (4, None), (5, "")])).collect()
    marks = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert marks[1] == marks[2] != marks[3] and marks[4] == marks[5] == ""
