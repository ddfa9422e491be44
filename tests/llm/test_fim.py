import hashlib
import random
import re

import numpy as np

from activepool.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def by_hand(doc_id, text, changed=90, suffix_first=20):
    """The rule of the contract, said with a list of units."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= changed:
        return (doc_id, len(units), "plain", None, None, text, text)
    if h[3] % 100 < suffix_first:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def cut(df):
    return sorted((tuple(r) for r in fim.restore(fim.fill_in_middle(df)).collect()), key=repr)


def test_against_a_list_of_units(spark, docs):
    rng = random.Random(3)
    texts = ["", "a", "Z9", "<P> x", "a<S>", "<M", "<P<S<M>", "<<P", "日本 é́🙂", "Kſ K", "a\n\n b\0c", "x" * 5000, "ab, " * 4000]
    texts += ["".join(rng.choice("abC <>PSM\n日🙂é1") for _ in range(rng.randrange(60))) for _ in range(400)]
    pairs = [*enumerate(texts), (900, None), (None, "no id here"), (3, "again and again"), (3, "again and again"), (-5, "minus, five")]
    got = cut(docs(pairs))
    assert got == sorted((by_hand(i, t) for i, t in pairs), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_same_on_any_partitioning(docs):
    pairs = [(i, f"document {i} says: " + "so on, " * (i % 50)) for i in range(300)]
    assert cut(docs(pairs).coalesce(1)) == cut(docs(pairs).repartition(7)) == sorted((by_hand(i, t) for i, t in pairs), key=repr)


def test_shares(docs):
    pairs = [(i, f"some text {i}") for i in range(2000)]
    forms = [r["form"] for r in fim.fill_in_middle(docs(pairs), changed=50, suffix_first=0).collect()]
    assert 0.45 < forms.count("psm") / 2000 < 0.55 and "spm" not in forms


def test_every_rank_of_a_list():
    """Each rank of each text, through the lanes, is where the units say."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ,.") for _ in range(n)) for n in (0, 1, 2, 5, 0, 300, 5000)] + [""]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lists = fim.SkipLists(codes, np.cumsum([len(t) for t in texts]))
    assert len(lists.lanes) > 3
    for k, t in enumerate(texts):
        units = UNIT.findall(t)
        ranks = np.arange(len(units) + 1)
        at = lists.chars_before(np.full(len(ranks), k), ranks)
        assert at.tolist() == np.cumsum([0, *map(len, units)]).tolist()


def test_empty_table(docs):
    assert cut(docs([])) == []


def test_whole_table(spark, small):
    from activepool.llm.queries import op11

    rows = {r["doc_id"]: r for r in op11(spark, small).collect()}
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(table)
    for r in table:
        want = by_hand(r["doc_id"], r["text"])
        got = rows[r["doc_id"]]
        assert (got["n"], got["form"], got["prefix_chars"], got["middle_chars"]) == want[1:5]
        assert got["output_sha256"] == hashlib.sha256(want[5].encode()).hexdigest()
        assert got["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
