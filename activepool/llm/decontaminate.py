"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a shard (a bounded run of rows of one task) holds, for each term of
the test items, the list of its positions in the shard's documents, numbered through; it is written once.
Windows are a table, too: their terms with their offsets, put in order of rarity by a join with the terms'
counts over the whole corpus; a window with a term that the corpus lacks goes. It is sent to the shards that
have its rarest term, where that term's list, shifted by the term's offset, is intersected with the shifted
list of the next rarest, until it is empty or all terms are through. What is left are exact occurrences (or, with a slop, places
where every term is within that distance of its offset). Documents in front of each other in a shard are
kept apart by a gap, so no window spans two.

Nothing of the test items passes through the driver but their distinct words, while these are few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from activepool.llm.common import bounded, gives_back, maybe_broadcast, picked, texts_of
from activepool.session import pinned

#: Distinct test words sent to the tasks (8 bytes each); with more, all words of the corpus are posted.
VOCABULARY = 1_000_000
SHARD_WORDS = 4_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that are no word characters: 00-2F, 3A-60 (after lowering) and 7B-7F.
_CUT = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in _LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text in lower case (A-Z only)."""
    return text.translate(_CUT).split() if text else []


def _item_words(batches):
    schema = pa.schema([("item", pa.string()), ("words", pa.list_(pa.binary()))])
    for batch in bounded(batches):
        words = [words_of(t) for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("item").cast(pa.string()), pa.array(words, pa.list_(pa.binary()))], schema=schema)


#: kind 0: a block of documents (ids, lens: words of each); kind 1: the positions of a term in the shard.
_INDEX = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("term", pa.int64()), ("ids", pa.list_(pa.int64())),
                    ("lens", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])
_INDEX_DDL = "shard long, kind int, term long, ids array<long>, lens array<int>, places array<int>"


class _Terms(dict):
    """64-bit term hashes, remembered up to a bound; 0 stands for no term."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = _term(word)
        return value


def _term(word: bytes) -> int:
    return (xxhash.xxh3_64_intdigest(word) >> 1) or 1


def _indexed(vocabulary: set[int] | None, gap: int):
    def flush(shard, ids, lens, codes):
        codes = np.concatenate(codes)
        at = np.nonzero(codes)[0]
        order = at[np.argsort(codes[at], kind="stable")].astype(np.int32)
        found, first = np.unique(codes[order], return_index=True)
        n = len(found)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(order))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard)), pa.array(np.ones(n, np.int32)), pa.array(found),
             pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), lists], schema=_INDEX)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "kind": 0, "term": 0, "ids": ids, "lens": lens}], schema=_INDEX)

    def run(batches):
        shard, known = TaskContext.get().partitionId() << 32, _Terms()
        ids, lens, codes, seen = [], [], [], 0
        wanted = None if vocabulary is None else np.sort(np.fromiter(vocabulary, np.int64, len(vocabulary)))
        pad = np.zeros(gap, np.int64)
        for batch in bounded(batches):
            ids += batch.column("doc_id").cast(pa.int64()).to_pylist()
            for text in texts_of(batch.column("text")):
                words = words_of(text)
                lens.append(len(words))
                code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                if wanted is not None and len(wanted):
                    code[wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] != code] = 0
                elif wanted is not None:
                    code[:] = 0
                codes += [code, pad]
                seen += len(words) + gap
            if seen >= SHARD_WORDS:
                yield from flush(shard, ids, lens, codes)
                ids, lens, codes, seen, shard = [], [], [], 0, shard + 1
        if ids:
            yield from flush(shard, ids, lens, codes)

    return run


def build_index(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary: set[int] | None = None, gap: int = 11) -> DataFrame:
    """The written index of ``docs``: of the given term hashes, or of all words."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    return pinned(rows.mapInArrow(_indexed(vocabulary, gap), _INDEX_DDL), "decon-index")


def _within(starts: np.ndarray, places: np.ndarray, slop: int) -> np.ndarray:
    """Whether a place lies within ``slop`` of each start."""
    at = np.searchsorted(places, starts - slop)
    return (at < len(places)) & (places[np.minimum(at, len(places) - 1)] <= starts + slop)


def _matches(gap: int, slop: int):
    """Occurrences, in a shard, of the windows (item, terms from the rarest, their offsets) that came to it."""
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("start", pa.list_(pa.int32())), ("length", pa.list_(pa.int32())), ("item", pa.list_(pa.string()))])

    def run(table, windows):
        kinds, terms = np.asarray(table.column("kind")), np.asarray(table.column("term"))
        lists = table.column("places").combine_chunks()
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        rows = {int(terms[k]): k for k in np.nonzero(kinds)[0]}
        of = lambda t: flat[ends[rows[t]] : ends[rows[t] + 1]] if t in rows else none
        at = int(np.nonzero(kinds == 0)[0][0])
        ids, lens = table.column("ids")[at].as_py(), np.array(table.column("lens")[at].as_py(), np.int64)
        base = np.cumsum(lens + gap) - (lens + gap)
        items, starts, lengths = [], [], []
        none = np.empty(0, np.int64)
        names = windows.column("item")
        for item, (rare, offsets) in enumerate(zip(windows.column("terms").to_pylist(), windows.column("offsets").to_pylist())):
            left = of(rare[0]) - offsets[0]
            for t, o in zip(rare[1:], offsets[1:]):
                if not len(left):
                    break
                places = of(t)
                left = left[_within(left + o, places, slop)] if len(places) else none
            if len(left):
                items.append(np.full(len(left), item))
                starts.append(left.astype(np.int64))
                lengths.append(np.full(len(left), len(rare)))
        items, starts, lengths = (np.concatenate([none, *x]) for x in (items, starts, lengths))
        doc = np.searchsorted(base, starts, side="right") - 1
        keep = (doc >= 0) & (starts - base[doc] < lens[doc]) if len(doc) else np.empty(0, bool)
        items, starts, lengths, doc = items[keep], starts[keep], lengths[keep], doc[keep]
        order = np.lexsort((starts, doc))
        bounds = pa.array(np.searchsorted(doc[order], np.arange(len(ids) + 1)), pa.int32())
        column = lambda x, kind: pa.ListArray.from_arrays(bounds, x.cast(kind))
        label = names.combine_chunks().take(pa.array(items[order])) if len(names) else pa.array([], pa.string())
        return pa.Table.from_arrays(
            [pa.array(np.full(len(ids), table.column("shard")[0].as_py())), pa.array(ids, pa.int64()), pa.array(lens), column(pa.array((starts - base[doc])[order]), pa.int32()),
             column(pa.array(lengths[order]), pa.int32()), column(label, pa.string())], schema=schema)

    return gives_back(run)


_FOUND = "shard long, doc_id long, n_words long, start array<int>, length array<int>, item array<string>"


def _windows(window: int):
    """The windows of each item, as the terms of their words."""
    schema = pa.schema([("item", pa.string()), ("terms", pa.list_(pa.int64()))])

    def run(batches):
        for batch in bounded(batches, 1 << 20):
            names, windows = [], []
            for item, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                terms = [_term(w) for w in words]
                for i in range(max(1, len(terms) - window + 1) if terms else 0):
                    names.append(item)
                    windows.append(terms[i : i + window])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(windows, pa.list_(pa.int64()))], schema=schema)

    return run


def _by_rarity(item_words: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(wid, item, term, terms, offsets): windows whose terms all occur, ``terms`` from the rarest (``term``) on."""
    windows = item_words.mapInArrow(_windows(window), "item string, terms array<long>").distinct()
    windows = pinned(windows.withColumn("wid", F.monotonically_increasing_id()), "decon-windows")
    placed = windows.select("wid", "item", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    ranked = placed.join(counts, "term").groupBy("wid", "item", "length").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("ts"))
    ranked = ranked.where(F.size("ts") == F.col("length"))  # as many as the window has words
    return ranked.select("wid", "item", F.col("ts")[0]["term"].alias("term"), F.col("ts.term").alias("terms"), F.col("ts.offset").alias("offsets"))


def find_matches(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
                 item_text_col="text", window: int = 10, slop: int = 0) -> DataFrame:
    """Every row of ``docs`` with the occurrences of the items' windows in it.

    (doc_id, n_words, matches): ``matches`` lists (start, length, item), in words, item as text; a window
    is ``window`` consecutive words of an item, an item with fewer words is one window. With ``slop`` the
    terms need not stand exactly at their offsets but within that distance of them (proximity).

    Up to VOCABULARY distinct words of the test items go to the tasks, and only they are posted; beyond, all
    words are.

    Edge cases: null or wordless texts have no words and no matches; items that are wordless or have no
    id match nothing; repeated rows stay; an empty ``docs`` gives no rows, empty ``items`` rows without
    matches.
    """
    item_words = pinned(
        picked(items, item=item_col, text=item_text_col).where("item IS NOT NULL")
        .mapInArrow(_item_words, "item string, words array<binary>").distinct(), "decon-items"
    )
    words = item_words.select(F.explode("words").alias("w")).distinct()
    few = words.count() <= VOCABULARY
    vocabulary = {_term(bytes(r["w"])) for r in words.toLocalIterator()} if few else None
    gap = window + 2 * slop + 1
    index = build_index(docs, id_col, text_col, vocabulary, gap)
    wanted = words.mapInArrow(_hashed, "term long")
    postings = index.where("kind = 1")
    counts = postings.groupBy("term").agg(F.sum(F.size("places")).alias("n"))
    counts = pinned(counts.join(wanted, "term", "left_semi"), "decon-counts")
    windows = pinned(_by_rarity(item_words, counts, window), "decon-ranked")
    holds = postings.select(F.col("shard").alias("to"), "term")
    sent = holds.join(maybe_broadcast(windows.select("term", "wid")), "term").select("to", "wid")
    sent = sent.join(windows.select("wid", "item", "terms", "offsets"), "wid")
    found = index.groupBy("shard").cogroup(sent.groupBy("to")).applyInArrow(_matches(gap, slop), _FOUND)
    return found.select("doc_id", "n_words", F.array_sort(F.arrays_zip("start", "length", "item")).alias("matches"))


def _hashed(batches):
    for batch in batches:
        terms = [_term(w.as_py()) for w in batch.column("w")]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64())], names=["term"])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence (overlaps once); ``items`` are the distinct item
    ids, as text and sorted. Options and edge cases as in ``find_matches``.
    """
    found = find_matches(docs, items, **options)
    # Matches are sorted by start; a word counts for the first occurrence that reaches it.
    step = F.aggregate(
        "matches",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, m: F.struct(
            (s["n"] + F.greatest(F.lit(0), m["start"] + m["length"] - F.greatest(s["end"], m["start"]))).alias("n"),
            F.greatest(s["end"], m["start"] + m["length"]).alias("end"),
        ),
    )
    return found.select(
        "doc_id", "n_words", step["n"].cast("long").alias("n_hit"), F.array_sort(F.array_distinct("matches.item")).alias("items")
    ).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """``docs`` without the documents that hold an occurrence; columns unchanged, rows without id stay.

    Decided by row: of an id that repeats with several texts, only those that hold an occurrence go.
    """
    row = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    named = docs.where(F.col(f"`{id_col}`").isNotNull()).select(row.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hit = contamination(named, items, **options).where("contaminated").select(F.col("doc_id").alias("__hit")).distinct()
    hit = maybe_broadcast(pinned(hit, "decon-hit"))
    return docs.join(hit, F.col(f"`{id_col}`").isNotNull() & (row == F.col("__hit")), "left_anti")
