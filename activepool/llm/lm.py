"""Language-model scoring with a hierarchical Pitman-Yor model, fitted by sampling on Spark.

Tokens are lower-cased words and one end for each text. A token's context is the whole word before it (the
start of the text for the first); every context is a restaurant, all share the root restaurant as their parent,
and the root's base is the smoothed unigram distribution. A restaurant seats each token as a customer: at a
table that serves its word already (weight: customers there less the discount) or at a new one (weight: strength
plus discount times tables, times the parent's probability); every new table is a customer of the parent.

One sweep empties and reseats the customers of every (context, word) given all else as the sweep before left it,
without the dish's own tables, then those of every word in the root. That is Gibbs sampling done in parallel, an
approximation (a test holds it against an exact sampler). A pair seen once has one table for good; sweeps touch
the others only. Draws are hashes of (word, context, sweep, customer), the same on every partitioning. Customers
after the 32nd of a word are seated in blocks that grow by an eighth. Predictive probabilities are averaged over
the sweeps after the burn-in.

How it lies on the cluster. Words are dealt to buckets by their hash and numbered there, the commonest first, so a
word is a small number from then on. Shards (bounded runs of rows of one task) post their distinct pairs to
buckets of the context's number; a context with over HOT tokens is split over several buckets by the word. What
travels are packed blocks, one for each shard and bucket or for two buckets: sorted numbers as differences, byte
plane by byte plane, compressed. In a sweep the word buckets send customers and tables of the words that a pair
bucket asked for, the pair buckets seat and send back their new tables; all counts are kept by the two sides, and
no row for each pair is ever written. At the end each shard gets the numbers of its words and pairs in its own
order and adds up its documents. No context, no word and no document is held whole by more than its bucket.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from activepool.llm.common import bounded, mix64, picked, texts_of, uniform
from activepool.session import pinned, scratch_path

SHARD_WORDS = 3_000_000
SHARD_DOCS = 65_000
BURN_IN, KEPT = 3, 4
STRENGTH = 1.0
#: Tokens of a context in one pair bucket, about.
HOT = 1 << 20
#: Local numbers of the end and the start of a text; no word is a line feed or empty.
END, START = 0, 1


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


# --- packed arrays --------------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as byte planes, compressed: planes of zeros are left out or nearly empty."""
    values = np.ascontiguousarray(values, "<u8")
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    data = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return len(values).to_bytes(8, "little") + bytes([planes]) + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, planes = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    raw = pa.decompress(data[9:], decompressed_size=n * planes, codec="zstd", asbytes=True)
    out[:, :planes] = np.frombuffer(raw, np.uint8).reshape(planes, n).T
    return out.view("<u8").reshape(n).astype(np.int64)


def _rising(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _starts(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


#: Every step's rows: what they are, the bucket that they go to, the one they come from, the shard, packed arrays
#: and two sums.
_BLOCK = pa.schema([("kind", pa.string()), ("at", pa.int32()), ("by", pa.int32()), ("shard", pa.int64()), ("d", pa.list_(pa.binary())),
                    ("x", pa.int64()), ("y", pa.int64())])
_BLOCK_DDL = "kind string, at int, by int, shard long, d array<binary>, x long, y long"


def _block(kind, d, at=-1, by=-1, shard=-1, x=0, y=0) -> dict:
    return {"kind": kind, "at": at, "by": by, "shard": shard, "d": d, "x": x, "y": y}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_BLOCK)


# --- shards and numbers ----------------------------------------------------------------------------

_DOCS = pa.schema([*_BLOCK, ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32()))])


def _split(buckets: int):
    """Texts of each shard as local word numbers, and its words' hashes and learning counts by bucket."""

    def flush(shard, numbers, codes, lens, ids, held):
        size = len(numbers)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, size)
        tokens = np.concatenate([np.append(c, END) for c in codes])
        learns = np.repeat(~np.array(held, bool), lens)
        counts = np.bincount(tokens[learns], minlength=size)
        counts[START] = len(held) - sum(held)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        rows = [_block("texts", [_pack(tokens), _pack(place)], shard=shard) | {"doc_ids": ids, "held": held, "lens": lens}]
        none = {"doc_ids": None, "held": None, "lens": None}
        starts = _starts(bucket[order])
        for a, b in zip(starts, np.append(starts[1:], size)):
            at = order[a:b]
            start = int(np.flatnonzero(at == START)[0]) if bucket[START] == bucket[at[0]] else -1
            rows.append(_block("hashes", [hashes[at].tobytes(), _pack(counts[at])], at=int(bucket[at[0]]), shard=shard, x=start) | none)
        yield pa.RecordBatch.from_pylist(rows, schema=_DOCS)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        fresh = lambda: (_Numbers({b"\n": END, b"": START}), [], [], [], [])
        (numbers, codes, lens, ids, held), seen, shard = fresh(), 0, base
        for batch in bounded(batches):
            for doc_id, out, text in zip(batch.column("doc_id"), batch.column("held"), texts_of(batch.column("text"))):
                words = text.lower().split() if text else []
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                lens.append(len(words) + 1)
                ids.append(doc_id.as_py())
                held.append(out.as_py())
                seen += lens[-1]
                if seen >= SHARD_WORDS or len(ids) >= SHARD_DOCS:
                    yield from flush(shard, numbers, codes, lens, ids, held)
                    (numbers, codes, lens, ids, held), seen, shard = fresh(), 0, shard + 1
        if ids:
            yield from flush(shard, numbers, codes, lens, ids, held)

    return run


def _numbered(buckets: int):
    """Numbers (rank in the bucket times buckets plus bucket) and counts of each shard's words; counts by rank."""

    def run(key, table):
        b = key[0].as_py()
        rows = table.select(["shard", "d", "x"]).to_pylist()
        hashes = [np.frombuffer(r["d"][0], np.uint64) for r in rows]
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.concatenate([_unpack(r["d"][1]) for r in rows])
        total = np.zeros(len(known), np.int64)
        np.add.at(total, at, counts)
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        out, first, start = [], 0, -1
        for r, h in zip(rows, hashes):
            own = at[first : first + len(h)]
            if r["x"] >= 0:
                start = int(rank[own[r["x"]]])
            out.append(_block("numbers", [_pack(rank[own] * buckets + b), _pack(total[own])], at=b, shard=r["shard"]))
            first += len(h)
        # The start of a text is a context only, no word.
        words = total[order].copy()
        if start >= 0:
            words[start] = 0
        out.append(_block("totals", [_pack(words)], at=b, x=int(words.sum()), y=int((words > 0).sum())))
        out.append(_block("rare", [], at=b, x=int((words == 1).sum()), y=int((words == 2).sum())))
        return _table(out)

    return run


def _local(texts: pa.Table, others: list[dict]):
    """(tokens by local number, word before, numbers and counts by local number) of a shard."""
    tokens, place = (_unpack(x.as_py()) for x in texts.column("d")[0].values)
    tokens = tokens.astype(np.int32)
    blocks = sorted((r for r in others if r["kind"] == "numbers"), key=lambda r: r["at"])
    ids, total = (np.concatenate([_unpack(r["d"][k]) for r in blocks])[place] for k in range(2))
    lens = texts.column("lens")[0].values.to_numpy()
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lens) - lens] = START
    return tokens, before, lens, ids, total


def _pairs_of(tokens, before, ids, total, buckets):
    """The shard's distinct pairs by (bucket, context, word): (bucket, c, w, each token's place among them)."""
    size = len(ids)
    pairs, at = np.unique(before.astype(np.int64) * size + tokens, return_inverse=True)
    left, right = pairs // size, pairs % size
    c, w = ids[left], ids[right]
    parts = 1 + total[left] // HOT
    part = (mix64(w.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.uint64)
    bucket = (mix64(c.astype(np.uint64) + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((w, c, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return bucket[order], c[order], w[order], place[at.reshape(-1)], left[order], right[order]


def _posted(buckets: int):
    """Distinct pairs of each shard with their learning counts, in a block for each pair bucket."""

    def run(texts, numbers):
        tokens, before, lens, ids, total = _local(texts, numbers.to_pylist())
        bucket, c, w, at, _, _ = _pairs_of(tokens, before, ids, total, buckets)
        learns = np.repeat(~texts.column("held")[0].values.to_numpy(zero_copy_only=False), lens)
        n = np.bincount(at[learns], minlength=len(c))
        starts, shard = _starts(bucket), texts.column("shard")[0].as_py()
        return _table([
            _block("posted", [_rising(c[a:b]), _pack(w[a:b]), _pack(n[a:b])], at=int(bucket[a]), shard=shard)
            for a, b in zip(starts, np.append(starts[1:], len(c)))
        ])

    return run


def _merged(rows: list[dict]):
    """All shards' pairs of a bucket: (c, w, n, place of each posted pair)."""
    c, w, n = (np.concatenate([read(r["d"][k]) for r in rows]) for k, read in enumerate((_risen, _unpack, _unpack)))
    order = np.lexsort((w, c))
    c, w = c[order], w[order]
    first = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(first) - 1
    return c[first], w[first], np.bincount(at, weights=n, minlength=int(first.sum())).astype(np.int64), at


def _summed(buckets: int):
    """Of a pair bucket: pairs seen more than once, what it asks of each word bucket, and its counts for them."""

    def run(key, table):
        p = key[0].as_py()
        c, w, n, _ = _merged(table.select(["shard", "d"]).to_pylist())
        out = []

        def by_bucket(ids):
            """Distinct numbers by (word bucket, rank), each entry's place among them, and the buckets' bounds."""
            order, at = np.unique((ids % buckets) * (1 << 40) + ids // buckets, return_inverse=True)
            return order & ((1 << 40) - 1), at.reshape(-1), np.searchsorted(order, np.arange(buckets + 1) << 40)

        seen = n > 0
        for kind, ids in (("contexts", c[seen]), ("words", w[seen])):
            m = n[seen]
            rank, at, ends = by_bucket(ids)
            sums = [np.bincount(at, weights=x, minlength=len(rank)).astype(np.int64) for x in (m, m == 1, m > 1)]
            for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                part = slice(ends[b], ends[b + 1])
                out.append(_block(kind, [_rising(rank[part]), *(_pack(x[part]) for x in sums)], at=b, by=p))
        many, once, twice = n > 1, int((n == 1).sum()), int((n == 2).sum())
        c, w, n = c[many], w[many], n[many]
        (wr, wi, w_ends), (cr, ci, c_ends) = by_bucket(w), by_bucket(c)
        for b in np.flatnonzero((w_ends[1:] > w_ends[:-1]) | (c_ends[1:] > c_ends[:-1])).tolist():
            out.append(_block("asked", [_rising(wr[w_ends[b] : w_ends[b + 1]]), _rising(cr[c_ends[b] : c_ends[b + 1]])], at=b, by=p))
        key_of = mix64(mix64(w.astype(np.uint64)) + c.astype(np.uint64)).astype(np.uint64)
        one = np.ones(len(n), np.int64)
        out.append(_block("seated", [_pack(wi), _pack(ci), _pack(n), _pack(one), _pack(0 * one), key_of.tobytes()], at=p, x=once, y=twice))
        return _table(out)

    return run


def _binomial(n: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Binomial numbers from hashes: by inversion where few are expected, else rounded normal ones."""
    u, out = uniform(draw), np.zeros(len(n))
    few = n * p < 10
    odds = p / np.maximum(1 - p, 1e-12)
    chance = np.where(few, np.exp(n * np.log1p(-np.minimum(p, 1 - 1e-12))), 1.0)
    upto = chance.copy()
    for k in range(60):
        more = few & (u > upto) & (out < n)
        if not more.any():
            break
        out[more] += 1
        chance = chance * (n - k) / (k + 1) * odds
        upto = upto + np.maximum(chance, 0)
    z = np.sqrt(-2 * np.log(uniform(mix64(draw + np.uint64(1))))) * np.cos(2 * np.pi * uniform(mix64(draw + np.uint64(2))))
    return np.where(few, out, np.clip(np.rint(n * p + np.sqrt(n * p * (1 - p)) * z), 0, n))


def reseat(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables of each dish after its customers are seated one by one.

    ``weight`` is that of a new table without the dish's own tables; each of these adds ``more``.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    seated, step = 1, 0
    more = np.broadcast_to(more, len(customers))
    active = np.nonzero(customers > 1)[0]
    while len(active):
        m = max(1, seated // 8) if seated >= 32 else 1
        left = np.minimum(customers[active] - seated, m)
        t = tables[active]
        a = weight[active] + more[active] * t
        p = a / (a + np.maximum(seated + (left - 1) / 2 - discount * t, 1e-9))
        step += 1
        draw = mix64(key[active] + np.array(step, np.uint64) * np.array(0x9E3779B97F4A7C15, np.uint64))
        new = (uniform(draw) < p).astype(np.float64) if m == 1 else _binomial(left, p, draw)
        tables[active] = t + new
        seated += m
        active = active[customers[active] > seated]
    return tables


def _base(count, tokens: int, words: int):
    """The smoothed unigram probability (of arrays and of columns)."""
    return (count + 0.1) / (tokens + 0.1 * (words + 1))


# --- sweeps ----------------------------------------------------------------------------------------

#: Arrays of a word bucket's state, by rank; behind them customers, tables and context tables of each kept sweep.
TOTAL, ONES, MANY, CTX_TOTAL, CTX_ONES, CUSTOMERS, TABLES, CTX_TABLES, KEEPS = range(9)


def _state(totals, counts):
    """A word bucket before the first sweep: every pair has one table, and every word one in the root."""
    total = _unpack(totals.column("d")[0].values[0].as_py())
    word, context = np.zeros((3, len(total)), np.int64), np.zeros((3, len(total)), np.int64)
    for r in counts.select(["kind", "d"]).to_pylist():
        rank, into = _risen(r["d"][0]), word if r["kind"] == "words" else context
        for k in range(3):
            into[k, rank] += _unpack(r["d"][k + 1])
    customers = word[1] + word[2]
    tables = np.minimum(customers, 1)
    arrays = [total, word[1], word[2], context[0], context[1], customers, tables, context[1] + context[2]]
    return _table([_block("state", [_pack(x) for x in arrays], at=totals.column("at")[0].as_py(), x=int(customers.sum()), y=int(tables.sum()))])


def _served(sweep: int, buckets: int, root_discount: float, root_tables: float, tokens: int, kinds: int):
    """A word bucket after a sweep over the pairs (none: sweep -1), and what each pair bucket asked of it."""
    mark = np.uint64((sweep + 1) * 0xD1342543DE82EF95 % 2**64)

    def run(own, told):
        rows = own.select(["kind", "at", "by", "d"]).to_pylist()
        state = next(r for r in rows if r["kind"] == "state")
        asked = sorted((r for r in rows if r["kind"] == "asked"), key=lambda r: r["by"])
        b, d = state["at"], [_unpack(x) for x in state["d"]]
        wanted = [(r["by"], _risen(r["d"][0]), _risen(r["d"][1])) for r in asked]
        if sweep >= 0:
            tables = {r["by"]: r["d"] for r in told.select(["by", "d"]).to_pylist()}
            more, ctx_more = np.zeros(len(d[TOTAL]), np.int64), np.zeros(len(d[TOTAL]), np.int64)
            for p, words, contexts in wanted:
                more[words] += _unpack(tables[p][0])
                ctx_more[contexts] += _unpack(tables[p][1])
            moves = np.flatnonzero((d[ONES] + d[MANY] > 1) | (d[MANY] > 0))
            d[CUSTOMERS] = d[ONES] + more
            d[CTX_TABLES] = d[CTX_ONES] + ctx_more
            base = _base(d[TOTAL][moves], tokens, kinds)
            own_tables = d[TABLES][moves]
            key = mix64((moves * buckets + b).astype(np.uint64)) + mark
            weight = (STRENGTH + root_discount * (root_tables - own_tables)) * base
            d[TABLES][moves] = reseat(d[CUSTOMERS][moves], weight, root_discount, key, root_discount * base)
            if sweep >= BURN_IN:
                d += [d[CUSTOMERS].copy(), d[TABLES].copy(), d[CTX_TABLES].copy()]
        out = [_block("state", [_pack(x) for x in d], at=b, x=int(d[CUSTOMERS].sum()), y=int(d[TABLES].sum()))]
        for p, words, contexts in wanted:
            out.append(_block("served", [_pack(x) for x in (d[CUSTOMERS][words], d[TABLES][words], d[TOTAL][words], d[CTX_TABLES][contexts])], at=p, by=b))
        return _table(out)

    return run


def _root(customers, tables, total, sums, root_discount, tokens, kinds):
    """Probabilities of words in the root."""
    share = (STRENGTH + root_discount * sums[1]) * _base(total, tokens, kinds)
    return (customers - root_discount * tables + share) / (STRENGTH + sums[0])


def _seat(sweep: int, discount: float, root_discount: float, sums, tokens: int, kinds: int):
    """Reseats the pairs of a pair bucket and tells the word buckets the new tables."""
    mark = np.uint64((sweep + 1) * 0xD1342543DE82EF95 % 2**64)

    def run(seated, served):
        row = seated.select(["at", "d"]).to_pylist()[0]
        wi, ci, n, t, total = (_unpack(x) for x in row["d"][:5])
        name = np.frombuffer(row["d"][5], np.uint64)
        rows = sorted(served.select(["by", "d"]).to_pylist(), key=lambda r: r["by"])
        if not len(n):
            return _table([_block("seated", row["d"], at=row["at"])])
        parts = [[_unpack(x) for x in r["d"]] for r in rows]
        customers, tables, words, contexts = (np.concatenate(x) for x in zip(*parts))
        p = _root(customers, tables, words, sums, root_discount, tokens, kinds)[wi]
        t = reseat(n, (STRENGTH + discount * (contexts[ci] - t)) * p, discount, mix64(name + np.uint64(1)) + mark, discount * p).astype(np.int64)
        if sweep >= BURN_IN:
            total = total + t
        out = [_block("seated", [*row["d"][:3], _pack(t), _pack(total), row["d"][5]], at=row["at"])]
        by_word = np.bincount(wi, weights=t, minlength=len(customers)).astype(np.int64)
        by_context = np.bincount(ci, weights=t, minlength=len(contexts)).astype(np.int64)
        a = c = 0
        for r, x in zip(rows, parts):
            out.append(_block("told", [_pack(by_word[a : a + len(x[0])]), _pack(by_context[c : c + len(x[3])])], at=r["by"], by=row["at"]))
            a, c = a + len(x[0]), c + len(x[3])
        return _table(out)

    return run


# --- scores ----------------------------------------------------------------------------------------


def _pair_values(posted, seated):
    """Counts and summed tables of each shard's pairs, in the shard's order."""
    rows = posted.select(["at", "shard", "d"]).to_pylist()
    _, _, n, at = _merged(rows)
    total = KEPT * np.minimum(n, 1)
    total[n > 1] = _unpack(seated.column("d")[0].values[4].as_py())
    out, first = [], 0
    for r in rows:
        size = int.from_bytes(r["d"][0][:8], "little")
        own = at[first : first + size]
        out.append(_block("pair", [_pack(n[own]), _pack(total[own])], at=r["at"], shard=r["shard"]))
        first += size
    return _table(out)


def _word_values(buckets: int):
    """Counts, customers and tables of each shard's words, in the shard's order."""

    def run(numbers, state):
        d = [_unpack(x.as_py()) for x in state.column("d")[0].values]
        out = []
        for r in numbers.select(["at", "shard", "d"]).to_pylist():
            rank = _unpack(r["d"][0]) // buckets
            out.append(_block("word", [_pack(x[rank]) for x in (d[CTX_TOTAL], *d[KEEPS:])], at=r["at"], shard=r["shard"]))
        return _table(out)

    return run


def log_probability(n, total, tables, p, ctx_n, discount):
    """Predictive log10 probabilities: counts and summed tables of the pairs, and for each kept sweep the tables of
    their contexts and the probabilities of their words in the root."""
    share = 0.0
    for here, above in zip(tables, p):
        share = share + (STRENGTH + discount * here) * above
    return np.log10((np.maximum(n - discount * total / KEPT, 0) + share / KEPT) / (STRENGTH + ctx_n))


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(buckets: int, fit: dict | None, tokens: int, kinds: int):
    """Scores of a shard's documents; without a fit (nothing to learn from) those of the base."""

    def run(texts, values):
        rows = values.select(["kind", "at", "d"]).to_pylist()
        words, before, lens, ids, total = _local(texts, [r for r in rows if r["kind"] == "numbers"])

        def arrays(kind, k):
            """The k-th array of all blocks of a kind, one after the other."""
            return np.concatenate([_unpack(r["d"][k]) for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["at"])])

        # One array of a pair at a time: a shard has millions of them.
        logp = at = None
        if fit is not None:
            *_, at, left, right = _pairs_of(words, before, ids, total, buckets)
            del before, ids
            place = _unpack(texts.column("d")[0].values[1].as_py())
            word = lambda k: arrays("word", k)[place]
            tables = (word(3 * s + 3)[left] for s in range(KEPT))
            p = (_root(word(3 * s + 1), word(3 * s + 2), total, sums, fit["root"], tokens, kinds)[right] for s, sums in enumerate(fit["sums"]))
            logp = log_probability(arrays("pair", 0), arrays("pair", 1), tables, p, word(0)[left], fit["discount"])
            del left, right, place
        base = np.log10(_base(total, tokens, kinds))
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        added = lambda x: np.bincount(doc, weights=x, minlength=len(lens))
        known, base_score = added((total > 0)[words]), added(base[words])
        score = base_score if logp is None else added(logp[at])
        return pa.Table.from_arrays(
            [texts.column("doc_ids")[0].values, texts.column("held")[0].values, pa.array(lens.astype(np.int64)), pa.array(known.astype(np.int64)),
             pa.array(np.full(len(lens), tokens)), pa.array(base_score), pa.array(score)], schema=_SCORED)

    return run


# --- on Spark --------------------------------------------------------------------------------------


class _Kinds:
    """Rows written in a folder for each kind, so that a kind can be read and deleted by itself."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.columns = df.sparkSession, df.columns
        self.path, self.schema = scratch_path(self.spark, name), df.schema
        df.write.partitionBy("kind").parquet(self.path)

    def __getitem__(self, kind: str) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows.where(F.col("kind") == kind).select(*self.columns)

    def drop(self, kind: str = "*") -> None:
        """Deletes a kind's files (all without one), and shuffles that nothing refers to any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path + ("" if kind == "*" else f"/kind={kind}"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


class Fit:
    """Learned tables: ``state`` of the word buckets, ``seated`` pairs of the pair buckets, and the numbers of the fit."""

    def __init__(self, seated, state, discount: float, root: float, sums: list):
        self.seated, self.state = seated, state
        self.numbers = {"discount": discount, "root": root, "sums": sums}


def _sums(served: _Kinds) -> tuple[float, float]:
    r = served["state"].agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
    return float(r["x"]), float(r["y"])


def _fitted(counted: _Kinds, totals: DataFrame, buckets: int, root: float, tokens: int, kinds: int) -> Fit:
    """All sweeps over the counts of ``counted``."""
    r = counted["seated"].agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
    discount = _share(r["x"], r["y"])
    counts = counted["contexts"].unionAll(counted["words"])
    state = pinned(totals.groupBy("at").cogroup(counts.groupBy("at")).applyInArrow(_state, _BLOCK_DDL), "lm-state")
    for kind in ("contexts", "words"):
        counted.drop(kind)
    seated, told, history = counted["seated"], counted["asked"].limit(0), []
    before, sums = None, (0.0, 0.0)
    for sweep in range(-1, BURN_IN + KEPT):
        if sweep >= 0:
            rows = seated.groupBy("at").cogroup(served["served"].groupBy("at"))
            moved = _Kinds(rows.applyInArrow(_seat(sweep, discount, root, sums, tokens, kinds), _BLOCK_DDL), "lm-seated")
            seated, told = moved["seated"], moved["told"]
        own = state.unionAll(counted["asked"])
        now = own.groupBy("at").cogroup(told.groupBy("at")).applyInArrow(_served(sweep, buckets, root, sums[1], tokens, kinds), _BLOCK_DDL)
        now = _Kinds(now, "lm-served")
        state, sums = now["state"], _sums(now)
        if sweep >= BURN_IN:
            history.append(sums)
        if before is not None:
            for old in before:
                old.drop()
        before = [now] if sweep < 0 else [now, moved]
        served = now
    # What only sweeps read goes before the scores are put together.
    counted.drop()
    now.drop("served")
    moved.drop("told")
    return Fit(seated, state, discount, root, history)


def _share(once, twice) -> float:
    return float(np.clip((once or 0) / max((once or 0) + 2 * (twice or 0), 1), 0.1, 0.95))


def lm_scores(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``held_out`` is a condition over ``doc_id``: such rows (and rows for which it is null) are scored, but
    not learned from. Scores are log10 probabilities of the whole text with its end;
    ``10 ** (-score / n_tokens)`` is the perplexity. ``base_score`` is that of the smoothed unigrams.
    ``buckets`` of words and of pairs grow with the square root of the rows unless given; the draws follow
    the numbers of the words, so another number of buckets is another draw.

    Edge cases: null and wordless texts have their end only; without learning rows every word is unknown
    and both scores are the base's; repeated rows are repeated evidence and stay; an empty table gives an
    empty one.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(True))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    if buckets is None:
        buckets = max(8, int(rows.count() ** 0.5 / 4))
    split = _Kinds(rows.mapInArrow(_split(buckets), f"{_BLOCK_DDL}, doc_ids array<long>, held array<boolean>, lens array<int>"), "lm-split")
    hashes = split["hashes"].select(*_BLOCK.names)
    numbered = _Kinds(hashes.groupBy("at").applyInArrow(_numbered(buckets), _BLOCK_DDL), "lm-numbers")
    split.drop("hashes")
    count = lambda kind: numbered[kind].agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
    tokens, kinds = (v or 0 for v in count("totals"))
    texts, values, fit = split["texts"], numbered["numbers"], None
    if tokens:
        posted = pinned(texts.groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(_posted(buckets), _BLOCK_DDL), "lm-posted")
        counted = _Kinds(posted.groupBy("at").applyInArrow(_summed(buckets), _BLOCK_DDL), "lm-counted")
        learned = _fitted(counted, numbered["totals"], buckets, _share(*count("rare")), tokens, kinds)
        fit = learned.numbers
        pairs = posted.groupBy("at").cogroup(learned.seated.groupBy("at")).applyInArrow(_pair_values, _BLOCK_DDL)
        words = values.groupBy("at").cogroup(learned.state.groupBy("at")).applyInArrow(_word_values(buckets), _BLOCK_DDL)
        values = values.unionAll(pairs).unionAll(words)
    return texts.groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(
        _scored(buckets, fit, tokens, kinds),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
