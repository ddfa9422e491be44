"""SentencePiece BPE by vectorised merge rounds.

A text gets a blank in front, blanks become the mark U+2581, and it is cut into words: marks and what follows up
to the next mark. No piece of the model holds a mark behind another character (models that do are refused), so
no merge crosses a cut. Each task encodes a distinct word once and puts texts together by word number.

New words of a batch are one flat array of symbols, cut further into segments wherever two neighbouring
characters stand side by side in no piece. A round looks up the rank (by score) of every pair of neighbours,
takes the segmented minimum, merges its leftmost occurrences that don't overlap in every segment at once, and
drops the segments without a pair, until none is left. Merging all occurrences at once gives what the one-by-one
order gives unless a merged piece has a pair of its own of the same or a better rank; for these pieces
(``risky``, found when the model is read) a round merges the leftmost occurrence of a segment only. Segments of
more than ``LONG`` symbols would take many rounds and go through a queue of pairs, with the same result.

Characters without a piece become the byte pieces of their UTF-8 form. Decoding joins ids with the id-to-piece
table. Rows stay where they are: there is no shuffle.
"""

from __future__ import annotations

import codecs
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from activepool.llm.common import bounded, picked

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Symbols of a segment that goes through the queue.
LONG = 512
#: A task forgets its encoded words beyond so many characters.
HELD_CHARS = 8_000_000

#: Fixed values of the model file: field numbers of its message, and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, UNKNOWN_SURFACE = 3, 35, 44
CHARS_MAP, DUMMY_PREFIX, REMOVE_BLANKS, ESCAPE_BLANKS = 2, 3, 4, 5
BPE = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes):
    """(field number, value) pairs of a protocol buffer message; numbers as int, the rest as bytes."""

    def number(p):
        value = shift = 0
        while True:
            b = data[p]
            value |= (b & 127) << shift
            p, shift = p + 1, shift + 7
            if b < 128:
                return value, p

    p = 0
    while p < len(data):
        tag, p = number(p)
        kind = tag & 7
        if kind == 0:
            value, p = number(p)
        else:
            size, p = number(p) if kind == 2 else ({1: 8, 5: 4}[kind], p)
            value, p = data[p : p + size], p + size
        yield tag >> 3, value


class Model:
    """Lookup arrays of a model file: symbols of characters, pairs with rank and result, risky pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer, form = (dict(next((_fields(v) for k, v in message if k == field), ())) for field in (TRAINER, NORMALIZER))
        entries = [dict(_fields(v)) for k, v in message if k == PIECES]
        self.pieces = [e[1].decode() for e in entries]
        self.kinds = np.array([e.get(3, NORMAL) for e in entries])
        scores = np.array([np.frombuffer(e.get(2, bytes(4)), "<f4")[0] for e in entries])
        plain = form.get(DUMMY_PREFIX, 1) and form.get(ESCAPE_BLANKS, 1) and not form.get(REMOVE_BLANKS, 1) and not form.get(CHARS_MAP)
        if trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or not plain:
            raise ValueError("a BPE model with byte fallback, blank in front and no normalisation is needed")
        if not set(self.kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal = {self.pieces[i]: i for i in np.flatnonzero(self.kinds == NORMAL).tolist()}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a blank behind another character")
        self.unknown_surface = trainer.get(UNKNOWN_SURFACE, b" \xe2\x81\x87 ").decode()
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE).tolist():
            self.byte_ids[int(self.pieces[i][1:-1], 16)] = i

        rank_of = np.unique(-scores, return_inverse=True)[1]
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols) - len(normal))
        self.n_symbols = max(symbols.values(), default=0) + 2  # the last is any other character
        self.char_codes = np.array(sorted(ord(s) for s in symbols if len(s) == 1), np.int64)
        self.char_symbols = np.array([symbols[chr(c)] for c in self.char_codes], np.int64)
        self.risky = np.zeros(self.n_symbols, bool)
        pairs, bigrams = [], set()
        for p, i in normal.items():
            bigrams |= {(ord(a) << 21) | ord(b) for a, b in zip(p, p[1:])}
            for cut in range(1, len(p)):
                parts = symbols.get(p[:cut]), symbols.get(p[cut:])
                if None in parts:
                    continue
                pairs.append((parts[0] * self.n_symbols + parts[1], rank_of[i], i))
                for part in parts:
                    if part < len(self.pieces) and rank_of[i] <= rank_of[part]:
                        self.risky[part] = True
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_ranks, self.pair_pieces = (np.ascontiguousarray(c) for c in pairs.T)
        self.bigrams = np.array(sorted(bigrams), np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray, none: int):
        """Rank and result of each pair (``none`` where there is no such piece)."""
        if not len(self.pair_keys):
            return np.full(len(left), none), np.zeros(len(left), np.int64)
        keys = left * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], none), self.pair_pieces[at]


_NONE = 1 << 40


def _merged_rounds(model: Model, symbols: np.ndarray, segment: np.ndarray, at: np.ndarray):
    """(place, symbol) of what is left of each segment when no pair of it is a piece."""
    ended = []
    inside = np.append(segment[1:] == segment[:-1], False)
    rank = np.full(len(symbols), _NONE)
    piece = np.zeros(len(symbols), np.int64)
    fresh = np.flatnonzero(inside)
    while len(symbols):
        rank[fresh], piece[fresh] = model.pair(symbols[fresh], symbols[fresh + 1], _NONE)
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
        alive = best < _NONE
        if not alive.all():
            ended.append((at[~alive], symbols[~alive]))
            symbols, segment, at, rank, piece, best = (x[alive] for x in (symbols, segment, at, rank, piece, best))
            if not len(symbols):
                break
        hits = np.flatnonzero(rank == best)
        of = segment[hits]
        lead = np.append(True, of[1:] != of[:-1])
        careful = np.maximum.reduceat(model.risky[piece[hits]], np.flatnonzero(lead))[np.cumsum(lead) - 1]
        chain = np.append(True, hits[1:] != hits[:-1] + 1)
        place = np.arange(len(hits)) - np.flatnonzero(chain)[np.cumsum(chain) - 1]
        hits = hits[np.where(careful, lead, place % 2 == 0)]
        symbols[hits] = piece[hits]
        stay = np.ones(len(symbols), bool)
        stay[hits + 1] = False
        symbols, segment, at, rank, piece = (x[stay] for x in (symbols, segment, at, rank, piece))
        moved = np.cumsum(stay)[hits] - 1
        stay[:] = False
        stay[moved] = True
        stay[moved[moved > 0] - 1] = True
        fresh = np.flatnonzero(stay[: len(symbols)])
        inside = np.append(segment[1:] == segment[:-1], False)[fresh]
        rank[fresh[~inside]] = _NONE
        fresh = fresh[inside]
    return ended


def _merged_queue(model: Model, pairs: dict, symbols: list[int]) -> list[tuple[int, int]]:
    """(place, symbol) of what is left of one segment: best rank first, then leftmost."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []

    def offer(i):
        if i >= 0 and after[i] >= 0:
            found = pairs.get(symbols[i] * model.n_symbols + symbols[after[i]])
            if found:
                heapq.heappush(queue, (found[0], i, symbols[i], symbols[after[i]], found[1]))

    for i in range(n):
        offer(i)
    while queue:
        _, i, left, right, piece = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = piece, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [(i, s) for i, s in enumerate(symbols) if s >= 0]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Ids of words, each distinct word once; kept flat, by word number."""

    def __init__(self, model: Model):
        self.model, self.pairs = model, None
        self.symbol_of = np.full(0x110000, model.n_symbols - 1, np.int64)
        self.symbol_of[model.char_codes] = model.char_symbols
        self.forget()

    def forget(self):
        self.numbers = _Numbers()
        self.chars = 0
        self.lens, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids) of words that aren't empty."""
        model = self.model
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.cumsum([0, *map(len, words)])[:-1]
        cut = np.ones(len(codes), bool)
        if len(model.bigrams):
            keys = (codes[:-1] << 21) | codes[1:]
            cut[1:] = model.bigrams[np.minimum(np.searchsorted(model.bigrams, keys), len(model.bigrams) - 1)] != keys
        cut[begins] = True
        segment = np.cumsum(cut) - 1
        symbols, at = self.symbol_of[codes], np.arange(len(codes))
        long = np.bincount(segment)[segment] > LONG
        ended = _merged_rounds(model, symbols[~long], segment[~long], at[~long])
        if long.any():
            if self.pairs is None:
                self.pairs = dict(zip(model.pair_keys.tolist(), zip(model.pair_ranks.tolist(), model.pair_pieces.tolist())))
            for s in np.unique(segment[long]):
                a, b = np.searchsorted(segment, [s, s + 1])
                left = np.array(_merged_queue(model, self.pairs, symbols[a:b].tolist()), np.int64)
                ended.append((left[:, 0] + a, left[:, 1]))
        at, symbols = (np.concatenate(x) for x in zip(*ended))
        order = np.argsort(at)
        at, symbols = at[order], symbols[order]
        # Characters that are no piece: one id for each byte of their UTF-8 form.
        other = symbols >= len(model.pieces)
        c = np.where(other, codes[at], 0)
        n = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        ids = np.repeat(symbols, n)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        wide, c = np.repeat(n, n), np.repeat(c, n)
        byte = np.where(place == 0, c >> (6 * (wide - 1)), 0x80 | ((c >> (6 * (wide - 1 - place))) & 0x3F))
        byte |= np.where((place == 0) & (wide > 1), (0xF00 >> wide) & 0xFF, 0)
        ids = np.where(np.repeat(other, n), model.byte_ids[byte & 0xFF], ids)
        owner = np.searchsorted(begins, np.repeat(at, n), side="right") - 1
        return np.bincount(owner, minlength=len(words)), ids

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): the ids of text k are those from bounds[k] to bounds[k + 1]."""
        if self.chars > HELD_CHARS:
            self.forget()
        numbers, codes, sizes, known = self.numbers, [np.empty(0, np.int64)], [], len(self.numbers)
        for t in texts:
            words = WORD.findall(MARK + t.replace(" ", MARK)) if t else []
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
        if len(numbers) > known:
            new = list(numbers)[known:]
            lens, ids = self.words(new)
            self.lens, self.ids = np.concatenate([self.lens, lens]), np.concatenate([self.ids, ids])
            self.chars += sum(map(len, new))
        starts = np.cumsum(self.lens) - self.lens
        codes = np.concatenate(codes)
        n = self.lens[codes]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return np.append(0, ends)[np.append(0, np.cumsum(sizes)).astype(np.int64)], ids


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: what the model file encodes the whole text to, without begin or end ids.

    Edge cases: null is an empty text and has no ids; repeated rows stay repeated; null ids stay; an empty
    table gives an empty one. The model (a fixed file) is read on the driver and sent to the tasks.
    """
    model = Model(path)

    def run(batches):
        encoder = Encoder(model)
        for batch in bounded(batches, 1 << 20):
            bounds, ids = encoder.texts([t or "" for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], schema=_IDS)

    rows = picked(docs, doc_id=id_col, text=text_col)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def _byte_by_byte(error: UnicodeDecodeError):
    return "�" * (error.end - error.start), error.end


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of every row of ids.

    Control ids give nothing, the unknown id its surface, byte ids that are not UTF-8 one U+FFFD each; the blank
    that encoding put in front goes. The id-to-piece table has the vocabulary's fixed size; each task joins its
    ids with it. Ids outside the table are skipped and null ids give an empty text.
    """
    model = Model(path)
    table = [b"" if k == CONTROL else model.unknown_surface.encode() if k == UNKNOWN else bytes([int(p[1:-1], 16)]) if k == BYTE
             else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds.tolist())]
    silent = np.append(model.kinds == CONTROL, True)
    marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(model.pieces, model.kinds.tolist())] + [False])
    schema = pa.schema([*_IDS, ("text", pa.string())])

    def run(batches):
        codecs.register_error("byte_by_byte", _byte_by_byte)
        lookup = pa.array([*table, b""], pa.binary())
        for batch in bounded(batches, 2 << 20):
            ids = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            flat = ids.flatten().fill_null(-1).to_numpy()
            flat = np.where((flat >= 0) & (flat < len(table)), flat, len(table))
            ends = np.cumsum(pc.list_value_length(ids).to_numpy(), dtype=np.int64)
            said = np.append(np.flatnonzero(~silent[flat]), len(flat))
            opens = said[np.searchsorted(said, np.append(0, ends[:-1]))]  # each text's first id that says anything
            blank = np.append(marked[flat], False)[opens] & (opens < ends)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), lookup.take(pa.array(flat))), pa.scalar(b"", pa.binary()))
            texts = [x.as_py().decode("utf-8", errors="byte_by_byte")[b:] for x, b in zip(joined, blank.astype(int).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], schema=schema)

    rows = picked(encoded, doc_id=id_col, ids=ids_col)
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, through ``encode`` and ``decode``."""
    return decode(encode(docs, path, id_col, text_col), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
