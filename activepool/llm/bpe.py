"""Byte-level BPE over a distinct-word table: split, encode each distinct word once, join back by position.

1. Documents are split into words (pre-tokens and special tokens) where they are read. A shard (a bounded
   run of rows of one task) numbers its distinct words; its texts become blocks of word numbers.
2. A shard's words travel as one sorted block for each word bucket (a hash of the word), so all shards
   meet a word in one bucket, where it is encoded once. A word that is in every text still is one entry
   for each shard.
3. The ids come back as blocks in the same order, and each word position takes its ids by number. The
   texts are written in buckets of the shard, so they are not shuffled for that.
   Decoding joins ids with the id-to-piece table, whose size is that of the vocabulary.

Blocks instead of rows keep word, position and ids at a few bytes each through both shuffles.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from activepool.llm.common import bounded, give_back, gives_back, picked
from activepool.session import scratch_path

#: A shard ends at this many words, distinct words, or bytes of distinct words.
SHARD_WORDS = 1_500_000
SHARD_DISTINCT = 300_000
SHARD_BYTES = 8 << 20
#: Text of a block: what stands in a task many times over (word numbers, places, ids, pieces) while its ids are put together.
BLOCK_BYTES = 1 << 20

#: Fixed value: the splitting pattern of byte-level BPE, with letters and digits as Python's re names them.
WORD = re.compile(r"""'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: Ranges where the pattern above and the library agree on every character (a test goes through all);
#: a text with any other character is split by the library itself.
AGREED = re.compile(r"[^\t-\r -~ -±´-¸º»¿-ʯΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]")


def tokenizer_json(path: str) -> str:
    """The tokenizer file's text; files that aren't plain byte-level BPE are refused."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = [t for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    if not plain or odd or spec.get("normalizer") or spec["model"]["type"] != "BPE":
        raise ValueError("a byte-level BPE tokenizer without prefix space, normalizer or stripping tokens is needed")
    return text


def _load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # Words come here once, so the library's memory of words is of no use, and it outlives its tokenizer: a
    # worker would grow by megabytes with every bucket. Versions without this setting keep theirs.
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)
    return tokenizer


class _Splitter:
    """Words of a text as the tokenizer splits it; special tokens are words of their own."""

    def __init__(self, text: str):
        added = sorted((t["content"] for t in json.loads(text).get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.text, self.library = text, None

    def plain(self, text: str) -> list[str]:
        if not AGREED.search(text):
            return WORD.findall(text)
        if self.library is None:
            self.library = _load(self.text).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        words = []
        for k, part in enumerate(self.special.split(text)):
            words += [part] if k % 2 else self.plain(part) if part else []
        return words


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _packed(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: the high planes are nearly empty."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(n)


def _text_block(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    raw = b"".join(data)
    lens = _packed(np.fromiter(map(len, data), np.uint32, len(data)))
    return len(lens).to_bytes(8, "little") + lens + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _block_words(block: bytes) -> list[bytes]:
    n = int.from_bytes(block[:8], "little")
    ends = np.cumsum(_unpacked(block[8 : 8 + n]), dtype=np.int64).tolist()
    size = int.from_bytes(block[8 + n : 16 + n], "little")
    raw = pa.decompress(block[16 + n :], decompressed_size=size, codec="zstd", asbytes=True)
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


#: kind 0: a block of texts (ids, words of each, data: word numbers); kind 1: a block of words of one
#: bucket; kind 2: the place of each word number in the shard's blocks, bucket by bucket.
_SPLIT = pa.schema(
    [("shard", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
     ("lens", pa.list_(pa.int32())), ("data", pa.binary())]
)
_SPLIT_DDL = "shard long, kind int, bucket int, doc_ids array<long>, lens array<int>, data binary"


def _split(text: str, buckets: int):
    def rows(*items):
        return pa.RecordBatch.from_pylist([dict(zip(_SPLIT.names, x)) for x in items], schema=_SPLIT)

    def shards(batches):
        split, numbers, seen, size, held = _Splitter(text), _Numbers(), 0, 0, False
        shard = TaskContext.get().partitionId() << 32

        def flush():
            words = list(numbers)
            numbers.clear()
            of = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(buckets + 1))
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            yield rows((shard, 2, -1, None, None, _packed(place)))
            for b in range(buckets):
                if ends[b] < ends[b + 1]:
                    yield rows((shard, 1, b, None, None, _text_block([words[i] for i in order[ends[b] : ends[b + 1]]])))

        for batch in bounded(batches, BLOCK_BYTES):
            lens, codes, known = [], [], len(numbers)
            for value in batch.column("text"):
                words = split(value.as_py())
                lens.append(len(words))
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            seen += sum(lens)
            size += sum(map(len, islice(numbers, known, None)))
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            yield rows((shard, 0, -1, ids, lens, _packed(np.concatenate(codes))))
            held = True
            if seen >= SHARD_WORDS or len(numbers) >= SHARD_DISTINCT or size >= SHARD_BYTES:
                yield from flush()
                seen, size, shard, held = 0, 0, shard + 1, False
        if held:  # empty texts only, perhaps
            yield from flush()

    def run(batches):
        yield from shards(batches)
        give_back()  # the numbered words are gone by now

    return run


def _slices(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` of the given starts and lengths, one after the other, and where each ends."""
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)], ends


def _encoded_bucket(text: str):
    """All shards' words of one bucket: each distinct word is encoded once.

    A block's words are numbers as soon as it is read, and ids are flat: no object is kept for an entry.
    """
    schema = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("lens", pa.binary()), ("ids", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        known, blocks = _Numbers(), []
        for x in table.column("data"):
            words = _block_words(x.as_py())
            blocks.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
        all_words, words = list(known), None
        known.clear()
        tokenizer, lens, flat = _load(text), [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for start in range(0, len(all_words), 5_000):
            part = [w.decode() for w in all_words[start : start + 5_000]]
            ids = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            lens.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(lens[-1].sum())))
        lens, flat = np.concatenate(lens), np.concatenate(flat)
        starts = np.cumsum(lens) - lens
        out_lens, out_ids = [], []
        for at in blocks:
            out_lens.append(_packed(lens[at]))
            out_ids.append(_packed(_slices(flat, starts[at], lens[at])[0]))
        return pa.Table.from_arrays(
            [table.column("shard"), table.column("bucket"), pa.array(out_lens, pa.binary()), pa.array(out_ids, pa.binary())],
            schema=schema,
        )

    return gives_back(run)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


_DECODED = pa.schema([*_IDS, ("text", pa.string())])


def _decoded(ids: pa.ListArray, lookup: pa.Array) -> pa.Array:
    """Texts of lists of ids, joined with the id-to-piece table; its last entry is empty, for ids outside."""
    flat = np.asarray(ids.flatten())
    flat = np.where((flat >= 0) & (flat < len(lookup) - 1), flat, len(lookup) - 1)
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)))])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lookup.take(pa.array(flat))), pa.scalar(b"", pa.binary()))
    return pa.array([x.as_py().decode("utf-8", errors="replace") for x in joined], pa.string())


def _joined(table: list[bytes] | None = None):
    """Ids of each text of a shard, taken by word number; with a table of pieces also their text."""

    def run(texts: pa.Table, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("bucket")
        empty = np.empty(0, np.uint32)
        lens = np.concatenate([empty, *(_unpacked(x.as_py()) for x in blocks.column("lens"))]).astype(np.int64)
        flat = np.concatenate([empty, *(_unpacked(x.as_py()) for x in blocks.column("ids"))])
        starts = np.cumsum(lens) - lens
        kind = texts.column("kind").to_numpy()
        place = _unpacked(texts.column("data")[int(np.flatnonzero(kind == 2)[0])].as_py())
        lookup = None if table is None else pa.array([*table, b""], pa.binary())
        batches = []
        for k in np.flatnonzero(kind == 0).tolist():
            at = place[_unpacked(texts.column("data")[k].as_py())]
            ids, ends = _slices(flat, starts[at], lens[at])
            words = texts.column("lens")[k].values.to_numpy()
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            columns = [texts.column("doc_ids")[k].values, lists]
            if lookup is None:
                batches.append(pa.RecordBatch.from_arrays(columns, schema=_IDS))
            else:
                batches.append(pa.RecordBatch.from_arrays([*columns, _decoded(lists, lookup)], schema=_DECODED))
        return pa.Table.from_batches(batches, schema=_IDS if lookup is None else _DECODED)

    return gives_back(run)


def _bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """``df`` written in buckets of ``by`` and read back: what is grouped by it later need not be shuffled."""
    spark = df.sparkSession
    name = f"bpe_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", scratch_path(spark, "bpe-split")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay where the path says
    return table


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    spark = docs.sparkSession
    text = tokenizer_json(path)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = picked(docs, doc_id=id_col, text=text_col).mapInArrow(_split(text, buckets), _SPLIT_DDL)
    split = _bucketed(split, "shard", buckets)
    words = (
        split.where("kind = 1").select("shard", "bucket", "data")
        .groupBy("bucket").applyInArrow(_encoded_bucket(text), "shard long, bucket int, lens binary, ids binary")
    )
    texts = split.where("kind <> 1").select("shard", "kind", "doc_ids", "lens", "data")
    join, ddl = _joined(pieces(text) if decoded else None), "doc_id long, ids array<int>" + (", text string" if decoded else "")
    return texts.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(join, ddl)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: what the tokenizer file encodes the whole text to, no tokens added.

    Edge cases: null is an empty text and has no ids; repeated rows stay repeated; null ids stay; an
    empty table gives an empty one. The tokenizer (a fixed file) is sent to the tasks.
    """
    return _encoded(docs, path, id_col, text_col, decoded=False)


def pieces(text: str) -> list[bytes]:
    """The bytes of each id, in the order of ids (nothing for ids that the file leaves out)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    spec = json.loads(text)
    table = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of every row of ids; special tokens are kept, bytes that aren't UTF-8 become U+FFFD.

    The id-to-piece table has one row for each entry of the vocabulary, so it is small whatever the
    data; each task joins its ids with it. Ids outside the table are skipped and null ids give an
    empty text.
    """
    table = pieces(tokenizer_json(path))

    def run(batches):
        lookup = pa.array([*table, b""], pa.binary())
        for batch in bounded(batches, 4 << 20):
            ids = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, _decoded(ids, lookup)], schema=_DECODED)

    return picked(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, as of ``encode`` and ``decode``.

    A shard's ids are joined with the pieces where they are put together, in the same task.
    """
    return _encoded(docs, path, id_col, text_col, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
