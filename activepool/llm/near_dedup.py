"""Near-duplicate classes by a signature-coordinate inverted join, confirmed on full shingle sets.

Method. A document's set holds its distinct shingles. Each distinct set (class of equal sets) gets a
MinHash signature of POSTED coordinates; a (coordinate, value) pair is a posting key and lists the
classes that have it. Two sets at the threshold agree on at least MATCHES coordinates but for a chance
below 1e-5, so with the keys of a class ordered from the rarest, only its first
(coordinates - MATCHES + 1) keys need posting: two matching classes meet in one of these prefixes. Keys
of one class only take places of the prefix and are never posted, so documents without a near copy
leave at once, and keys that very many unrelated documents share fall behind the prefix.

Lists are merged with skipping. First every list is paired with its most popular document (popularity: how
many postings its keys have; the origin of a group of copies comes first), and lists of which that reached
less than half have up to two more such rounds. Then each pair still open is met once, at the first key both post. A pair
is skipped when links found earlier join both already (only components are asked for), when sizes or the
rare shingles that both do not share rule the threshold out, or when the distances to one pivot differ by
too much (Jaccard distance is a metric). Collisions of the other pairs are counted over all coordinates,
and pairs above the match threshold are confirmed on the full sets: by halves of the shingles' 64-bit hashes,
and by the whole hashes where the halves leave a doubt. So a group of copies costs a few
pairs for each copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from activepool.llm.common import BROADCAST_IDS, bounded, components, maybe_broadcast, mix64, picked, texts_of
from activepool.session import pinned

POSTED = 64
CHECKED = 192
#: A pair at similarity 0.8 has 51 of 64 posted and 205 of all 256 matches on average, with deviations of
#: 3.2 and 6.4: fewer than these have a chance below 1e-5.
MATCHES = 36
ALL_MATCHES = 174
#: Rounds in which each list is paired with one document only, before the pairs that are still open.
STAR_ROUNDS = 3
#: Documents in lists of at least DENSE have their rare shingles (in at most RARE of them) listed before they
#: are paired; sets over RARE_SIZE are paired without.
DENSE = 128
RARE = 96
RARE_SIZE = 2_000

_SEEDS = mix64(np.arange(1, POSTED + CHECKED + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``size`` are one shingle, none give none.

    ``bytes.lower`` touches A-Z only and ``bytes.split`` cuts at 0x20 and 0x09 to 0x0D only.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(s)


def sketch(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Posting keys (64 bits: the coordinate and its smallest shingle) and one byte of every coordinate."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    least = np.full(POSTED + CHECKED, 0xFFFFFFFF, np.uint32)
    at = np.zeros(POSTED, np.int64)
    for start in range(0, len(x), 2048):
        part = _ODD[:, None] * x[None, start : start + 2048]
        first = part[:POSTED].argmin(axis=1)
        values = part[np.arange(POSTED), first]
        better = values < least[:POSTED]
        at[better] = first[better] + start
        least[:POSTED] = np.minimum(least[:POSTED], values)
        least[POSTED:] = np.minimum(least[POSTED:], part[POSTED:].min(axis=1))
    keys = mix64(s[at] ^ _SEEDS[:POSTED])
    return keys.view(np.int64), ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _named(size: int):
    """Size and name of each row's set; other columns than the text stay."""

    def run(batches):
        hashes = _WordHashes()
        for batch in bounded(batches):
            sets = [shingle_set(text, size, hashes) for text in texts_of(batch.column("text"))]
            given = [x for x in batch.schema.names if x not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) for s in sets], pa.binary()),
                 *[batch.column(x) for x in given]],
                names=["doc_id", "n", "key", *given],
            )

    return run


def _of_owners(size: int, make, fields: list):
    """``make`` of the set of each class, from the text of its owner.

    A row of the owner's id with another text is passed over, and so are repeated rows of one task.
    """
    schema = pa.schema([("cid", pa.int64()), *fields])

    def run(batches):
        hashes, seen = _WordHashes(), set()
        for batch in bounded(batches):
            rows = []
            for cid, key, text in zip(batch.column("cid").to_pylist(), batch.column("key"), texts_of(batch.column("text"))):
                if cid not in seen:
                    s = shingle_set(text, size, hashes)
                    if _name(s) == key.as_py():
                        seen.add(cid)
                        rows.append((cid, *make(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, with one row for each cid; only repeated rows in several tasks make that a shuffle."""
    df = pinned(df, name)
    counts = df.agg(F.count("*").alias("n"), F.count_distinct("cid").alias("cids")).first()
    return df if counts["n"] == counts["cids"] else pinned(df.dropDuplicates(["cid"]), name)


def _short(s: np.ndarray) -> tuple[bytes, bytes, int]:
    """The upper and the lower halves of the set's 64-bit hashes, in their order, with its size."""
    return (s >> np.uint64(32)).astype(np.uint32).tobytes(), s.astype(np.uint32).tobytes(), len(s)


def _counted(batches):
    """Collisions over all coordinates; pairs below the match threshold go."""
    for batch in bounded(batches):

        def bytes_(name):
            return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(batch.num_rows, POSTED + CHECKED)

        keep = (bytes_("chk_a") == bytes_("chk_b")).sum(axis=1) >= ALL_MATCHES
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirmed(percent: int):
    """Common shingles of each pair by the upper halves, linked or not, and whether that is in doubt.

    Upper halves alone may count shingles of different hashes as common (of two sets of n by chance
    n * n / 2^32) and pass over common ones whose halves coincide in a set. Where these errors could move the
    pair over the threshold it is in doubt.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("total", pa.int64()), ("doubt", pa.bool_())])

    def run(batches):
        for batch in bounded(batches):
            rows = []
            for x, y, n, m in zip(*(batch.column(c) for c in ("set_a", "set_b", "n_a", "n_b"))):
                x, y = (np.frombuffer(v.as_py(), np.uint32) for v in (x, y))
                x, y = (v if (v[1:] != v[:-1]).all() else np.unique(v) for v in (x, y))
                common, n, m = len(np.intersect1d(x, y, assume_unique=True)), n.as_py(), m.as_py()
                chance = n * m / 2**32
                most = common + n + m - len(x) - len(y)
                least = common - int(np.ceil(2 + chance + 6 * np.sqrt(chance)))
                rows.append((common, n + m, (100 * most >= percent * (n + m - most)) != (100 * least >= percent * (n + m - least))))
            common, total, doubt = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64()), pa.array(doubt, pa.bool_())], schema=schema)

    return run


def _exact(batches):
    """Common shingles of each pair by the whole hashes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("total", pa.int64())])
    for batch in bounded(batches):
        common, total = [], []
        for x, u, y, v, n, m in zip(*(batch.column(c) for c in ("set_a", "low_a", "set_b", "low_b", "n_a", "n_b"))):
            x, u, y, v = (np.frombuffer(h.as_py(), np.uint32).astype(np.uint64) for h in (x, u, y, v))
            common.append(len(np.intersect1d(x << np.uint64(32) | u, y << np.uint64(32) | v, assume_unique=True)))
            total.append(n.as_py() + m.as_py())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], schema=schema)


def _checked(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Pairs (a, b) above the match threshold with their similarity, as a written table.

    Sketches and sets of documents without a pair stay where they are: the ids of the pairs, while
    few, are sent to the scans. Lower halves are read for pairs in doubt only.
    """
    counted = pinned(_with_both(pinned(pairs, f"{name}-pairs"), sketches, "chk").mapInArrow(_counted, "a long, b long"), f"{name}-counted")
    ddl = "a long, b long, common long, total long"
    found = pinned(_with_both(counted, sets.drop("low"), "set").mapInArrow(_confirmed(percent), f"{ddl}, doubt boolean"), f"{name}-confirmed")
    doubt = found.where("doubt").select("a", "b")
    if doubt.limit(1).count():
        again = _with_both(pinned(doubt, f"{name}-doubt"), sets, "set").mapInArrow(_exact, ddl)
        found = pinned(found.where("NOT doubt").drop("doubt").union(again), f"{name}-exact")
    united = F.col("total") - F.col("common")
    return found.select("a", "b", (F.col("common") / united).alias("jaccard"), (100 * F.col("common") >= percent * united).alias("linked"))


def _with_both(pairs: DataFrame, table: DataFrame, prefix: str) -> DataFrame:
    """Written ``pairs`` with the columns of ``table`` for a and b.

    The b side is one row of the table for each of its pairs; the a sides, few and shared by many
    pairs, come once.
    """
    columns = [c for c in table.columns if c != "cid"]
    named = lambda side: [F.col(c).alias(f"{prefix if c == 'data' else c}_{side}") for c in columns]
    left = table.join(maybe_broadcast(pairs.select(F.col("a").alias("cid")).distinct()), "cid", "left_semi")
    both = table.select(F.col("cid").alias("b"), *named("b")).join(maybe_broadcast(pairs), "b")
    return both.join(left.select(F.col("cid").alias("a"), *named("a")), "a")


def _near_links(alive: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, rare_shingles) -> DataFrame:
    """Confirmed links (a, b), enough of them to join every component.

    ``rare_shingles`` gives, for documents (cid), those of their shingles that few of them have (``rare``).
    """
    share = percent / 100
    posts = pinned(alive.select("cid", "n", "pop", F.explode("prefix").alias("token")), "near-posts")
    # Tables of a row for each document in question: sent to the tasks while they are few, else shuffled.
    few = alive.count() <= BROADCAST_IDS
    sent = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    state = alive.select(
        "cid", F.col("cid").alias("root"), F.lit(None).cast("long").alias("pivot"), F.lit(0.0).alias("near")
    )
    sizes = pinned(posts.groupBy("token").agg(F.count("*").alias("size")), "near-sizes")
    found, tried = [], None
    close = (F.col("n") >= share * F.col("ln")) & (F.col("ln") >= share * F.col("n"))
    for turn in range(STAR_ROUNDS):
        placed = posts.join(sent(state.select("cid", "root")), "cid")
        rest = placed
        if tried is not None:
            roots = state.select(F.col("cid").alias("leader"), "root")
            done = pinned(tried.join(sent(roots), "leader").select("token", "root").distinct(), f"near-done{turn}")
            rest = placed.join(maybe_broadcast(done), ["token", "root"], "left_anti")
        elected = rest.groupBy("token").agg(F.max(F.struct("pop", "cid", "n", "root")).alias("m"), F.count("*").alias("left"))
        if tried is not None:
            # Another leader only where those before reached less than half of the list.
            elected = elected.join(maybe_broadcast(sizes), "token").where(2 * F.col("left") > F.col("size"))
        lead = pinned(
            elected.select("token", F.col("m.cid").alias("leader"), F.col("m.n").alias("ln"), F.col("m.root").alias("lroot")),
            f"near-lead{turn}",
        )
        pairs = (
            placed.join(maybe_broadcast(lead), "token").where((F.col("root") != F.col("lroot")) & close)
            .select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
        )
        checked = _checked(pairs, sketches, sets, percent, f"near-star{turn}")
        found.append(checked)
        # Of two linked roots the less popular one hooks on the other; hooks are followed to their end.
        place = alive.select("cid", F.struct("pop", "cid").alias("o"))
        ends = checked.where("linked").select("a", "b")
        for side in ("a", "b"):
            at = state.select(F.col("cid").alias(side), F.col("root").alias("cid")).join(sent(place), "cid")
            ends = ends.join(sent(at.select(side, F.col("o").alias(f"o_{side}"))), side)
        hook = pinned(
            ends.where("o_a <> o_b")
            .select(F.least("o_a", "o_b")["cid"].alias("low"), F.greatest("o_a", "o_b").alias("o"))
            .groupBy("low").agg(F.max("o").alias("o")).select("low", F.col("o.cid").alias("high")),
            f"near-hook{turn}",
        )
        while True:
            further = hook.select(F.col("low").alias("high"), F.col("high").alias("further"))
            step = pinned(hook.join(sent(further), "high", "left").select("low", F.coalesce("further", "high").alias("high"), F.col("further").isNotNull().alias("moved")), f"near-hook{turn}")
            hook = step.select("low", "high")
            if not step.where("moved").limit(1).count():
                break
        pivots = checked.select("b", "a", "jaccard").union(checked.select(F.col("a").alias("b"), "a", F.lit(1.0).alias("jaccard")))
        pivots = pivots.groupBy(F.col("b").alias("cid")).agg(F.max(F.struct("jaccard", "a")).alias("p"))
        state = pinned(
            state.join(sent(pivots), "cid", "left").join(sent(hook), F.col("root") == F.col("low"), "left")
            .select("cid", F.coalesce("high", "root").alias("root"),
                    F.when(F.col("p.jaccard") > F.col("near"), F.col("p.a")).otherwise(F.col("pivot")).alias("pivot"),
                    F.greatest(F.coalesce("p.jaccard", F.lit(0.0)), "near").alias("near")),
            f"near-state{turn}",
        )
        tried = lead.select("token", "leader") if tried is None else tried.union(lead.select("token", "leader"))

    # What the rounds have not joined: every pair of two roots, once, at the first key both post.
    placed = posts.select("token", "cid", "n").join(sent(state), "cid")
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high")
    open_ = placed.join(maybe_broadcast(pinned(mixed.select("token", "size"), "near-mixed")), "token")
    open_ = open_.join(alive.select("cid", "prefix"), "cid")
    open_ = pinned(open_, "near-open")
    dense = pinned(open_.where(F.col("size") >= DENSE).select("cid").distinct(), "near-dense")
    open_ = open_.drop("size").join(pinned(rare_shingles(dense), "near-rare"), "cid", "left")
    other = open_.select(*[F.col(c).alias(f"o_{c}") for c in open_.columns])
    # Of the rare shingles exactly the common ones are shared, of the others at most all of the smaller set's.
    others = F.least(F.col("n") - F.size("rare"), F.col("o_n") - F.size("o_rare"))
    most = others + F.size(F.array_intersect("rare", "o_rare"))
    in_reach = F.coalesce(100 * most >= percent * (F.col("n") + F.col("o_n") - most), F.lit(True))
    pairs = open_.join(
        other,
        (F.col("token") == F.col("o_token"))
        & (F.col("cid") < F.col("o_cid"))
        & (F.col("root") != F.col("o_root"))
        & (F.col("n") >= share * F.col("o_n"))
        & (F.col("o_n") >= share * F.col("n"))
        & in_reach
        & ~(F.coalesce(F.col("pivot") == F.col("o_pivot"), F.lit(False)) & (F.abs(F.col("near") - F.col("o_near")) > 1 - share + 1e-3))
        & (F.array_intersect("prefix", "o_prefix")[0] == F.col("token")),
    ).select(F.col("cid").alias("a"), F.col("o_cid").alias("b"))
    found.append(_checked(pairs, sketches, sets, percent, "near-rest"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return pinned(links.where("linked").select("a", "b").distinct(), "near-links")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_shingles, component_id, kept, n_links).

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``size``-word
    shingles; ``component_id`` is the smallest id reachable over links and ``kept`` marks that document.
    ``n_links`` counts the confirmed links of the document's set to other sets (sets already joined are
    not compared again, so inside a group it is a lower bound). ``percent`` below 80 is refused: the
    match thresholds are set for 80 and more.

    Edge cases: null or wordless texts have no shingles, are linked with nothing and kept; repeated
    rows stay, with equal values; a row without an id is linked with nothing, has no component and is
    kept; an empty table gives an empty one.
    """
    return _decided(picked(docs, doc_id=id_col, text=text_col), size, percent)


def _decided(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of ``near_duplicates`` for ``rows(doc_id, text)``, with ``text_hash`` if they have that column."""
    if percent < 80:
        raise ValueError("similarity below 0.8 isn't covered by the match thresholds")
    given = [c for c in rows.columns if c == "text_hash"]
    signed = pinned(rows.mapInArrow(_named(size), ", ".join(["doc_id long, n long, key binary", *[f"{c} long" for c in given]])), "near-named")
    owners = pinned(
        signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("key", "n").agg(F.min("doc_id").alias("rep"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "near-owners",
    )

    def of_owners(classes: DataFrame, make, fields, ddl: str) -> DataFrame:
        classes = maybe_broadcast(classes.select(F.col("rep").alias("doc_id"), "cid", "key"))
        texts = rows.join(classes, "doc_id").select("cid", "key", "text")
        return texts.mapInArrow(_of_owners(size, make, fields), ddl)

    signatures = of_owners(
        owners, sketch, [("sig", pa.list_(pa.int64())), ("data", pa.binary())], "cid long, sig array<long>, data binary"
    )
    signatures = _once(signatures, "near-signatures")
    posts = signatures.select("cid", F.explode("sig").alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    listed = (
        posts.join(shared, "token")
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))  # at most POSTED entries
        .where(F.size("ts") >= MATCHES)
        .select(
            "cid",
            F.aggregate("ts", F.lit(0).cast("long"), lambda s, t: s + t["df"]).alias("pop"),
            F.slice(F.col("ts.token"), F.lit(1), F.size("ts") - MATCHES + 1).alias("prefix"),
        )
    )
    alive = pinned(listed.join(owners, "cid"), "near-alive")
    sketches = pinned(
        signatures.select("cid", "data").join(maybe_broadcast(alive.select("cid")), "cid", "left_semi"), "near-sketches"
    )
    sets = of_owners(
        alive, _short, [("data", pa.binary()), ("low", pa.binary()), ("n", pa.int64())], "cid long, data binary, low binary, n long"
    )

    def rare_shingles(ids: DataFrame) -> DataFrame:
        short = alive.where(F.col("n") <= RARE_SIZE).join(ids, "cid", "left_semi")
        texts = of_owners(short, lambda s: (s.view(np.int64),), [("hs", pa.list_(pa.int64()))], "cid long, hs array<long>")
        flat = pinned(texts.select("cid", F.explode("hs").alias("h")).distinct(), "near-flat")
        few = flat.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
        listed = flat.join(few, "h").groupBy("cid").agg(F.collect_list("h").alias("rare"))
        return short.select("cid").join(listed, "cid", "left").select("cid", F.coalesce("rare", F.array().cast("array<long>")).alias("rare"))

    links = _near_links(alive.drop("key"), sketches, _once(sets, "near-sets"), percent, rare_shingles)
    classes = owners

    degree = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("cid")).agg(F.count("*").alias("n_links"))
    labels = components(links, "near-components")
    joined = labels.join(classes.select(F.col("cid").alias("node"), "key", "rep"), "node").join(
        degree.withColumnRenamed("cid", "node"), "node", "left"
    )
    joined = pinned(joined, "near-joined")
    lowest = joined.groupBy("label").agg(F.min("rep").alias("lowest"))
    by_key = pinned(joined.join(lowest, "label").select("key", "lowest", "n_links"), "near-lowest")
    placed = classes.select("key", "rep").join(maybe_broadcast(by_key), "key", "left")
    placed = placed.select("key", F.coalesce("lowest", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    named = signed.select("doc_id", F.col("n").alias("n_shingles"), "key", *given)
    out = named.where("n_shingles > 0 AND doc_id IS NOT NULL").join(placed, "key").select("doc_id", "n_shingles", "component_id", "n_links", *given)
    alone = named.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), *given
    )
    return out.union(alone).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_links", *given
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents of which a near copy with a smaller id stays; columns unchanged.

    Decided by row: of an id that repeats with several texts, only the near copies go. Rows without an id
    stay; rows that repeat an id that stays, stay too.
    """
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    gone = _decided(rows, size, percent).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    same = (F.col(f"`{id_col}`") == F.col("__gone")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__hash"))
    return docs.join(maybe_broadcast(pinned(gone, "near-gone")), same, "left_anti")
