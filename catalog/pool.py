"""Pool access, validity and hashed features."""

from __future__ import annotations

from pyspark.sql import functions as F

from activepool.functions.tokens import EMPTY_STEP, KEY_COUNT, KEY_SYMBOLS, WORDS, feature_slots, fully_tokenized
from activepool.operators import rows as rw
from activepool.operators.pool import make_pool
from activepool.session import spread

from .registry import POOL, pool, query
from .sources import stored_parts

LETTERS = "[a-zA-Z ]"


@query(
    "prj16_pick_rows",
    f"""WITH {POOL} SELECT id, payload, cluster_id FROM pool
    WHERE id IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 900)""",
)
def prj16(t):
    """Rows of a key list (the parts with the largest volume)."""
    keys = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    return rw.pick(pool(t).select("id", "payload", "cluster_id"), keys.filter("q > 900"))


@query(
    "prj16_slice_rows",
    f"""WITH {POOL}, r AS (SELECT id, payload, row_number() OVER (ORDER BY payload, id) AS p FROM pool),
    n AS (SELECT count(*) // 4 AS q FROM pool) SELECT id, payload FROM r, n WHERE p > q AND p <= 3 * q""",
)
def prj16_slice(t):
    """The middle half of the pool in payload order."""
    rows = pool(t).select("id", "payload")
    quarter = rows.count() // 4
    return rw.slice_rows(rows, quarter, 3 * quarter, [F.col("payload").asc(), F.col("id").asc()])


@query(
    "prj16_slice_stored_rows",
    """WITH r AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS p FROM part),
    n AS (SELECT count(*) // 4 AS q FROM part) SELECT p_partkey, p_name FROM r, n WHERE p > q AND p <= 3 * q""",
)
def prj16_slice_stored(t):
    """The middle half of the stored rows by position; files outside of it are not read."""
    stored = stored_parts(t)
    return stored.slice(stored.n // 4, 3 * (stored.n // 4))


@query(
    "prj16_membership",
    """SELECT b.item_id, b.text IN (SELECT text FROM documents) AS found FROM benchmark b""",
)
def prj16_membership(t):
    known = rw.contains(t.documents, t.benchmark, key="text")
    return known.select("item_id", "found")


@query(
    "fil1_validate_rows",
    """SELECT doc_id, regexp_full_match(text, '[a-zA-Z0-9 .,:;!?\\n''"()/@_\\-]+') AND length(trim(text)) > 0 AS valid FROM documents""",
)
def fil1(t):
    """Valid = non-blank and made of known characters only; both sides of the split."""
    pattern = "[a-zA-Z0-9 .,:;!?\\n'\"()/@_\\-]"
    rows = t.documents.select("doc_id", "text")
    valid, invalid = rw.split_valid(rows, "text", lambda c: fully_tokenized(c, pattern))
    flagged = valid.select("doc_id", F.lit(True).alias("valid"))
    return flagged.unionByName(invalid.select("doc_id", F.lit(False).alias("valid")))


@query(
    "udf6_validity_predicate",
    """SELECT count(*) FILTER (WHERE lang = 'en') AS n_valid, count(*) FILTER (WHERE lang <> 'en') AS n_invalid FROM documents""",
)
def udf6(t):
    """A user's own predicate on the key."""
    return rw.validity_counts(t.documents, "lang", lambda c: c == "en")


@query(
    "fil3_skip_invalid_ids",
    """SELECT d.doc_id, d.lang FROM documents d
       WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def fil3(t):
    invalid = t.labels.filter(F.col("toxic") == 1).select("doc_id")
    return rw.without_invalid(t.documents.select("doc_id", "lang"), invalid, key="doc_id")


@query(
    "fil7_non_numeric_scores",
    """SELECT event_id, try_cast(v AS double) AS score FROM (
         SELECT event_id, CASE WHEN value < 5 THEN 'err' ELSE value::varchar END AS v FROM events)
       WHERE try_cast(v AS double) IS NOT NULL""",
)
def fil7(t):
    from activepool.functions import parse_float

    text = F.when(F.col("value") < 5, F.lit("err")).otherwise(F.col("value").cast("string"))
    rows = t.events.select("event_id", parse_float(text).alias("score"))
    return rows.filter(F.col("score").isNotNull())


# --- hashed features --------------------------------------------------------------------------

# Line-notation tokens are single characters in the names used here.
WORDS_SQL = "regexp_extract_all(text, '([^ \\n\\t\\r]+)', 1)"
WIDTH = 512


def _slot_sql(gram: str, width: int = WIDTH) -> str:
    return f"(('0x' || substr(md5({gram}), 1, 8))::bigint % {width})::int"


def _features_sql(grams: str, table: str = "documents") -> str:
    return f"""WITH cut AS (SELECT doc_id, {WORDS_SQL} AS tk FROM {table}),
    grams AS ({grams}),
    slots AS (SELECT DISTINCT doc_id, {_slot_sql('g')} AS s FROM grams)
    SELECT c.doc_id, (SELECT count(*) FROM slots x WHERE x.doc_id = c.doc_id)::int AS n_ones,
           coalesce((SELECT string_agg(s::varchar, ' ' ORDER BY s) FROM slots x WHERE x.doc_id = c.doc_id), '') AS ones
    FROM cut c JOIN documents d ON d.doc_id = c.doc_id WHERE length(trim(d.text)) > 0"""


def _features(t, kind: str, radius: int = 2, length: int = WIDTH):
    slots = feature_slots(F.col("text"), kind, radius, length, WORDS)
    rows = make_pool(spread(t.documents, "doc_id"), "doc_id", "lang", slots, eager=False)
    return rows.select(F.col("id").alias("doc_id"), F.col("features").alias("s")).select(
        "doc_id",
        F.size("s").alias("n_ones"),
        F.array_join(F.transform("s", lambda v: v.cast("string")), " ").alias("ones"),
    )


PAIRS = " UNION ALL ".join(
    f"SELECT doc_id, tk[i] || ' {g} ' || tk[i + {g}] AS g FROM cut, range(1, len(tk) - {g} + 1) r(i)"
    for g in (1, 2, 3)
)


def _ngrams_sql(sizes) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, array_to_string(tk[i:i + {n - 1}], ' ') AS g FROM cut, range(1, len(tk) - {n} + 2) r(i)"
        for n in sizes
    )


@query("prj1_features_pair", _features_sql(PAIRS))
def prj1_pair(t):
    """Token pairs 1 to 3 apart, whole texts."""
    return _features(t, "pair")


@query("prj1_features_morgan", _features_sql(_ngrams_sql((1, 3, 5))))
def prj1_morgan(t):
    """Centred windows of half-width 0 to 2."""
    return _features(t, "morgan")


@query("prj1_features_rdkit", _features_sql(_ngrams_sql((1, 2, 3))))
def prj1_rdkit(t):
    """Runs of 1 to 3 tokens."""
    return _features(t, "rdkit")


@query(
    "prj1_features_maccs",
    "SELECT doc_id, "
    + " || ".join(
        f"CASE WHEN length(text) - length(replace(text, '{KEY_SYMBOLS[j % len(KEY_SYMBOLS)]}', '')) > {j // len(KEY_SYMBOLS)} THEN '1' ELSE '0' END"
        for j in range(KEY_COUNT)
    )
    + " AS bits FROM documents WHERE length(trim(text)) > 0",
)
def prj1_maccs(t):
    """167 symbol-count keys, as the dense 0/1 row."""
    from activepool.functions.tokens import dense

    slots = feature_slots(F.col("text"), "maccs")
    rows = make_pool(spread(t.documents, "doc_id"), "doc_id", "lang", slots, eager=False)
    bits = F.transform(dense(F.col("features"), KEY_COUNT), lambda b: b.cast("string"))
    return rows.select(F.col("id").alias("doc_id"), F.array_join(bits, "").alias("bits"))


BINS = 2048


@query(
    "prj1_features_map4",
    f"""WITH cut AS (SELECT doc_id, {WORDS_SQL} AS tk FROM documents),
    grams AS (SELECT DISTINCT doc_id, md5(g) AS h FROM ({_ngrams_sql((1, 2, 3))})),
    filled AS (
      SELECT doc_id, ('0x' || substr(h, 1, 8))::bigint % {BINS} AS bin, min(('0x' || substr(h, 9, 8))::bigint) AS v FROM grams GROUP BY 1, 2),
    gaps AS (
      SELECT doc_id, v, bin - coalesce(lag(bin) OVER w, max(bin) OVER (PARTITION BY doc_id) - {BINS}) AS gap
      FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY bin)),
    slots AS (SELECT DISTINCT doc_id, (v + d * {EMPTY_STEP}) % {BINS} AS s FROM (SELECT doc_id, v, unnest(range(0, gap)) AS d FROM gaps)),
    ones AS (SELECT doc_id, count(*) AS n, string_agg(s::varchar, ' ' ORDER BY s) AS s FROM slots GROUP BY 1)
    SELECT d.doc_id, coalesce(o.n, 0)::int AS n_ones, coalesce(o.s, '') AS ones FROM documents d LEFT JOIN ones o ON o.doc_id = d.doc_id
    WHERE length(trim(d.text)) > 0""",
)
def prj1_map4(t):
    """Folded minimum hashes of runs of 1 to 3 tokens, whole texts, 2,048 slots."""
    return _features(t, "map4", length=BINS)


@query(
    "prj2_feature_column",
    f"""WITH names AS (SELECT c_custkey AS id, c_name || c_mktsegment AS text FROM customer),
    cut AS (SELECT id, regexp_extract_all(text, '(.)', 1) AS tk FROM names),
    grams AS ("""
    + " UNION ALL ".join(
        f"SELECT id, tk[i] || ' {g} ' || tk[i + {g}] AS g FROM cut, range(1, len(tk) - {g} + 1) r(i)"
        for g in (1, 2)
    )
    + f"""), slots AS (SELECT DISTINCT id, {_slot_sql('g', 64)} AS s FROM grams)
    SELECT id, count(*)::int AS n_ones, sum(1 << s)::hugeint::varchar AS word FROM (SELECT id, s::hugeint AS s FROM slots) GROUP BY 1""".replace(
        "sum(1 << s)::hugeint::varchar AS word", "string_agg(s::varchar, ' ' ORDER BY s) AS ones"
    ),
)
def prj2(t):
    """One expression for a whole column, with radius and width as options."""
    customers = spread(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    rows = customers.select(F.col("c_custkey").alias("id"), F.concat("c_name", "c_mktsegment").alias("text"))
    slots = feature_slots(F.col("text"), "pair", 1, 64, "(.)")
    return rows.select("id", slots.alias("s")).select(
        "id",
        F.size("s").alias("n_ones"),
        F.array_join(F.transform("s", lambda v: v.cast("string")), " ").alias("ones"),
    )
