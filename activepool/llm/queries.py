"""One query for each operator, with production parameters over whole tables, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from activepool.llm import (
    bpe,
    chat,
    decontaminate,
    fim,
    fingerprint,
    langid,
    line_dedup,
    lm,
    near_dedup,
    periodic,
    quality,
    sentence_pieces,
    url_filter,
)
from activepool.llm.common import bucket

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_minhash_near_dedup")
def op1(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"), size=2, percent=80)


DECONTAMINATION = """
WITH RECURSIVE letters AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id::varchar AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM letters, sizes WHERE len(w) >= n)),
hits AS (SELECT p.r, p.i, p.n, x.item FROM places p JOIN windows x ON x.n = p.n AND x.k = p.k),
words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS place FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT l.doc_id, len(l.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM letters l LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""


@query("op2_benchmark_decontamination", DECONTAMINATION)
def op2(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


def _url_sql() -> str:
    """Rules and template trees as SQL, with the numbers of the query written out."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = [("allow", "www.example.com", "/en/"), ("block", "example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "com", "/")]
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in rules) + " END"
    end = "(\\.[A-Za-z]{1,5})?\\z"
    varies = f"regexp_matches(s, '^[0-9]+{end}') OR regexp_matches(s, '^[0-9a-fA-F-]{{16,}}{end}') OR regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?\\z')"
    levels = ""
    for k in range(4):
        levels += f"""
n{k} AS (SELECT host, branch, count(DISTINCT named[{k + 1}]) AS names FROM t{k} WHERE len(named) > {k + 1} GROUP BY ALL),
t{k + 1} AS (
  SELECT t.host, named, n, labelled, blocked, leaf,
         CASE WHEN len(named) > {k + 1} THEN t.branch || '/' || CASE WHEN names > 64 THEN '*' ELSE named[{k + 1}] END ELSE t.branch END AS branch
  FROM t{k} t LEFT JOIN n{k} USING (host, branch)),"""
    merges = ""
    for k in range(5, 0, -1):
        merges += f"""
d{k} AS (
  SELECT host, array_to_string(segs[1 : {k - 1}], '/') AS parent, segs[{k}] AS name, array_to_string(segs[{k + 1} : 5], '/') || '/' || leaf AS ending,
         sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM m{k + 1} WHERE len(segs) >= {k} GROUP BY ALL),
b{k} AS (
  SELECT host, parent, name, sum(n) AS b_n, sum(labelled) AS b_labelled, sum(blocked) AS b_blocked, arg_max(ending, (n, ending)) AS commonest
  FROM d{k} GROUP BY ALL),
c{k} AS (SELECT * FROM d{k} JOIN b{k} USING (host, parent, name)),
p{k} AS (SELECT host, parent, commonest, ending, sum(n) AS p_n FROM c{k} GROUP BY ALL),
s{k} AS (
  SELECT host, parent, commonest, sum(n) AS t_n, sum(labelled) AS t_labelled, sum(blocked) AS t_blocked, count(DISTINCT ending) AS endings
  FROM c{k} GROUP BY ALL),
f{k} AS (
  SELECT host, parent, name, commonest, round(1 - sum(least(n / b_n::double, p_n / t_n::double)), 9) AS variation, max(b_n) AS b_n,
         max(b_labelled) AS b_labelled, max(b_blocked) AS b_blocked, max(t_blocked) / greatest(max(t_labelled), 1)::double AS share, max(endings) AS endings
  FROM c{k} JOIN p{k} USING (host, parent, commonest, ending) JOIN s{k} USING (host, parent, commonest) GROUP BY host, parent, name, commonest),
a{k} AS (
  SELECT *, min(name) OVER (PARTITION BY host, parent, commonest) AS first FROM f{k}
  WHERE variation <= round(0.2 + sqrt(endings / b_n::double) / 2, 9)
    AND (b_labelled = 0 OR round(abs(b_blocked / greatest(b_labelled, 1)::double - share), 9)
      <= round(0.1 + 2 * sqrt(share * (1 - share) / greatest(b_labelled, 1)::double), 9))),
m{k} AS (
  SELECT t.host, named, n, labelled, blocked, leaf,
         CASE WHEN first IS NOT NULL THEN segs[1 : {k - 1}] || [first] || segs[{k + 1} :] ELSE segs END AS segs
  FROM (SELECT *, CASE WHEN len(segs) >= {k} THEN array_to_string(segs[1 : {k - 1}], '/') END AS parent FROM m{k + 1}) t
  LEFT JOIN (SELECT host, parent, name, first FROM a{k}) r ON r.host = t.host AND r.parent = t.parent AND r.name = t.segs[{k}]),"""
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT *, {pick(lambda v, h, p: h + p)} AS rule, {pick(lambda v, h, p: v)} AS ruled FROM split),
pages2 AS (
  SELECT *, CASE ruled WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS vote,
         list_transform(regexp_split_to_array(regexp_replace(path, '^/+', ''), '/+'),
           lambda s: CASE WHEN {varies} THEN '*' || regexp_extract(s, '{end}', 1) ELSE s END) AS named
  FROM ruled),
t0 AS (
  SELECT host, named, count(*) AS n, count(vote) AS labelled, coalesce(sum(vote), 0)::bigint AS blocked, '' AS branch,
         coalesce(named[len(named)], '') AS leaf FROM pages2 GROUP BY host, named),{levels}
t5 AS (SELECT host, named, n, labelled, blocked, leaf, CASE WHEN len(named) > 5 THEN branch || '/**' ELSE branch END AS branch FROM t4),
many AS (SELECT host, branch, count(DISTINCT leaf) AS leaves FROM t5 GROUP BY ALL),
m6 AS (
  SELECT host, named, n, labelled, blocked, CASE WHEN leaves > 64 THEN '*' ELSE leaf END AS leaf,
         CASE WHEN branch = '' THEN []::varchar[] ELSE string_split(substr(branch, 2), '/') END AS segs FROM t5 JOIN many USING (host, branch)),{merges}
placed AS (SELECT host, named, n, labelled, blocked, leaf, array_to_string(list_transform(segs, lambda x: '/' || x), '') AS merged FROM m1),
templates AS (SELECT host, merged, leaf, sum(labelled) AS labelled, sum(blocked) AS blocked FROM placed GROUP BY ALL),
branches AS (SELECT host, merged, sum(labelled) AS bl, sum(blocked) AS bb FROM templates GROUP BY ALL),
hosts AS (SELECT host, sum(bl) AS hl, sum(bb) AS hb FROM branches GROUP BY ALL),
total AS (SELECT coalesce(sum(hb) / greatest(sum(hl), 1)::double, 0) AS t FROM hosts),
judged AS (
  SELECT host, merged, leaf, labelled, (blocked + 5 * ((bb + 5 * ((hb + 5 * t) / (hl + 5))) / (bl + 5))) / (labelled + 5) AS share
  FROM templates JOIN branches USING (host, merged) JOIN hosts USING (host) CROSS JOIN total)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN judged.labelled >= 10 AND share >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict
FROM pages2 LEFT JOIN placed USING (host, named) LEFT JOIN judged USING (host, merged, leaf)"""


@query("op3_url_filters", _url_sql())
def op3(spark, folder):
    return url_filter.judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op4_bpe_encoding_and_decoding")
def op4(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), tokenizer_path())


def _learns_quality(doc_id):
    return bucket(doc_id, 4) != 2


@query("op5_quality_classifier")
def op5(spark, folder):
    scores = quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), learn=_learns_quality)
    return scores.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op6_lm_scoring")
def op6(spark, folder):
    return lm.lm_scores(table(spark, folder, "documents"), bucket(F.col("doc_id"), 10) == 0)


@query("op7_language_id")
def op7(spark, folder):
    return langid.identify_held_out(table(spark, folder, "documents"), lambda doc_id: bucket(doc_id, 5) != 0)


@query("op8_document_fingerprints")
def op8(spark, folder):
    return fingerprint.compare_edited(table(spark, folder, "documents"))


CHAT = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\\\#<:]', '', 'g')) + length(text)
    + length(regexp_replace(text, '[^\\\\#<]', '', 'g')) + length('### : </turn>') + 1 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::bigint AS formatted_chars
FROM sized GROUP BY conv_id"""


@query("op9_chat_formatting", CHAT)
def op9(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_conversations(chat.chain(rows.union(more))))


LINES = """
WITH docs AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
rows AS (SELECT DISTINCT doc_id, text, lines FROM docs WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, text, unnest(generate_series(0, len(lines) - 1)) AS pos, unnest(lines) AS line FROM rows),
filled AS (
  SELECT doc_id, text, pos, regexp_replace(line, '\\s+$|^\\s+', '', 'g') AS line FROM numbered
  WHERE regexp_replace(line, '\\s+$|^\\s+', '', 'g') <> ''),
windows AS (
  SELECT * FROM (
    SELECT doc_id, text, pos AS head, lead(pos, 2) OVER w AS tail, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
    FROM filled WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)) WHERE tail IS NOT NULL
  UNION ALL SELECT doc_id, text, min(pos), max(pos), arg_min(line, pos), CASE WHEN count(*) = 2 THEN arg_max(line, pos) END, NULL
  FROM filled GROUP BY doc_id, text HAVING count(*) < 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, head) AS k FROM windows),
covered AS (SELECT DISTINCT doc_id, text, unnest(generate_series(head, tail)) AS pos FROM ranked WHERE k > 1),
touched AS (SELECT DISTINCT doc_id, text FROM covered),
stay AS (
  SELECT t.doc_id, t.text, count(n.pos) AS n, string_agg(n.line, chr(10) ORDER BY n.pos) AS cleaned
  FROM touched t LEFT JOIN (SELECT * FROM numbered ANTI JOIN covered USING (doc_id, text, pos)) n USING (doc_id, text)
  GROUP BY t.doc_id, t.text)
SELECT d.doc_id, (CASE WHEN s.n IS NULL THEN 0 ELSE len(d.lines) - s.n END)::bigint AS n_removed,
       sha256(CASE WHEN s.n IS NULL THEN d.text ELSE coalesce(s.cleaned, '') END) AS text_sha256
FROM docs d LEFT JOIN stay s ON s.doc_id = d.doc_id AND s.text = d.text"""


@query("op10_line_dedup", LINES)
def op10(spark, folder):
    cleaned = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_removed", F.sha2("text", 256).alias("text_sha256"))


MIDDLES = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
cuts AS (
  SELECT *, least(('0x' || substr(h, 1, 8))::ubigint % (len(w) + 1), ('0x' || substr(h, 9, 8))::ubigint % (len(w) + 1))::bigint AS i,
         greatest(('0x' || substr(h, 1, 8))::ubigint % (len(w) + 1), ('0x' || substr(h, 9, 8))::ubigint % (len(w) + 1))::bigint AS j,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || substr(h, 17, 8))::ubigint % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::ubigint % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
parts AS (
  SELECT *, array_to_string(w[1 : i], '') AS p, array_to_string(w[i + 1 : j], '') AS m, array_to_string(w[j + 1 :], '') AS s FROM cuts)
SELECT doc_id, len(w)::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::bigint AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::bigint AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts"""


@query("op11_fill_in_middle", MIDDLES)
def op11(spark, folder):
    cut = fim.restore(fim.fill_in_middle(table(spark, folder, "documents")))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def _with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the contract's periods: of a tenth of the ids, the words from one on repeat."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = docs.select("doc_id", "text", h.alias("h"), words.alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    a = g % n
    again = "array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')"
    rows = rows.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.expr(again)).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_run_detection")
def op12(spark, folder):
    found = periodic.periodic_runs(_with_periods(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", longest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_sentencepiece_encoding_and_decoding")
def op13(spark, folder):
    return sentence_pieces.digests(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))
