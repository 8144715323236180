"""Queries of this subpackage on the given tables, each with its DuckDB SQL where SQL can say it."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfgrade.llm import conversation_repair, knn, langid, lexical, line_dedup, media, mixing, near_dedup, sentencepiece_codec as sp, substring_dedup, suffix_dedup, token_counts, url_filter
from shelfgrade.llm.common import cut, n_words, ready

#: A model file of the public tokenizers; a parameter of the operators.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- 5: MinHash near-dedup ---------------------------------------------------------------------

#: The classes by brute force over pairs that share a shingle; the walk over links is recursive.
_NEAR = """
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS d, doc_id AS t FROM n UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.t),
m AS (SELECT d, min(t) AS m FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, m AS component_id, m = doc_id AS kept FROM n JOIN m ON d = doc_id
"""


@query("op5_near_dedup", _NEAR)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with at least 85 % of their 3-word shingles in common."""
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=85, den=100)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


# --- 6: SentencePiece encoding and decoding ------------------------------------------------------

@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and whether they decode to the same text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", sp.encode_checked(F.col("text"), PIECES).alias("x"))
    return coded.select("doc_id", F.coalesce(F.size("x.ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("x.ids").alias("ids"), F.col("x.round_trip").alias("round_trip"))


# --- 7: mixing sources to target weights ----------------------------------------------------------

@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                        (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


# --- 8: language ID -------------------------------------------------------------------------------

def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out()))
    got = docs.select("doc_id", held_out().alias("held_out"), langid.identify(F.col("text"), model).alias("x"))
    return got.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"), F.col("x.rejected").alias("rejected"))


# --- 9: line dedup ------------------------------------------------------------------------------

_LINES = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS lo FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
x AS (SELECT k.*, coalesce(doc_id <> lo, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM x GROUP BY doc_id
"""


@query("op9_line_dedup", _LINES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line stays in the smallest document that holds it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


# --- 1: URL filters -----------------------------------------------------------------------------

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the longest rule's, else that of the language models."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    v = F.col("url_verdict")
    return url_filter.filter_urls(pages, RULES).select("page_id", v["host"].alias("host"), v["path"].alias("path"), v["rule"].alias("rule"),
                                                       v["verdict"].alias("verdict"), v["score"].alias("score"))


# --- 2: substring dedup --------------------------------------------------------------------------

_REPEATS = """
WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
d AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM d),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS t, count(*) AS k FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@query("op2_substring_dedup", _REPEATS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated 35-word windows."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


# --- 3: media columns -----------------------------------------------------------------------------

@query("op3_media")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a WAV file, read back and fingerprinted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), media.to_wav(F.col("text")).alias("media"))
    read = stored.withColumn("x", media.read_wav(F.col("media")))
    payload = F.col("x.payload")
    return read.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("x.times").cast("string"), F.hex(F.xxhash64("x.times", "x.codes"))).alias("feature"))


# --- 4: exact top-k search --------------------------------------------------------------------------

_TOP = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@query("op4_top_k", _TOP)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    whole = table(spark, sf_dir, "embeddings").select("vec_id", knn.whole_vector(F.col("embedding")).alias("v"))
    return knn.top_k(whole, whole.filter("vec_id % 50 = 0"), 5)


# --- 10: token counts -------------------------------------------------------------------------------

#: A vocabulary file of the public tokenizers; a parameter of the operators.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents in, toxic ones out, low-quality ones revised with single blanks.

    Texts are counted once, into a ledger of numbers; the batches are made from that. The second batch is committed twice,
    as a retried job would; it counts once.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    blanks = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    ledger = cut(docs.select("doc_id", "source", "lang", n_words(F.col("text")).alias("words"),
                             token_counts.bpe_count(F.col("text"), RANKS).alias("pieces"), token_counts.bpe_count(blanks, RANKS).alias("revised")))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counts = lambda rows, pieces: token_counts.counted(rows, {"words-1": F.col("words"), "byte_bpe_50k-1": F.col(pieces)})
    folder = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    token_counts.commit(folder, "1", token_counts.signed(counts(ledger, "pieces"), 1))
    toxic = token_counts.signed(counts(ledger.join(labels.filter("toxic = 1"), "doc_id", "left_semi"), "pieces"), -1)
    token_counts.commit(folder, "2", toxic)
    low = ledger.join(labels.filter("quality = 0 and coalesce(toxic, 0) <> 1"), "doc_id", "left_semi")
    token_counts.commit(folder, "3", token_counts.revised(counts(low, "pieces"), counts(low, "revised")))
    token_counts.commit(folder, "2", toxic)
    return token_counts.totals(spark, folder)


# --- 11: suffix-array dedup --------------------------------------------------------------------------

_BYTES = """
WITH n AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(b[i + 1:i + 100]) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS i FROM n)),
f AS (SELECT h, min((doc_id, i)) AS f FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS pos FROM win JOIN f USING (h) WHERE (doc_id, i) <> f.f),
runs AS (SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g),
segments AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM runs),
kept AS (SELECT doc_id, string_agg(hex(b[p + 1:s]), '' ORDER BY s) AS t, max(e) AS last, count(*) AS spans, sum(e - s) AS k FROM segments JOIN n USING (doc_id) GROUP BY 1)
SELECT n.doc_id, n AS n_bytes, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN k IS NULL THEN b ELSE unhex(t || hex(b[last + 1:n])) END) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""


@query("op11_suffix_dedup", _BYTES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that also start earlier."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# --- 12: ranked lexical search -----------------------------------------------------------------------

_RANKED = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
g AS (SELECT count(*) AS nd, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(qtf * CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term), g GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


@query("op12_lexical_search", _RANKED)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


# --- 13: conversation structure repair -----------------------------------------------------------------

def _repair_sql() -> str:
    """The edits by a fold over each conversation's rows; each state is its cost in nine digits and the edits so far, ``~`` where there is none."""
    def add(x: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {x} = '~' THEN '~' ELSE lpad(CAST(CAST(left({x}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{edit}' END"

    cut_off, own = "(CASE WHEN s IN ('S', 'U', 'A', 'X') THEN 1 ELSE 0 END)", "lower(s)"
    a = [f"acc[{i}]" for i in range(1, 5)]

    def to(role: str, before: list[str]) -> list[str]:
        return [f"CASE WHEN {own} = '{role}' THEN {add(x, cut_off, 'K')} WHEN {'TRUE' if role == 's' else 'FALSE'} THEN '~' ELSE {add(x, '2 + ' + cut_off, 'R')} END" for x in before]

    deleted = [add(x, "3", "D") for x in a]
    insert = f"[{a[0]}, {a[1]}, least({a[2]}, {', '.join(add(a[i], '2', 'I') for i in (0, 1, 3))}), least({a[3]}, {add(a[2], '2', 'I')})]"
    row = (f"[{deleted[0]}, least({deleted[1]}, {to('s', [a[0]])[0]}), least({deleted[2]}, {', '.join(to('u', [a[0], a[1], a[3]]))}), "
           f"least({deleted[3]}, {to('a', [a[2]])[0]})]")
    fold = f"CASE WHEN s = 'I' THEN {insert} WHEN s = 'D' THEN [{', '.join(deleted)}] ELSE {row} END"
    return f"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)]),
  4294967295), 4294967295) % 20 AS code FROM o, k),
x AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE code <> 0),
y AS (SELECT *, row_number() OVER w AS rn, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, lag(role[1]) OVER w AS before,
  trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
z AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM y),
v AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' WHEN role[1] IN ('s', 'u', 'a') THEN CASE fault WHEN 'truncated' THEN upper(role[1]) ELSE role[1] END
  WHEN fault = 'truncated' THEN 'X' ELSE 'x' END AS symbol FROM z),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
  string_agg('III' || symbol, '' ORDER BY rn) || 'III' AS symbols FROM v GROUP BY 1),
e AS (SELECT *, list_reduce(string_split(symbols, ''), lambda acc, s: {fold}, ['000000000', '~', '~', '~']) AS ends FROM c),
b AS (SELECT * EXCLUDE (symbols, ends), CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM (SELECT *, least(ends[1], ends[4]) AS best FROM e)),
p AS (SELECT conv_id, edit, pos, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS rn, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS place
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM b WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
j AS (SELECT p.*, v.role, CASE WHEN edit = 'I' THEN '' ELSE v.text END AS text, max(CASE WHEN place = 1 AND edit = 'K' AND v.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS lead
  FROM p LEFT JOIN v ON v.conv_id = p.conv_id AND v.rn = p.rn AND edit <> 'I'),
m AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS repaired FROM j WHERE edit <> 'D' GROUP BY 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b USING (conv_id) LEFT JOIN m USING (conv_id)
"""


@query("op13_conversation_repair", _repair_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return conversation_repair.repair_summary(table(spark, sf_dir, "conversations"), damage=True)
