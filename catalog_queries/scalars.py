"""Scalar-function queries: text, URL, number, date and JSON columns."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.functions import lists as L
from shelfgrade.functions import text as T
from shelfgrade.functions import urls as U
from shelfgrade.plans.scoring import interpret, position_weight

from . import sqlx as X
from .base import BRIDGE_SQL, PRODUCTS_SQL, bridge, products, query

P = f"WITH {PRODUCTS_SQL} "


def _doc(name: str, expr, sql: str):
    @query(name, f"SELECT doc_id, md5({sql}) AS digest FROM documents")
    def run(t):
        return t.documents.select("doc_id", F.md5(expr("text")).alias("digest"))


_doc("fold_text", T.fold, X.fold("text"))
_doc("norm_entry_text", T.norm_entry, f"trim(lower({X.collapse('strip_accents(text)')}), ' .,;:*')")
_doc("norm_label_text", T.norm_label, X.rep(f"lower({X.collapse('strip_accents(text)')})", r"^[^\w]+"))
_doc("norm_ws_text", T.norm_ws, f"lower({X.collapse('text')})")
_doc("alnum_key_text", T.alnum_key, X.rep("lower(strip_accents(text))", "[^a-z0-9]+"))
_doc("slugify_text", T.slugify, "trim(" + X.rep("lower(strip_accents(text))", "[^a-z0-9]+", "-") + ", '-')")
_doc("clean_doc_text", T.clean_doc_text, X.trim(X.rep(X.rep(X.rep("text", r"\r\n?", "\n"), r"\n{3,}", "\n\n"), r"[ \t]+", " ")))
_doc("query_hash_text", T.query_hash, f"sha256({X.trim('lower(text)')})")


@query("norm_name", P + """SELECT product_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(brand_slug || ' ' || product_name || ' - un')),
 '\\b\\d+[.,]?\\d*\\s*(ml|g|kg|l|oz|lt)\\b', '', 'g'), '\\s*[-/]\\s*(un|und|unid)\\b', '', 'g'), '\\s+', ' ', 'g')) AS plain,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(brand_slug || ' ' || product_name || ' - un')),
 '\\b\\d+[.,]?\\d*\\s*(ml|g|kg|l|oz|lt)\\b', '', 'g'), '\\s*[-/]\\s*(un|und|unid)\\b', '', 'g'), '\\bbrand[-\\s]*' || split_part(brand_slug, '-', 2) || '\\b', '', 'g'), '\\s+', ' ', 'g')) AS bare FROM products""")
def norm_name(t):
    full = F.concat("brand_slug", F.lit(" "), "product_name", F.lit(" - un"))
    return products(t).select("product_id", T.norm_name(full).alias("plain"), T.norm_name(full, "brand_slug").alias("bare"))


@query("norm_ean", P + "SELECT product_id, regexp_replace(coalesce(ean,''), '[^0-9]', '', 'g') AS ean FROM products")
def norm_ean(t):
    return products(t).select("product_id", T.norm_ean("ean").alias("ean"))


@query("volume_units", P + """SELECT product_id, coalesce(CAST(nullif(regexp_extract(lower(product_name), '(\\d+(?:[.,]\\d+)?)\\s*(ml|lt|l|kg|g|oz)\\b', 1), '') AS DOUBLE), -1.0) AS volume FROM products""")
def volume_units(t):
    return products(t).select("product_id", F.coalesce(T.volume_units("product_name"), F.lit(-1.0)).alias("volume"))


@query("volume_units_scaled", """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) * CASE o_orderstatus WHEN 'O' THEN 1000 WHEN 'P' THEN 30 ELSE 1 END AS volume FROM orders""")
def volume_units_scaled(t):
    unit = F.when(F.col("o_orderstatus") == "O", " L").when(F.col("o_orderstatus") == "P", "oz").otherwise(" g")
    return t.orders.select("o_orderkey", T.volume_units(F.concat(F.lit("Gel "), F.col("o_custkey").cast("string"), unit)).alias("volume"))


@query("extract_volume", P + """SELECT product_id, coalesce(nullif(trim(regexp_extract(product_name, '(?i)(\\d+(?:[.,]\\d+)?\\s*(?:ml|g|kg|lt|l|oz))\\b', 1)), ''), product_id || 'g') AS volume FROM products""")
def extract_volume(t):
    alt = F.concat(F.lit("x "), F.col("product_id").cast("string"), F.lit("g y"))
    return products(t).select("product_id", T.extract_volume("product_name", alt).alias("volume"))


_ENT = "html"
for _e, _r in X.ENTITIES:
    _ENT = "replace({}, '{}', '{}')".format(_ENT, _e, _r.replace("'", "''"))


@query("clean_html_text", f"SELECT page_id, md5({X.collapse(X.rep(_ENT, '<[^>]+>', ' '))}) AS digest FROM pages")
def clean_html_text(t):
    return t.pages.select("page_id", F.md5(T.clean_text("html")).alias("digest"))


@query("canonical_url", """WITH p AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages), q AS (SELECT page_id, split_part(u, '?', 1) AS base, split_part(u, '?', 2) AS qs FROM p),
k AS (SELECT page_id, base, list_filter(string_split(qs, '&'), lambda kv: regexp_matches(kv, '^[^=]*=.+') AND split_part(kv, '=', 1) NOT IN
 ('gad_source','gad_campaignid','gbraid','gclid','fbclid','utm_source','utm_medium','utm_campaign','utm_term','utm_content','_ga','_gl','yclid','msclkid','mc_cid','mc_eid','prefn1','prefv1','prefn2','prefv2','prefn3','prefv3','start','sz','insertMode','page','p','sort')) AS kept FROM q)
SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k""")
def canonical_url(t):
    return t.pages.select("page_id", U.canonical_url("url").alias("canonical"))


@query("host_allowed", """WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, host, host = 'example.com' OR host LIKE '%.example.com' OR host = 'therin.example.net' OR host LIKE '%.therin.example.net' AS allowed FROM h""")
def host_allowed(t):
    return t.pages.select("page_id", U.url_host("url").alias("host"), U.host_allowed("url", ["example.com", "therin.example.net"]).alias("allowed"))


@query("url_origin", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, true AS is_url FROM pages")
def url_origin(t):
    return t.pages.select("page_id", U.url_origin("url").alias("origin"), U.has_url("url").alias("is_url"))


@query("parse_brl", "SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) + 0.25 AS price FROM orders")
def parse_brl(t):
    whole = F.regexp_replace(F.format_number(F.floor("o_totalprice"), 0), ",", ".")
    return t.orders.select("o_orderkey", T.parse_brl(F.concat(F.lit("por R$ "), whole, F.lit(",25 à vista"))).alias("price"))


@query("loose_price", "SELECT p_partkey, p_retailprice AS price FROM part")
def loose_price(t):
    text = F.concat(F.lit("BRL "), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")), F.lit(" un"))
    return t.part.select("p_partkey", T.loose_price(text).alias("price"))


@query("split_bullets")
def split_bullets(t):
    return t.documents.select("doc_id", F.posexplode(L.split_bullets("text")).alias("n", "bullet"))


@query("cut_markers", f"SELECT doc_id, md5({X.cut('text', ['ation', 'ungen', 'mento', '| '], ['the', 'ment', 'ion'])}) AS digest FROM documents")
def cut_markers(t):
    rules = L.ListRules(cut_markers=["ation", "ungen", "mento", "| "], garbage=["the", "ment", "ion"])
    return t.documents.select("doc_id", F.md5(L.cut_markers("text", rules)).alias("digest"))


@query("cut_markers_market", f"SELECT doc_id, md5({X.cut('text', L.CUT_MARKERS, [g for g in L.GARBAGE_PHRASES])}) AS digest FROM documents")
def cut_markers_market(t):
    return t.documents.select("doc_id", F.md5(L.cut_markers("text")).alias("digest"))


@query("strip_translations", "SELECT o_orderkey, 'Aqua' || CASE WHEN o_orderpriority LIKE '% %' THEN '' ELSE ' (' || o_orderpriority || ')' END || ', Dye (CI 77891 red)' AS name FROM orders")
def strip_translations(t):
    raw = F.concat(F.lit("Aqua ("), "o_orderpriority", F.lit("), Dye (CI 77891 red)"))
    return t.orders.select("o_orderkey", L.strip_translations(raw).alias("name"))


@query("split_list", f"""WITH s AS (SELECT doc_id, {X.neat_parts('text')} AS parts FROM documents)
SELECT doc_id, CAST(len(k) AS INT) AS items, md5(array_to_string(k, '|')) AS digest FROM (SELECT doc_id, list_filter(parts, lambda x, i: list_position(low, lower(x)) = i) AS k FROM (SELECT *, list_transform(parts, lambda y: lower(y)) AS low FROM s))""")
def split_list(t):
    d = t.documents.select("doc_id", L.split_list("text").alias("k"))
    return d.select("doc_id", F.size("k").alias("items"), F.md5(F.array_join("k", "|")).alias("digest"))


@query("position_weights", f"""WITH {BRIDGE_SQL}, n AS (SELECT product_id, count(*) AS n FROM bridge GROUP BY 1)
SELECT product_id, position, ingredient_id, tie, round(greatest(0.2::DOUBLE, 1.0::DOUBLE - (position - 1) * 0.8::DOUBLE / greatest(n, 1)), 6) AS weight FROM bridge JOIN n USING (product_id)""")
def position_weights(t):
    n = bridge(t).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return bridge(t).join(n, "product_id").select(
        "product_id", "position", "ingredient_id", "tie", F.round(position_weight(F.col("position") - 1, F.col("n")), 6).alias("weight"))


@query("interpret_scores", """SELECT event_id, CASE WHEN value / 50 - 1 >= 0.6 THEN 'Altamente compatível com o perfil' WHEN value / 50 - 1 >= 0.2 THEN 'Compatível com algumas reservas'
 WHEN value / 50 - 1 >= -0.2 THEN 'Neutro — sem grandes benefícios ou alertas' WHEN value / 50 - 1 >= -0.6 THEN 'Cuidado — possíveis incompatibilidades' ELSE 'Não recomendado para este perfil' END AS verdict FROM events""")
def interpret_scores(t):
    return t.events.select("event_id", interpret(F.col("value") / 50 - 1).alias("verdict"))


@query("parse_iso", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def parse_iso(t):
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.events.select("event_id", F.date_format(T.parse_iso(iso), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("is_domain_name", "WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) SELECT page_id, regexp_full_match(host, '(www\\.)?[a-z0-9-]+\\.[a-z]{2,}(\\.[a-z]{2,})?') AS domain FROM h")
def is_domain_name(t):
    return t.pages.select("page_id", T.is_domain_name(U.url_host("url")).alias("domain"))


@query("json_from_text", "SELECT event_id, props AS found FROM events")
def json_from_text(t):
    return t.events.select("event_id", T.json_from_text(F.concat(F.lit("answer:\n```json\n"), "props", F.lit("\n``` done"))).alias("found"))


@query("decode_json_list", """SELECT event_id, CASE WHEN event_type = 'click' THEN '' WHEN event_type = 'view' THEN '' ELSE event_type || '|' || user_id END AS items FROM events""")
def decode_json_list(t):
    raw = F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "view", F.lit("[broken")).otherwise(
        F.concat(F.lit('["'), "event_type", F.lit('","'), F.col("user_id").cast("string"), F.lit('"]')))
    return t.events.select("event_id", F.array_join(T.decode_json_list(raw), "|").alias("items"))


@query("serialize_value", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS plain, '["' || p_type || '","' || p_name || '"]' AS nested FROM part""")
def serialize_value(t):
    return t.part.select("p_partkey", T.serialize_value("p_size").alias("plain"), T.serialize_value(F.array("p_type", "p_name"), True).alias("nested"))


@query("is_empty_value", P + "SELECT product_id, size_volume IS NULL AS no_volume, price IS NULL AS no_price FROM products")
def is_empty_value(t):
    return products(t).select("product_id", T.is_empty_value("size_volume").alias("no_volume"), T.is_empty_value("price").alias("no_price"))


@query("title_case_claim", "SELECT p_partkey, upper(split_part(p_name, ' ', 1)[1]) || substring(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substring(split_part(p_name, ' ', 2), 2) AS title FROM part")
def title_case_claim(t):
    return t.part.select("p_partkey", T.title_case_claim(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title"))
