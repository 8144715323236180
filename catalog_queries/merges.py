"""Merge, change-capture and set queries over snapshots derived from the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.functions import lists as L
from shelfgrade.operators import classify as C
from shelfgrade.operators import merges as J
from shelfgrade.operators import reports as R

from . import sqlx as X
from .base import BRIDGE_SQL, DESCRIBED_SQL, PRODUCTS_SQL, bridge, products, query
from .gates import FIELDS, PHRASES, RULES, USAGE, checked_sql, phrase_lists, usage_text, _REAL

P = f"WITH {PRODUCTS_SQL} "
N = "CAST(count(*) AS BIGINT)"

# --- snapshots: documents as the old one, orders-like changes as the new one ----------------

_OLD = """old AS (SELECT 'u' || doc_id AS product_url, doc_id AS product_id, left(text, 20) AS product_name, CASE WHEN lang = 'es' THEN 'Como usar' ELSE text END AS description,
 CASE WHEN lang = 'en' THEN source END AS items, CASE WHEN n_chars > 900 THEN 'verified_inci' ELSE 'catalog_only' END AS verification_status, n_chars * 1.0::DOUBLE AS price FROM documents)"""
_NEW = """new AS (SELECT 'u' || p_partkey * 2 AS product_url, 900000 + p_partkey AS product_id, CASE WHEN p_size > 10 THEN p_name ELSE '' END AS product_name, CASE WHEN p_size > 30 THEN p_name || ' ' || p_type WHEN p_size > 20 THEN 'detalhes' ELSE '' END AS description,
 CASE WHEN p_type = 'PROMO' THEN p_brand END AS items, 'quarantined' AS verification_status, CASE WHEN p_size > 25 THEN p_retailprice END AS price FROM part)"""


def snapshots(t):
    old = t.documents.select(
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("product_url"), F.col("doc_id").alias("product_id"), F.left("text", F.lit(20)).alias("product_name"),
        F.when(F.col("lang") == "es", "Como usar").otherwise(F.col("text")).alias("description"), F.when(F.col("lang") == "en", F.array("source")).alias("inci_ingredients"),
        F.when(F.col("n_chars") > 900, "verified_inci").otherwise("catalog_only").alias("verification_status"), (F.col("n_chars") * 1.0).cast("double").alias("price"))
    new = t.part.select(
        F.concat(F.lit("u"), (F.col("p_partkey") * 2).cast("string")).alias("product_url"), (F.col("p_partkey") + 900000).alias("product_id"),
        F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("product_name"),
        F.when(F.col("p_size") > 30, F.concat_ws(" ", "p_name", "p_type")).when(F.col("p_size") > 20, "detalhes").otherwise("").alias("description"),
        F.when(F.col("p_type") == "PROMO", F.array("p_brand")).alias("inci_ingredients"), F.lit("quarantined").alias("verification_status"),
        F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("price"))
    return old, new


_MERGED = f"""{_OLD}, {_NEW}, j AS (SELECT coalesce(o.product_url, n.product_url) AS product_url, o.product_url IS NULL AS born, n.product_url IS NULL AS gone, o.items IS NOT NULL AND o.verification_status = 'verified_inci' AND n.items IS NULL AS keep,
 o.product_id AS oi, n.product_id AS ni, o.product_name AS onm, n.product_name AS nnm, o.description AS od, n.description AS nd, o.items AS oit, n.items AS nit, o.verification_status AS os, n.verification_status AS ns, o.price AS op, n.price AS np FROM old o FULL JOIN new n ON o.product_url = n.product_url),
mrg AS (SELECT product_url, coalesce(oi, ni) AS product_id, CASE WHEN gone THEN onm WHEN born THEN nnm WHEN nnm <> '' THEN nnm ELSE onm END AS product_name,
 CASE WHEN gone THEN od WHEN born THEN nd WHEN {X.trim('lower(od)')} IN ('como usar','detalhes') THEN nd WHEN nd = '' OR nd = 'detalhes' OR length(nd) < 10 THEN od ELSE nd END AS description,
 CASE WHEN gone OR keep THEN oit ELSE nit END AS items, CASE WHEN gone OR (keep AND NOT born) THEN os ELSE ns END AS verification_status, CASE WHEN gone THEN op WHEN born THEN np ELSE coalesce(np, op) END AS price FROM j)"""


def merged(t):
    old, new = snapshots(t)
    return J.merge_never_downgrade(old, new, lists=["inci_ingredients", "verification_status"])


@query("merged_snapshot", f"WITH {_MERGED} SELECT product_url, product_id, product_name, description, coalesce(items, '-') AS items, verification_status, coalesce(price, -1) AS price FROM mrg")
def merged_snapshot(t):
    return merged(t).select("product_url", "product_id", "product_name", "description", F.coalesce(F.array_join("inci_ingredients", ","), F.lit("-")).alias("items"),
                            "verification_status", F.coalesce("price", F.lit(-1.0)).alias("price"))


@query("snapshot_revisions", f"""WITH {_MERGED}, x AS (SELECT old.product_url AS entity_id, unnest([{{'f':'product_name','a':old.product_name,'b':mrg.product_name}}, {{'f':'description','a':old.description,'b':mrg.description}}, {{'f':'verification_status','a':old.verification_status,'b':mrg.verification_status}}]) AS e FROM old JOIN mrg USING (product_url))
SELECT entity_id, e.f AS field_name, e.a AS old_value, e.b AS new_value FROM x WHERE e.a IS DISTINCT FROM e.b""")
def snapshot_revisions(t):
    old, _new = snapshots(t)
    d = J.diff_revisions(old, merged(t), "product_url", ["product_name", "description", "verification_status"])
    return d.select("entity_id", "field_name", "old_value", "new_value")


@query("quarantine_upsert", """WITH old AS (SELECT doc_id AS product_id, 'r' || quality AS reason, 'c' || toxic AS code FROM labels), new AS (SELECT doc_id AS product_id, 'no_image; short' AS reason, 'no_image' AS code FROM documents WHERE n_chars < 400)
SELECT coalesce(o.product_id, n.product_id) AS product_id, coalesce(n.reason, o.reason) AS rejection_reason, coalesce(o.code, n.code) AS rejection_code FROM old o FULL JOIN new n USING (product_id)""")
def quarantine_upsert(t):
    old = t.labels.selectExpr("doc_id AS product_id", "'r' || CAST(quality AS STRING) AS rejection_reason", "'c' || CAST(toxic AS STRING) AS rejection_code", "'pending' AS review_status")
    gate = F.struct(F.when(F.col("n_chars") < 400, "quarantined").otherwise("ok").alias("status"), F.lit("no_image; short").alias("reason"), F.array(F.lit("no_image"), F.lit("short")).alias("failed"))
    gated = t.documents.select(F.col("doc_id").alias("product_id"), gate.alias("gate"))
    return J.upsert_quarantine(old, gated).select("product_id", "rejection_reason", "rejection_code")


@query("external_upsert", """WITH o AS (SELECT p_type AS source, p_name AS source_url, min(p_brand) AS v FROM part WHERE p_size < 20 GROUP BY 1, 2), n AS (SELECT p_type AS source, p_name AS source_url, max(p_brand) AS v FROM part WHERE p_size > 40 GROUP BY 1, 2)
SELECT coalesce(o.source, n.source) AS source, coalesce(o.source_url, n.source_url) AS source_url, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.source = n.source AND o.source_url = n.source_url""")
def external_upsert(t):
    k = [F.col("p_type").alias("source"), F.col("p_name").alias("source_url")]
    o = t.part.filter("p_size < 20").groupBy(*k).agg(F.min("p_brand").alias("v"))
    n = t.part.filter("p_size > 40").groupBy(*k).agg(F.max("p_brand").alias("v"))
    return J.upsert(o, n, ["source", "source_url"])


@query("insert_if_absent", "SELECT p_partkey AS k, 'old' AS origin FROM part WHERE p_size < 30 UNION ALL SELECT DISTINCT l_partkey, 'new' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 30)")
def insert_if_absent(t):
    target = t.part.filter("p_size < 30").selectExpr("p_partkey AS k", "'old' AS origin")
    return J.insert_if_absent(target, t.lineitem.selectExpr("l_partkey AS k", "'new' AS origin"), ["k"])


@query("imported_products", """WITH t AS (SELECT doc_id AS id, 'u' || doc_id AS url, CASE WHEN lang = 'en' THEN 'verified_inci' ELSE 'catalog_only' END AS verification_status, 'old' AS v FROM documents),
b AS (SELECT CASE WHEN p_size < 25 THEN p_partkey ELSE 500000 + p_partkey END AS id, 'u' || (CASE WHEN p_size < 40 THEN p_partkey ELSE 700000 + p_partkey END) AS url, p_name AS v FROM part)
SELECT coalesce(t.id, b.id) AS id, CASE WHEN b.id IS NULL OR coalesce(t.verification_status = 'verified_inci', false) THEN t.v ELSE b.v END AS v FROM t FULL JOIN b ON (t.id = b.id OR t.url = b.url)""")
def imported_products(t):
    target = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("lang") == "en", "verified_inci").otherwise("catalog_only").alias("verification_status"), F.lit("old").alias("v"))
    k, z = F.col("p_partkey"), F.col("p_size")
    batch = t.part.select(F.when(z < 25, k).otherwise(k + 500000).alias("id"), F.concat(F.lit("u"), F.when(z < 40, k).otherwise(k + 700000).cast("string")).alias("url"), F.lit("catalog_only").alias("verification_status"), F.col("p_name").alias("v"))
    return J.import_products(target, batch, "id", "url").select("id", "v")


@query("patched_rows", P + ", u AS (SELECT doc_id AS product_id, source AS brand_slug, CASE WHEN lang = 'fr' THEN lang END AS product_category FROM documents) SELECT product_id, products.brand_slug, coalesce(u.product_category, products.product_category, '-') AS product_category FROM products LEFT JOIN u USING (product_id)")
def patched_rows(t):
    u = t.documents.select(F.col("doc_id").alias("product_id"), F.col("source").alias("brand_slug"), F.when(F.col("lang") == "fr", F.col("lang")).alias("product_category"))
    d = J.patch_rows(products(t), u, "product_id", ["product_category", "price"])
    return d.select("product_id", "brand_slug", F.coalesce("product_category", F.lit("-")).alias("product_category"))


@query("union_discovery", """WITH a AS (SELECT split_part(url, '?', 1) AS u, 0 AS r FROM pages UNION ALL SELECT 'https://therin.example.net/en/' || p_size, 1 FROM part), k AS (SELECT u, min(r) AS r FROM a GROUP BY 1) SELECT u AS url, CAST(r AS INT) AS source_rank FROM k WHERE NOT contains(lower(u), 'blog') AND NOT contains(lower(u), 'spam')""")
def union_discovery(t):
    a = t.pages.select(F.substring_index("url", "?", 1).alias("url"), F.lit(0).alias("source_rank"))
    b = t.part.select(F.concat(F.lit("https://therin.example.net/en/"), F.col("p_size").cast("string")).alias("url"), F.lit(1).alias("source_rank"))
    return J.union_discovery(a.unionByName(b), "url", "source_rank", ["BLOG", "spam"]).select("url", "source_rank")


_TOKENS = "list_distinct(list_filter(list_transform(flatten(list_transform({}, lambda x: string_split_regex(x, '[/(),•·●;]'))), lambda p: regexp_replace(lower(p), '[^a-z0-9]+', '', 'g')), lambda k: length(k) >= 3))"


@query("token_overlaps", f"""WITH d AS (SELECT doc_id, {_TOKENS.format("string_split(text, ' ')")} AS a, {_TOKENS.format("string_split(replace(text, 'tion', ''), ' ')")} AS b FROM documents),
s AS (SELECT doc_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS c FROM d) SELECT doc_id, coalesce((c / nullif(nb, 0) >= 0.9 AND na >= nb) OR (c / nullif(nb, 0) >= 0.7 AND c / nullif(na, 0) >= 0.7), false) AS accepted FROM s""")
def token_overlaps(t):
    a = F.split("text", " ")
    b = F.split(F.replace("text", F.lit("tion"), F.lit("")), " ")
    return t.documents.select("doc_id", J.token_overlap(a, b)["accept"].alias("accepted"))


@query("merged_lists", """SELECT doc_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ' ') AS merged FROM (SELECT doc_id, string_split(text, ' ') AS a, string_split('the zzz of ' || lang, ' ') AS b FROM documents)""")
def merged_lists(t):
    m = L.merge_lists(F.split("text", " "), F.split(F.concat(F.lit("the zzz of "), "lang"), " "))
    return t.documents.select("doc_id", F.array_join(m, " ").alias("merged"))


@query("merged_objects", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'c' || user_id ELSE 'd' END AS a, 'r' AS b FROM events")
def merged_objects(t):
    left = F.create_map(F.lit("a"), F.when(F.col("event_type") == "click", F.concat(F.lit("c"), F.col("user_id").cast("string"))))
    m = L.merge_objects(left, F.create_map(F.lit("a"), F.lit("d"), F.lit("b"), F.lit("r")))
    return t.events.select("event_id", F.element_at(m, "a").alias("a"), F.element_at(m, "b").alias("b"))


def _ing(t):
    return t.part.filter("p_type IN ('PROMO','SMALL')").groupBy(F.initcap("p_name").alias("canonical_name")).agg(F.min("p_partkey").cast("string").alias("ingredient_id"))


def _normalized(t):
    rows = bridge(t).join(t.part.selectExpr("p_partkey AS ingredient_id", "' ' || p_name || CASE WHEN p_size > 40 THEN ' x' ELSE '' END AS raw"), "ingredient_id").drop("ingredient_id")
    aliases = t.part.filter("p_size > 40 AND p_type = 'LARGE'").groupBy(F.concat("p_name", F.lit(" X")).alias("alias")).agg(F.min("p_partkey").cast("string").alias("ingredient_id"))
    return J.normalize_ingredients(rows, _ing(t).filter("canonical_name NOT LIKE 'Small%'"), aliases, "product_id", "position", "raw")


_NI = f"""{BRIDGE_SQL}, rw AS (SELECT product_id, position, p_name || CASE WHEN p_size > 40 THEN ' x' ELSE '' END AS raw FROM bridge JOIN part ON p_partkey = ingredient_id),
i AS (SELECT lower(p_name) AS k, CAST(min(p_partkey) AS VARCHAR) AS id FROM part WHERE p_type IN ('PROMO','SMALL') AND p_name NOT LIKE 'small%' GROUP BY 1), a AS (SELECT lower(p_name || ' X') AS k, CAST(min(p_partkey) AS VARCHAR) AS id FROM part WHERE p_size > 40 AND p_type = 'LARGE' GROUP BY 1),
m AS (SELECT product_id, position, raw, coalesce(i.id, a.id, 'n-' || left(sha256(lower(raw)), 32)) AS ingredient_id, i.id IS NULL AND a.id IS NULL AS fresh FROM rw LEFT JOIN i ON i.k = lower(raw) LEFT JOIN a ON a.k = lower(raw))"""


@query("normalized_bridge", f"WITH {_NI} SELECT product_id, ingredient_id, min(position) AS position, arg_min(raw, (position, raw)) AS raw_name FROM m GROUP BY 1, 2")
def normalized_bridge(t):
    return _normalized(t)[0]


@query("normalized_entities", f"WITH {_NI} SELECT ingredient_id, min(raw) AS canonical_name FROM m WHERE fresh GROUP BY 1")
def normalized_entities(t):
    return _normalized(t)[1].filter(F.startswith("ingredient_id", F.lit("n-"))).select("ingredient_id", "canonical_name")


def _claims(t):
    low = F.lower("text")
    d = t.documents.select(
        "doc_id", F.array_compact(F.array(F.when(F.contains(low, F.lit("the ")), F.lit("sulfate_free")), F.when(F.contains(low, F.lit(" der ")), F.lit("vegan")))).alias("detected"),
        F.array_compact(F.array(F.when(~F.contains(low, F.lit("que")), F.lit("low_poo")))).alias("inferred"))
    d = d.withColumn("confidence", C.seal_confidence(F.size("detected"), F.size("inferred")))
    return J.normalize_claims(d, "doc_id", "detected", "inferred", "confidence")


_CL = """c AS (SELECT doc_id, list_filter([CASE WHEN contains(lower(text),'the ') THEN 'sulfate_free' END, CASE WHEN contains(lower(text),' der ') THEN 'vegan' END], lambda x: x IS NOT NULL) AS d, list_filter([CASE WHEN NOT contains(lower(text),'que') THEN 'low_poo' END], lambda x: x IS NOT NULL) AS i FROM documents),
l AS (SELECT doc_id, unnest(d) AS claim, 'keyword' AS source, len(d) AS nd, len(i) AS ni FROM c UNION ALL SELECT doc_id, unnest(i), 'inci_inference', len(d), len(i) FROM c)"""


@query("product_claims", f"WITH {_CL} SELECT doc_id, claim, source, CASE WHEN nd > 0 AND ni > 0 THEN 0.9 WHEN nd > 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence_score FROM l")
def product_claims(t):
    return _claims(t)[0]


@query("claim_entities", f"WITH {_CL} SELECT DISTINCT claim, CASE claim WHEN 'sulfate_free' THEN 'Sulfate Free' WHEN 'vegan' THEN 'Vegan' ELSE 'Low Poo' END AS display_name FROM l")
def claim_entities(t):
    return _claims(t)[1].select("claim", "display_name")


@query("normalized_images", P + """SELECT product_id, image_url_main AS url, 'main' AS image_type, CAST(0 AS INT) AS position FROM products WHERE image_url_main IS NOT NULL
UNION ALL SELECT product_id, w, 'gallery', CAST(i AS INT) FROM (SELECT product_id, unnest(string_split(product_name, ' ')) AS w, unnest(range(1, len(string_split(product_name, ' ')) + 1)) AS i FROM products)""")
def normalized_images(t):
    return J.normalize_images(products(t).withColumn("g", F.split("product_name", " ")), "product_id", "image_url_main", "g")


@query("normalized_compositions", P + "SELECT product_id, size_volume AS content FROM products WHERE size_volume IS NOT NULL")
def normalized_compositions(t):
    return J.normalize_compositions(products(t), "product_id", "size_volume").select("product_id", "content")


@query("replaced_evidence", """WITH e AS (SELECT l_orderkey AS k, l_returnflag AS kind, l_linenumber AS no, l_partkey AS p FROM lineitem), f AS (SELECT o_orderkey AS k, 'R' AS kind, 0 AS no, o_custkey AS p FROM orders WHERE o_orderstatus = 'F')
SELECT k, kind, no, p FROM e WHERE NOT (kind = 'R' AND k IN (SELECT k FROM f)) UNION ALL SELECT k, kind, no, p FROM f""")
def replaced_evidence(t):
    e = t.lineitem.selectExpr("l_orderkey AS k", "l_returnflag AS kind", "l_linenumber AS no", "l_partkey AS p")
    f = t.orders.filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS k", "'R' AS kind", "0 AS no", "o_custkey AS p")
    return J.replace_evidence(e, f, "k", F.col("kind") == "R")


@query("coverage_sync", P + f""", c AS (SELECT brand_slug, {N} AS total, CAST(count(*) FILTER (WHERE verification_status='verified_inci') AS BIGINT) AS verified FROM products GROUP BY 1), o AS (SELECT 'brand-' || n_nationkey AS brand_slug, CAST(60 + n_nationkey AS BIGINT) AS total, 0.5::DOUBLE AS rate FROM nation)
SELECT coalesce(c.brand_slug, o.brand_slug) AS brand_slug, coalesce(c.total, o.total) AS total, coalesce(round(c.verified / c.total, 4), o.rate) AS rate, coalesce(o.total, 0) AS previous_total,
 c.total IS NOT NULL AND (coalesce(o.total, 0) <> c.total OR abs(coalesce(o.rate, 0) - round(c.verified / c.total, 4)) > 0.0001) AS changed FROM c FULL JOIN o ON c.brand_slug = o.brand_slug""")
def coverage_sync(t):
    counts = R.status_counts(products(t), "brand_slug").select("brand_slug", "total", "verified")
    old = t.nation.selectExpr("'brand-' || CAST(n_nationkey AS STRING) AS brand_slug", "CAST(60 + n_nationkey AS BIGINT) AS total", "CAST(0.5 AS DOUBLE) AS rate", "CAST(NULL AS TIMESTAMP) AS last_run")
    return J.sync_coverage(counts, old).select("brand_slug", "total", "rate", "previous_total", "changed")


_DEC = "d AS (SELECT doc_id AS product_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'approve' WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'reject' ELSE 'start' END AS decision FROM labels)"


def decisions(t):
    return t.labels.selectExpr("doc_id AS product_id", "CASE WHEN quality = 1 AND toxic = 0 THEN 'approve' WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'reject' ELSE 'start' END AS decision", "'rev' || CAST(quality AS STRING) AS reviewer")


@query("review_transitions", P + f""", {_DEC} SELECT product_id, CASE decision WHEN 'start' THEN 'em_revisao' WHEN 'approve' THEN 'aprovado' WHEN 'correct' THEN 'corrigido' WHEN 'reject' THEN 'rejeitado' ELSE status_editorial END AS status_editorial,
 CASE WHEN decision = 'approve' THEN 'publicado' ELSE status_publicacao END AS status_publicacao, CASE WHEN decision = 'start' THEN 'rev0' WHEN decision IS NULL THEN 'nobody' ELSE '-' END AS assigned_to FROM products LEFT JOIN d USING (product_id)""")
def review_transitions(t):
    p = products(t).withColumn("assigned_to", F.lit("nobody"))
    return J.review_transition(p, decisions(t), "product_id").select("product_id", "status_editorial", "status_publicacao", F.coalesce("assigned_to", F.lit("-")).alias("assigned_to"))


@query("transition_revisions", P + f""", {_DEC}, x AS (SELECT product_id, status_publicacao AS a, CASE WHEN decision = 'approve' THEN 'publicado' ELSE status_publicacao END AS b FROM products LEFT JOIN d USING (product_id)) SELECT product_id AS entity_id, a AS old_value, b AS new_value FROM x WHERE a <> b""")
def transition_revisions(t):
    p = products(t).withColumn("assigned_to", F.lit("nobody"))
    return J.diff_revisions(p, J.review_transition(p, decisions(t), "product_id"), "product_id", ["status_publicacao"]).select("entity_id", "old_value", "new_value")


@query("unknown_ids", "SELECT DISTINCT o_custkey AS product_id FROM orders WHERE o_custkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def unknown_ids(t):
    return J.unknown_ids(t.orders.select(F.col("o_custkey").alias("product_id")).distinct(), t.part.filter("p_size > 5").select(F.col("p_partkey").alias("product_id")), "product_id")


@query("batch_status", P + "SELECT product_id, CASE WHEN product_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'arquivado' ELSE status_publicacao END AS status_publicacao FROM products")
def batch_status(t):
    batch = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("product_id"))
    return J.batch_status(products(t), batch, "product_id", "status_publicacao", "arquivado").select("product_id", "status_publicacao")


@query("applied_edits", f"""WITH {checked_sql(PHRASES)} SELECT p_partkey AS product_id, CASE WHEN doc_id IS NULL THEN 'old' WHEN reason = '' THEN 'verified_inci' ELSE 'catalog_only' END AS verification_status FROM part LEFT JOIN res ON doc_id = p_partkey AND lang <> 'de'""")
def applied_edits(t):
    p = t.part.select(F.col("p_partkey").alias("product_id"), F.array("p_name").alias("items"), F.lit("old").alias("verification_status"), F.lit("x").alias("extraction_method"))
    edits = phrase_lists(t).filter("lang <> 'de'").withColumnRenamed("doc_id", "product_id")
    return J.apply_edit(p, edits, "product_id", "items", RULES).select("product_id", "verification_status")


def _dirty(t):
    tail = F.when(F.col("p_size") > 30, "?utm_source=a").when(F.col("p_size") > 20, "#x").otherwise("")
    return products(t).join(t.part.select(F.col("p_partkey").alias("product_id"), "p_size", "p_name"), "product_id").withColumn(
        "u", F.concat(F.lit("https://shop.example.com/"), "brand_slug", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), tail))


_DIRTY = """dt AS (SELECT product_id, brand_slug, p_name, p_size, price, image_url_main, 'https://shop.example.com/' || brand_slug || '/' || replace(p_name, ' ', '-') AS u, p_size <= 20 AS lead FROM products JOIN part ON p_partkey = product_id)"""


@query("merged_duplicates", P + f""", {_DIRTY} SELECT u, arg_min(product_id, (CASE WHEN lead THEN 0 ELSE 1 END, product_id)) AS product_id, {N} AS members,
 coalesce(arg_min(price, (CASE WHEN lead THEN 0 ELSE 1 END, product_id)) FILTER (WHERE price IS NOT NULL), -1) AS price, coalesce(arg_min(image_url_main, (CASE WHEN lead THEN 0 ELSE 1 END, product_id)) FILTER (WHERE image_url_main IS NOT NULL), '-') AS image FROM dt GROUP BY u""")
def merged_duplicates(t):
    m, _map = J.merge_duplicates(_dirty(t), "product_id", "u", ["price", "image_url_main"])
    return m.select("u", "product_id", "members", F.coalesce("price", F.lit(-1.0)).alias("price"), F.coalesce("image_url_main", F.lit("-")).alias("image"))


@query("merged_duplicate_lists", P + f""", {_DIRTY} SELECT DISTINCT u, unnest([brand_slug, 's' || p_size]) AS value FROM dt""")
def merged_duplicate_lists(t):
    d = _dirty(t).withColumn("l", F.array("brand_slug", F.concat(F.lit("s"), F.col("p_size").cast("string"))))
    return J.merge_duplicate_lists(d, "product_id", "u", "l").select("u", "value")


@query("rekeyed_evidence", P + f""", {_DIRTY}, k AS (SELECT u, arg_min(product_id, (CASE WHEN lead THEN 0 ELSE 1 END, product_id)) AS kept FROM dt GROUP BY 1), m AS (SELECT dt.product_id, kept FROM dt JOIN k USING (u))
SELECT kept AS product_id, {N} AS n FROM lineitem JOIN m ON l_partkey = product_id GROUP BY 1""")
def rekeyed_evidence(t):
    _m, mapping = J.merge_duplicates(_dirty(t), "product_id", "u", ["price"])
    child = t.lineitem.select(F.col("l_partkey").alias("product_id"))
    return J.rekey(child, mapping, "product_id").groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


_MI = f"""{BRIDGE_SQL}, us AS (SELECT ingredient_id, count(*) AS usage FROM bridge GROUP BY 1), e AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name, coalesce(usage, 0) AS usage, CASE WHEN p_name LIKE 'red %' THEN 'Red Thing' ELSE p_name END AS g FROM part LEFT JOIN us ON ingredient_id = p_partkey),
ms AS (SELECT g, arg_min(id, (CASE WHEN name = g THEN 0 ELSE 1 END, -usage, length(name), id)) AS master_id FROM e GROUP BY 1), mp AS (SELECT id, master_id, name FROM e JOIN ms USING (g))"""


def _merged_ingredients(t):
    used = bridge(t).groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("usage"))
    e = t.part.select(F.col("p_partkey").alias("ingredient_id"), F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("canonical_name")).join(used, "ingredient_id", "left").fillna(0, ["usage"])
    reds = {f"red {w}": "Red Thing" for w in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")}
    return J.merge_ingredients(e, bridge(t), "usage", reds)


@query("merged_ingredients", f"WITH {_MI} SELECT id AS ingredient_id, master_id FROM mp")
def merged_ingredients(t):
    return _merged_ingredients(t)[0]


@query("repointed_bridge", f"WITH {_MI} SELECT product_id, master_id, min(position) AS position FROM bridge JOIN mp ON id = ingredient_id GROUP BY 1, 2")
def repointed_bridge(t):
    return _merged_ingredients(t)[1]


@query("clean_ingredients", """WITH e AS (SELECT doc_id * 1000000 + i AS id, ps[i] AS name FROM (SELECT doc_id, string_split(text, '.') AS ps, unnest(range(1, len(string_split(text, '.')) + 1)) AS i FROM documents)), g AS (SELECT id, regexp_replace(trim(lower(name)), '\\.+$', '') AS k FROM e WHERE NOT (length(trim(name)) < 2 OR name LIKE 'The %' OR (name LIKE '%ung%' AND length(name) >= 40)))
SELECT id AS ingredient_id, min(id) OVER (PARTITION BY k) AS kept_id FROM g""")
def clean_ingredients(t):
    parts = t.documents.select("doc_id", F.posexplode(F.split("text", "[.]")).alias("i", "canonical_name"))
    e = parts.select((F.col("doc_id") * 1000000 + F.col("i") + 1).alias("ingredient_id"), "canonical_name")
    return J.clean_ingredients(e, [("The %", 0), ("%ung%", 40)])[1]


@query("cascade_delete", f"SELECT l_orderkey, {N} AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY 1")
def cascade_delete(t):
    child = t.lineitem.select(F.col("l_partkey").alias("product_id"), "l_orderkey")
    gone = t.part.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("product_id"))
    return J.cascade_delete({"lines": child}, gone, "product_id")["lines"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("backfilled_usage", f"SELECT doc_id, lang = 'fr' AND {_REAL} AS backfilled FROM (SELECT doc_id, lang, {USAGE} AS u FROM documents)")
def backfilled_usage(t):
    d = t.documents.select("doc_id", F.when(F.col("lang") != "fr", "have").otherwise("").alias("usage_instructions"), usage_text().alias("care_usage"))
    return J.backfill_usage(d, FIELDS).select("doc_id", "backfilled")


_BARE = "regexp_replace(lower({}), '[^0-9a-z_]+', '', 'g')"


@query("autoresolved_queue", f"""WITH q AS (SELECT doc_id, text AS cur, CASE WHEN lang = 'en' THEN text WHEN lang = 'fr' THEN left(text, n_chars // 2) || '!' ELSE 'other words here entirely' END AS p1, CASE WHEN source < 'src2' THEN '  ' || text || '!!' WHEN source < 'src5' THEN '' ELSE 'zz' END AS p2 FROM documents),
b AS (SELECT doc_id, {_BARE.format('cur')} AS c, {_BARE.format('p1')} AS a, {_BARE.format('p2')} AS z, cur, p1, p2, regexp_replace(lower(strip_accents(cur)), '[^a-z0-9]+', '', 'g') AS ck, regexp_replace(lower(strip_accents(p2)), '[^a-z0-9]+', '', 'g') AS pk FROM q),
m AS (SELECT *, NOT (c = a OR (length(c) > 20 AND length(a) > 20 AND (contains(c, a) OR contains(a, c)))) AS moved, c = z OR (length(c) > 20 AND length(z) > 20 AND (contains(c, z) OR contains(z, c))) AS near2 FROM b)
SELECT doc_id, CASE WHEN moved AND near2 THEN 'auto_resolved_pass2' WHEN moved THEN 'auto_resolved_post_fix' WHEN ck <> '' AND pk <> '' AND (ck = pk OR (length(ck) > 30 AND (contains(ck, pk) OR contains(pk, ck)))) THEN 'kept_pass_1'
 WHEN trim(cur) = '' AND p2 <> '' THEN 'accepted_pass_2' WHEN (length(p2) = 0 AND length(p1) > 50) OR (length(p2) > 0 AND length(p1) > 2 * length(p2) AND length(p1) > 200) THEN 'kept_longer' ELSE 'pending' END AS resolution FROM m""")
def autoresolved_queue(t):
    cur = F.col("text")
    p1 = F.when(F.col("lang") == "en", cur).when(F.col("lang") == "fr", F.concat(F.expr("left(text, cast(n_chars div 2 as int))"), F.lit("!"))).otherwise("other words here entirely")
    p2 = F.when(F.col("source") < "src2", F.concat(F.lit("  "), cur, F.lit("!!"))).when(F.col("source") < "src5", "").otherwise("zz")
    none = F.array().cast("array<string>")
    q = t.documents.select("doc_id", cur.alias("current"), p1.alias("pass_1_value"), p2.alias("pass_2_value"), F.lit("description").alias("field_name"), none.alias("current_items"), none.alias("pass_2_items"), F.lit(True).alias("newest"))
    return J.autoresolve(q).select("doc_id", F.coalesce("resolution", F.lit("pending")).alias("resolution"))


@query("quarantine_backlog", P + """, v AS (SELECT product_id, verification_status AS s, CASE WHEN contains(lower(product_name), 'gizmo') THEN 'non_hair:gizmo' WHEN contains(lower(product_name), 'widget') THEN 'hair_keyword:widget' WHEN contains(lower(product_url), 'gizmo') THEN 'non_hair_url:gizmo' WHEN contains(lower(product_url), 'widget') THEN 'hair_keyword_url:widget' WHEN contains(lower(product_url), 'brand-2') THEN 'hair_keyword_url:brand-2' ELSE 'no_hair_keyword' END AS r FROM products)
SELECT product_id, r AS rejection_reason, split_part(r, ':', 1) AS rejection_code FROM v WHERE s <> 'quarantined' AND r NOT LIKE 'hair%'""")
def quarantine_backlog(t):
    v = C.domain_relevance("product_name", "product_url", None, ["gizmo"], ["widget", "brand-2"], [])
    return J.quarantine_backlog(products(t), "product_name", "product_url", v)[1].select("product_id", "rejection_reason", "rejection_code")


_VOLUME = r"(?i)(\d+(?:[.,]\d+)?\s*(?:ml|g|kg|lt|l|oz))\b"


@query("gap_filled", f"""WITH {DESCRIBED_SQL}, e AS (SELECT l_partkey AS pid, CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ml' AS txt, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) AS rn FROM lineitem),
d AS (SELECT p.*, coalesce(CASE WHEN coalesce(trim(description), '') = '' THEN txt END, description) AS filled FROM products p LEFT JOIN e ON pid = product_id AND rn = 1),
f AS (SELECT product_id, coalesce(size_volume, nullif(trim(regexp_extract(product_name, '{_VOLUME}', 1)), ''), nullif(trim(regexp_extract(coalesce(filled, ''), '{_VOLUME}', 1)), '')) AS v,
 coalesce(product_category, CASE WHEN contains(product_name, 'widget') THEN 'w' WHEN contains(product_name, 'ring') THEN 'r' END) AS c FROM d) SELECT product_id, coalesce(v, '-') AS volume, coalesce(c, '-') AS category FROM f""")
def gap_filled(t):
    p = products(t, True).withColumn("image_urls_gallery", F.array(F.lit("g")))
    ev = t.lineitem.selectExpr("l_partkey AS product_id", "CAST(CAST(l_quantity AS INT) AS STRING) || ' ml' AS raw_source_text", "l_shipdate AS extracted_at", "l_orderkey * 10 + l_linenumber AS evidence_id")
    im = t.lineitem.selectExpr("l_partkey AS product_id", "l_returnflag AS url", "l_linenumber AS position")
    d = J.gap_fill(p, ev, im, {"ring": "r", "widget": "w"})
    return d.select("product_id", F.coalesce("size_volume", F.lit("-")).alias("volume"), F.coalesce("product_category", F.lit("-")).alias("category"))


@query("synced_categories", """WITH u AS (SELECT upper(p_name) AS n, max(p_type) AS c FROM part WHERE p_size > 48 GROUP BY 1) SELECT p_partkey AS ingredient_id, coalesce(c, p_type) AS category, c IS NOT NULL AS updated FROM part LEFT JOIN u ON lower(n) = lower(p_name)""")
def synced_categories(t):
    ing = t.part.selectExpr("p_partkey AS ingredient_id", "p_name AS canonical_name", "p_type AS category")
    return J.sync_categories(ing, t.part.filter("p_size > 48").selectExpr("upper(p_name) AS canonical_name", "p_type AS category")).select("ingredient_id", "category", "updated")


@query("brand_deleted", P + f"SELECT 'products' AS tbl, {N} AS n FROM products WHERE brand_slug <> 'brand-7' UNION ALL SELECT 'lines', {N} FROM lineitem WHERE l_partkey NOT IN (SELECT product_id FROM products WHERE brand_slug = 'brand-7')")
def brand_deleted(t):
    out = J.delete_brand({"lines": t.lineitem.select(F.col("l_partkey").alias("product_id"))}, products(t), "brand-7", "product_id")
    a = out["products"].agg(F.lit("products").alias("tbl"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(out["lines"].agg(F.lit("lines").alias("tbl"), F.count(F.lit(1)).alias("n")))


def _registry(t):
    reg = t.nation.selectExpr("'brand-' || CAST(n_nationkey AS STRING) AS brand_slug", "n_name AS brand_name", "'https://n' || CAST(n_nationkey AS STRING) || '.com' AS official_url_root")
    ch = t.supplier.selectExpr("'brand-' || CAST(s_suppkey AS STRING) AS brand_slug", "CASE WHEN s_suppkey < 10 THEN 'patch' WHEN s_suppkey < 20 THEN 'delete' ELSE 'create' END AS op",
                               "CASE WHEN s_acctbal > 500 THEN s_name ELSE '' END AS brand_name", "CASE WHEN s_acctbal > 9000 THEN 'ftp://x' ELSE 'https://' || s_name END AS official_url_root")
    return J.registry_crud(reg, ch, products(t).filter("brand_slug <> 'brand-12'"))


_REG = """reg AS (SELECT 'brand-' || n_nationkey AS brand_slug, n_name AS brand_name FROM nation), ch AS (SELECT 'brand-' || s_suppkey AS brand_slug, CASE WHEN s_suppkey < 10 THEN 'patch' WHEN s_suppkey < 20 THEN 'delete' ELSE 'create' END AS op, CASE WHEN s_acctbal > 500 THEN s_name ELSE '' END AS nm, s_acctbal > 9000 AS bad FROM supplier),
jd AS (SELECT ch.*, CASE WHEN op = 'create' AND brand_slug IN (SELECT brand_slug FROM reg) THEN 'exists' WHEN op <> 'create' AND brand_slug NOT IN (SELECT brand_slug FROM reg) THEN 'unknown' WHEN op = 'create' AND trim(nm) = '' THEN 'name_missing' WHEN bad AND op <> 'delete' THEN 'bad_url'
 WHEN op = 'delete' AND brand_slug IN (SELECT brand_slug FROM products WHERE brand_slug <> 'brand-12') THEN 'has_products' END AS refusal FROM ch)"""


@query("registry_changes", P + f""", {_REG} SELECT reg.brand_slug, coalesce(nm, brand_name) AS brand_name FROM reg LEFT JOIN (SELECT * FROM jd WHERE refusal IS NULL AND op = 'patch') p ON p.brand_slug = reg.brand_slug WHERE reg.brand_slug NOT IN (SELECT brand_slug FROM jd WHERE refusal IS NULL AND op = 'delete')
UNION ALL SELECT brand_slug, nm FROM jd WHERE refusal IS NULL AND op = 'create'""")
def registry_changes(t):
    return _registry(t)[0].select("brand_slug", "brand_name")


@query("registry_refusals", P + f", {_REG} SELECT brand_slug, op, refusal FROM jd WHERE refusal IS NOT NULL")
def registry_refusals(t):
    return _registry(t)[1]


@query("filled_missing", f"""WITH {checked_sql(PHRASES)} SELECT doc_id, lang <> 'es' AND reason = '' AND source <> 'src1' AS list_filled, lang = 'en' AND {_REAL} AS usage_filled FROM (SELECT *, {USAGE} AS u FROM res)""")
def filled_missing(t):
    d = phrase_lists(t)
    p = d.select("doc_id", F.when(F.col("source") == "src1", F.array(F.lit("x"))).alias("inci_ingredients"), F.when(F.col("lang") == "en", "").otherwise("have").alias("usage_instructions"), F.lit("catalog_only").alias("verification_status"), F.lit(0.1).alias("confidence"))
    found = d.filter("lang <> 'es'").select("doc_id", "items", F.lit(None).cast("string").alias("usage"))
    second = d.select("doc_id", F.lit(None).cast("array<string>").alias("items"), usage_text().alias("usage"))
    return J.fill_missing(p, found, second, "doc_id", FIELDS).select("doc_id", "list_filled", "usage_filled")


def _created(t):
    batch = t.supplier.selectExpr("s_suppkey AS batch_id", "'brand-' || CAST(s_nationkey AS STRING) AS brand_slug", "s_name AS product_name", "CASE WHEN s_acctbal > 3000 THEN 'u' || CAST(s_suppkey AS STRING) END AS product_url")
    have = t.part.selectExpr("'u' || CAST(p_size AS STRING) AS product_url")
    return J.create_products(have, batch)


_CRE = "b AS (SELECT s_suppkey AS batch_id, coalesce(CASE WHEN s_acctbal > 3000 THEN 'u' || s_suppkey END, 'manual://brand-' || s_nationkey || '/' || replace(lower(s_name), '#', '-')) AS product_url FROM supplier), h AS (SELECT DISTINCT 'u' || p_size AS product_url FROM part)"


@query("created_products", f"WITH {_CRE} SELECT batch_id, product_url FROM b WHERE product_url NOT IN (SELECT product_url FROM h)")
def created_products(t):
    return _created(t)[0].select("batch_id", "product_url")


@query("rejected_creations", f"WITH {_CRE} SELECT batch_id, product_url FROM b WHERE product_url IN (SELECT product_url FROM h)")
def rejected_creations(t):
    return _created(t)[1].select("batch_id", "product_url")


@query("alias_changes", """WITH a AS (SELECT p_name AS alias, min(p_partkey) AS ingredient_id FROM part WHERE p_size < 25 AND p_name LIKE '% ring' GROUP BY 1), n AS (SELECT upper(p_name) AS alias, min(p_partkey) AS ingredient_id FROM part GROUP BY 1), d AS (SELECT lower(p_name) AS k FROM part WHERE p_name LIKE 'red %'),
u AS (SELECT * FROM a UNION ALL SELECT * FROM n WHERE lower(alias) NOT IN (SELECT lower(alias) FROM a)) SELECT alias, ingredient_id FROM u WHERE lower(alias) NOT IN (SELECT k FROM d)""")
def alias_changes(t):
    a = t.part.filter("p_size < 25 AND p_name LIKE '% ring'").groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("ingredient_id"))
    n = t.part.groupBy(F.upper("p_name").alias("alias")).agg(F.min("p_partkey").alias("ingredient_id"))
    return J.alias_crud(a, n, t.part.filter("p_name LIKE 'red %'").select(F.col("p_name").alias("alias"))).select("alias", "ingredient_id")


@query("batch_decisions", """SELECT event_id, CASE WHEN doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END ELSE 'pending' END AS status FROM events LEFT JOIN labels ON doc_id = event_id""")
def batch_decisions(t):
    q = t.events.selectExpr("event_id", "'pending' AS status", "CAST(NULL AS STRING) AS notes", "CAST(NULL AS TIMESTAMP_NTZ) AS decided_at")
    d = t.labels.selectExpr("doc_id AS event_id", "CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status", "'n' AS notes", "CAST('2024-01-01' AS TIMESTAMP_NTZ) AS decided_at")
    return J.decide(q, d, "event_id").select("event_id", "status")


@query("obvious_bad_rows", P + "SELECT product_id FROM products WHERE verification_status = 'quarantined' AND (length(product_name) < 9 OR product_url IN (SELECT product_url FROM products WHERE verification_status <> 'quarantined'))")
def obvious_bad_rows(t):
    return J.drop_obvious_bad(products(t), "product_name", "product_url", 9).select("product_id")


@query("pending_brands", P + ", reg AS (SELECT 'brand-' || s_suppkey AS brand_slug, CASE WHEN s_acctbal > 8000 THEN 'blocked' END AS status FROM supplier) SELECT brand_slug FROM reg WHERE coalesce(status, '') <> 'blocked' AND brand_slug NOT IN (SELECT brand_slug FROM products) AND brand_slug NOT IN (SELECT 'brand-' || n_nationkey * 3 FROM nation)")
def pending_brands(t):
    reg = t.supplier.selectExpr("'brand-' || CAST(s_suppkey AS STRING) AS brand_slug", "CASE WHEN s_acctbal > 8000 THEN 'blocked' END AS status")
    skip = t.nation.selectExpr("'brand-' || CAST(n_nationkey * 3 AS STRING) AS brand_slug")
    return J.pending_brands(reg, products(t), skip).select("brand_slug")


@query("crawl_difference", "WITH a AS (SELECT DISTINCT l_partkey AS u FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT l_partkey AS u FROM lineitem WHERE l_discount > 0.08) SELECT coalesce(a.u, b.u) AS url, CASE WHEN a.u IS NULL THEN 'new' WHEN b.u IS NULL THEN 'gone' ELSE 'both' END AS status FROM a FULL JOIN b ON a.u = b.u")
def crawl_difference(t):
    a, b = t.lineitem.filter("l_quantity > 48"), t.lineitem.filter("l_discount > 0.08")
    return J.crawl_difference(a.select(F.col("l_partkey").alias("url")), b.select(F.col("l_partkey").alias("url")), "url")


@query("upserted_profiles", """WITH o AS (SELECT c_custkey AS user_id, c_mktsegment AS seg FROM customer WHERE c_acctbal < 5000), n AS (SELECT o_custkey AS user_id, max(o_orderpriority) AS seg FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.seg, o.seg) AS seg FROM o FULL JOIN n ON o.user_id = n.user_id""")
def upserted_profiles(t):
    o = t.customer.filter("c_acctbal < 5000").selectExpr("c_custkey AS user_id", "c_mktsegment AS seg")
    n = t.orders.filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderpriority").alias("seg"))
    return J.upsert(o, n, ["user_id"])

