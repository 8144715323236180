"""Source and sink queries. Files are stood in for by columns: the same functions parse both."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.operators import resolve as E
from shelfgrade.sources import readers as A
from shelfgrade.sources import writers as O

from .base import DOCS_SQL, PRODUCTS_SQL, docs, products, query
from .gates import RULES

P = f"WITH {PRODUCTS_SQL} "
N = "CAST(count(*) AS BIGINT)"
NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "benchmark", "conversations"]


@query("catalog_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, {N} AS rows FROM {n}" for n in NAMES))
def catalog_tables(t):
    return O.table_status({n: getattr(t, n) for n in NAMES})


@query("catalog_rows", "SELECT l_orderkey, l_partkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def catalog_rows(t):
    d = t.lineitem.filter("l_shipdate >= TIMESTAMP_NTZ '1998-01-01'")
    return d.select("l_orderkey", "l_partkey", "l_quantity", F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd").alias("shipped"))


@query("brand_groups", "SELECT lower(p_type) AS brand_group, p_brand AS brand_slug, p_partkey FROM part UNION ALL SELECT 'all', p_name, p_partkey FROM part")
def brand_groups(t):
    text = F.concat(F.lit('{"'), F.lower("p_type"), F.lit('":["'), "p_brand", F.lit('"],"all":["'), "p_name", F.lit('"]}'))
    d = t.part.withColumn("j", text)
    return d.select("p_partkey", F.explode(F.from_json("j", "map<string,array<string>>")).alias("brand_group", "m")).select(
        "brand_group", F.explode("m").alias("brand_slug"), "p_partkey")


@query("brand_group_members", f"SELECT lower(p_type) AS brand_group, p_brand AS brand_slug, {N} AS n FROM part GROUP BY 1, 2")
def brand_group_members(t):
    text = F.concat(F.lit('{"'), F.lower("p_type"), F.lit('":["'), "p_brand", F.lit('"]}'))
    return A.group_members(t.part.select(text.alias("value")), "value").groupBy("brand_group", "brand_slug").agg(F.count(F.lit(1)).alias("n"))


@query("url_lines", "SELECT trim(url) AS url FROM pages WHERE url NOT LIKE '%#top'")
def url_lines(t):
    line = F.when(F.endswith("url", F.lit("#top")), F.concat(F.lit(" # "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit("\r")))
    return A.url_lines(t.pages.select(line.alias("value")).unionByName(t.pages.select(F.lit("  ").alias("value"))), "value")


@query("sitemap_urls", """SELECT 's' || o_orderkey AS sitemap, 'https://x/' || l_partkey || '?a=1&b=2' AS page_url FROM (SELECT DISTINCT o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1)
UNION SELECT 'i' || o_custkey, 'https://x/' || l_partkey || '?a=1&b=2' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1""")
def sitemap_urls(t):
    url = F.concat(F.lit("https://x/"), F.col("l_partkey").cast("string"), F.lit("?a=1&amp;b=2"))
    first = t.lineitem.filter("l_linenumber = 1").select(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("url"), F.concat(F.lit("<urlset><url><loc> "), url, F.lit(" </loc></url></urlset>")).alias("xml"))
    index = t.orders.select(F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("url"), F.concat(F.lit("<sitemapindex><sitemap><loc>s"), F.col("o_orderkey").cast("string"), F.lit("</loc></sitemap></sitemapindex>")).alias("xml"))
    return A.sitemap_to_urls(first.unionByName(index))


@query("vocabulary_table", "SELECT p_partkey, i - 1 AS rank, string_split(p_name, ' ')[i] AS keyword FROM (SELECT p_partkey, p_name, unnest([1, 2]) AS i FROM part)")
def vocabulary_table(t):
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("rank", "keyword"))


@query("allergen_index", "WITH c AS (SELECT p_name AS entry, arg_min(p_brand, (p_size, p_brand)) AS allergen_class, arg_min(p_type, (p_size, p_brand)) AS severity FROM (SELECT p_name, p_size, p_brand, min(p_type) AS p_type FROM part GROUP BY ALL) GROUP BY 1) SELECT * FROM c")
def allergen_index(t):
    d = t.part.groupBy("p_size", "p_brand", F.concat(F.lit(" "), F.upper("p_name"), F.lit(" *")).alias("name")).agg(F.min("p_type").alias("severity"))
    return A.allergen_index(d.select(F.col("p_size").alias("rank"), F.col("p_brand").alias("allergen_class"), "severity", "name"))


@query("rule_rows", f"SELECT p_type AS category, p_brand AS hair_type, p_size AS score, p_name AS reason, {N} AS n FROM part GROUP BY ALL")
def rule_rows(t):
    text = F.concat(F.lit('{"'), "p_type", F.lit('":{"by_hair_type":{"'), "p_brand", F.lit('":{"score":'), F.col("p_size").cast("string"), F.lit(',"reason":"'), "p_name", F.lit('"}}}}'))
    return A.load_rules(t.part.select(text.alias("j")), "j").groupBy("category", "hair_type", "score", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("export_rows", P + "SELECT product_id, brand_slug, coalesce(price, -1) AS price, '[\"' || product_name || '\"]' AS items FROM products")
def export_rows(t):
    p = products(t).withColumns({"items": F.array("product_name"), "price": F.coalesce("price", F.lit(-1.0))})
    return O.export_products(p, "product_id", ["product_id", "brand_slug", "price", "items"])


@query("export_grouped", P + "SELECT product_id, CAST(len(string_split(product_name, ' ')) AS INT) AS list_size, replace(product_name, ' ', ', ') AS list_text, lower(brand_slug) || '; x' AS label_text FROM products WHERE verification_status <> 'quarantined' AND brand_slug = 'brand-3'")
def export_grouped(t):
    p = products(t).withColumns({"items": F.split("product_name", " "), "labels": F.array("brand_slug", F.lit("x")), "product_type_normalized": F.col("product_type")})
    return O.export_grouped(p, "brand-3", "items", "labels").select("product_id", "list_size", "list_text", "label_text")


@query("zone_copies", "SELECT 'open' AS zone, CAST(count(*) AS BIGINT) AS rows FROM part UNION ALL SELECT 'closed', CAST(count(*) AS BIGINT) FROM customer")
def zone_copies(t):
    have = {"open": {"part": t.part.filter("p_size < 20")}, "closed": {}}
    z = O.split_tables({"part": t.part, "customer": t.customer}, {"part": "open", "customer": "closed"}, have, {"part": "p_partkey", "customer": "c_custkey"})
    parts = [df.agg(F.lit(zone).alias("zone"), F.count(F.lit(1)).alias("rows")) for zone, dfs in z.items() for df in dfs.values()]
    return parts[0].unionByName(parts[1])


@query("verified_copies", f"""SELECT 'same' AS c, {N} AS source_rows, {N} AS target_rows, 'ok' AS verdict FROM orders UNION ALL SELECT 'less', {N}, CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT), 'fail' FROM orders
UNION ALL SELECT 'more', CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT), {N}, 'warn' FROM orders""")
def verified_copies(t):
    o, less = t.orders.select("o_orderkey"), t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey")
    cases = [("same", o, o), ("less", o, less), ("more", less, o)]
    parts = [O.verify_copy(a, b, "o_orderkey").select(F.lit(n).alias("c"), "source_rows", "target_rows", "verdict") for n, a, b in cases]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
_ING = f"f AS (SELECT CASE WHEN n_chars < 150 THEN '_d' ELSE 'd' END || (doc_id // 2) AS source, {_CLEAN} AS content FROM documents), g AS (SELECT source, arg_min(content, (length(content), content)) AS content FROM f WHERE content <> '' AND NOT starts_with(source, '_') GROUP BY 1)"


def ingested(t):
    name = F.concat(F.lit("/kb/"), F.when(F.col("n_chars") < 150, "_d").otherwise("d"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".md"))
    return A.ingest_documents(t.documents.select(name.alias("path"), "text"), "path", "text")


@query("ingested_documents", f"WITH {_ING} SELECT source, md5(content) AS digest, CAST(length(content) AS INT) AS char_count, CAST(length(content) // 4 AS BIGINT) AS token_estimate FROM g")
def ingested_documents(t):
    return ingested(t).select("source", F.md5("content").alias("digest"), "char_count", "token_estimate")


@query("synced_documents", f"WITH {_ING}, b AS (SELECT 'd' || item_id AS source, text FROM benchmark) SELECT coalesce(g.source, b.source) AS source, md5(coalesce(text, content)) AS digest, text IS NOT NULL AS touched FROM g FULL JOIN b USING (source)")
def synced_documents(t):
    batch = t.benchmark.select(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("source"), F.col("text").alias("content"))
    return A.sync_documents(ingested(t), batch).select("source", F.md5("content").alias("digest"), "touched")


@query("replaced_documents", "SELECT 'd' || item_id AS source, md5(text) AS digest FROM benchmark")
def replaced_documents(t):
    batch = t.benchmark.select(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("source"), F.col("text").alias("content"))
    return A.sync_documents(ingested(t), batch, replace=True).select("source", F.md5("content").alias("digest"))


@query("assembled_context", f"WITH {_ING} SELECT source, md5('## ' || source || chr(10) || chr(10) || content || chr(10) || chr(10)) AS digest, CAST(length(source) + length(content) + 7 AS INT) AS char_count FROM g")
def assembled_context(t):
    return A.assemble_context(ingested(t)).select("source", F.md5("piece").alias("digest"), "char_count")


@query("garbage_list_texts", """SELECT doc_id, length(s) < 10 OR contains(s, '"@type"') OR (length(s) - length(regexp_replace(s, '[\\[\\]{}]', '', 'g'))) / greatest(length(s), 1) > 0.02 AS garbage
FROM (SELECT doc_id, CASE WHEN lang = 'es' THEN '{"@type":1}' || text WHEN lang = 'de' THEN replace(replace(text, 'e', '['), 'r', ']') ELSE text END AS s FROM documents)""")
def garbage_list_texts(t):
    s = F.when(F.col("lang") == "es", F.concat(F.lit('{"@type":1}'), "text")).when(
        F.col("lang") == "de", F.translate("text", "er", "[]")).otherwise(F.col("text"))
    return t.documents.select("doc_id", A.garbage_list_text(s).alias("garbage"))


@query("ingested_items", f"WITH {DOCS_SQL} SELECT product_id, CASE WHEN product_category = 'en' THEN 'catalog_only' ELSE 'verified_inci' END AS verification_status, CASE WHEN product_category = 'en' THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence FROM docs")
def ingested_items(t):
    feed = F.when(F.col("product_category") == "en", F.lit('{"@type":"Product"} a, b, c, d, e, f, g')).otherwise(
        F.concat(F.lit("Aqua, Glycerin, Parfum, Citric Acid, Sodium Chloride, Panthenol, x"), F.col("product_id").cast("string")))
    d = A.ingest_items(docs(t).withColumn("inci_text", feed), "inci_text", RULES)
    return d.select("product_id", "verification_status", "confidence")


@query("valid_feedback", "SELECT doc_id, CASE quality WHEN 1 THEN 'up' ELSE 'down' END AS rating FROM labels WHERE toxic = 0")
def valid_feedback(t):
    rated = t.labels.select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 'odd' WHEN quality = 1 THEN 'up' ELSE 'down' END").alias("rating"))
    return O.valid_rows(rated, "rating", ["up", "down"])


def _sheets(t):
    nat = t.part.filter("p_size > 30").select(F.concat("p_brand", F.lit(" "), "p_name").alias("brand_name"), F.concat(F.lit("https://www."), F.lower("p_type"), F.lit(".com/"), F.col("p_size").cast("string"), F.lit("/")).alias("site"),
                                              F.when(F.col("p_size") > 45, "sim").alias("has_list"))
    intl = t.part.filter("p_size < 20").select(F.concat("p_brand", F.lit(" "), "p_name").alias("brand_name"), F.lit("FR").alias("country"), F.lit("https://fr.com").alias("site"))
    main = t.events.select(F.col("event_id").alias("row_no"), F.when(F.col("event_type") == "signup", F.concat(F.lit("Main "), F.col("user_id").cast("string"))).alias("brand_name"),
                           F.when(F.col("event_type") == "signup", F.lit("https://main.com")).alias("site"), F.concat(F.lit("http://e/"), "event_type").alias("entry"), F.lit(None).cast("string").alias("notes"))
    return nat, intl, main


@query("brand_sheets", r"""WITH nat AS (SELECT lower(replace(regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9]+', '-', 'g'), ' ', '-')) AS slug, p_brand || ' ' || p_name AS nm FROM part WHERE p_size > 30), intl AS (SELECT lower(regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM part WHERE p_size < 20),
hd AS (SELECT event_id, 'main-' || user_id AS slug, row_number() OVER (ORDER BY event_id) AS pr FROM events WHERE event_type = 'signup'), mp AS (SELECT slug, CAST(max(pr) AS BIGINT) AS priority FROM hd GROUP BY 1)
SELECT slug AS brand_slug, CASE WHEN slug IN (SELECT slug FROM nat) THEN 'Brasil' ELSE 'FR' END AS country, -1 AS priority FROM (SELECT slug FROM nat UNION SELECT slug FROM intl) UNION ALL SELECT slug, '-', priority FROM mp""")
def brand_sheets(t):
    brands, _entries = E.merge_brand_sheets(*_sheets(t), chunk_rows=1000)
    return brands.select("brand_slug", F.coalesce("country", F.lit("-")).alias("country"), F.coalesce(F.col("priority").cast("long"), F.lit(-1).cast("long")).alias("priority"))


@query("brand_entry_points", """WITH f AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id) AS u FROM events) SELECT DISTINCT 'main-' || u AS brand_slug, 'http://e/' || event_type AS entrypoint FROM f WHERE u IS NOT NULL""")
def brand_entry_points(t):
    return E.merge_brand_sheets(*_sheets(t), chunk_rows=1000)[1]


@query("brands_deduped_by_url", """WITH b AS (SELECT p_partkey, p_type || '.com/' || p_size AS root, CASE WHEN p_name LIKE 'red %' THEN p_size END AS priority FROM part) SELECT arg_min(p_partkey, (CASE WHEN priority IS NULL THEN 1 ELSE 0 END, p_partkey)) AS winner, CAST(count(*) AS BIGINT) AS merged FROM b GROUP BY root""")
def brands_deduped_by_url(t):
    b = t.part.select(
        F.col("p_partkey").cast("string").alias("brand_slug"), F.col("p_partkey").alias("row_no"), F.col("p_name").alias("brand_name"), F.concat(F.lit("HTTPS://www."), "p_type", F.lit(".com/"), F.col("p_size").cast("string"), F.lit("/")).alias("official_url_root"),
        F.when(F.startswith("p_name", F.lit("red ")), F.col("p_size")).alias("priority"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("notes"))
    e = t.part.select(F.col("p_partkey").cast("string").alias("brand_slug"), F.lit("x").alias("entrypoint"))
    return E.dedupe_brands_by_url(b, e, "row_no")[0].select(F.col("brand_slug").cast("long").alias("winner"), "merged")
