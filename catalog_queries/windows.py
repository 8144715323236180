"""Window queries: best row, top k, running totals, trailing windows, fill-down."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.operators import windows as W

from .base import BRIDGE_SQL, DESCRIBED_SQL, PRODUCTS_SQL, bridge, products, query

P = f"WITH {PRODUCTS_SQL} "
N = "CAST(count(*) AS BIGINT)"

_SCORE = """(CASE WHEN verification_status='verified_inci' THEN 1000 ELSE 0 END) + (CASE WHEN is_kit THEN 500 ELSE 0 END)
 + (CASE WHEN lower(product_url) LIKE '%/produto%' THEN 200 ELSE 0 END) + (CASE WHEN price IS NOT NULL THEN 100 ELSE 0 END)
 + (CASE WHEN description IS NOT NULL THEN 50 ELSE 0 END) + (CASE WHEN image_url_main IS NOT NULL THEN 25 ELSE 0 END)"""


@query("dedupe_variants", f"""WITH {DESCRIBED_SQL}, r AS (SELECT *, {_SCORE} AS richness FROM products),
k AS (SELECT *, row_number() OVER (PARTITION BY brand_slug, product_name, coalesce(size_volume,'') ORDER BY richness DESC, created, product_id) AS rn FROM r)
SELECT product_id, brand_slug, product_name, CAST(richness AS INT) AS richness FROM k WHERE rn = 1""")
def dedupe_variants(t):
    p = products(t, True)
    score = W.variant_score(F.col("verification_status"), F.col("is_kit"), F.col("product_url"), F.col("price"), F.col("description"), F.col("image_url_main"))
    return W.dedupe_variants(p, "brand_slug", "product_name", "size_volume", score, "created", "product_id").select(
        "product_id", "brand_slug", "product_name", "richness")


_QUEUE = "q AS (SELECT event_id AS review_id, user_id AS product_id, event_type AS field_name, CASE WHEN value < 60 THEN 'pending' ELSE 'resolved' END AS status, ts AS created_at FROM events)"


def review_queue(t):
    return t.events.selectExpr("event_id AS review_id", "user_id AS product_id", "event_type AS field_name",
                               "CASE WHEN value < 60 THEN 'pending' ELSE 'resolved' END AS status", "ts AS created_at")


@query("dedupe_review", f"""WITH {_QUEUE}, k AS (SELECT *, row_number() OVER (PARTITION BY product_id, field_name, status ORDER BY created_at DESC, review_id DESC) AS rn FROM q)
SELECT review_id, product_id, field_name, CASE WHEN status='pending' AND rn > 1 THEN 'superseded' ELSE status END AS status FROM k""")
def dedupe_review(t):
    return W.dedupe_review(review_queue(t), "product_id", "field_name", "created_at", "review_id").select(
        "review_id", "product_id", "field_name", "status")


@query("fill_from_evidence", f"""WITH {DESCRIBED_SQL}, e AS (SELECT l_partkey AS product_id, l_returnflag || '-' || l_orderkey AS txt,
 row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC, l_returnflag || '-' || l_orderkey DESC) AS rn FROM lineitem)
SELECT p.product_id, coalesce(CASE WHEN coalesce(trim(description),'') = '' THEN txt END, description) AS description
FROM products p LEFT JOIN e ON e.product_id = p.product_id AND rn = 1""")
def fill_from_evidence(t):
    ev = t.lineitem.selectExpr("l_partkey AS product_id", "l_returnflag || '-' || CAST(l_orderkey AS STRING) AS raw_source_text", "l_shipdate AS extracted_at",
                               "l_orderkey * 10 + l_linenumber AS evidence_id")
    # Ties in time and id go to the larger text on both sides.
    ev = ev.groupBy("product_id", "extracted_at", "evidence_id").agg(F.max("raw_source_text").alias("raw_source_text"))
    return W.fill_from_evidence(products(t, True), ev, "product_id", "description").select("product_id", "description")


@query("fill_first_image", P + """, i AS (SELECT l_partkey AS product_id, arg_min('u' || l_orderkey, (l_linenumber, 'u' || l_orderkey)) AS url FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
SELECT p.product_id, coalesce(image_url_main, url, 'g' || p.product_id) AS image_url_main FROM products p LEFT JOIN i USING (product_id)""")
def fill_first_image(t):
    images = t.lineitem.filter("l_quantity > 49").selectExpr("l_partkey AS product_id", "'u' || CAST(l_orderkey AS STRING) AS url", "l_linenumber AS position")
    p = products(t).withColumn("gallery", F.array(F.concat(F.lit("g"), F.col("product_id").cast("string"))))
    return W.fill_first_image(p, images, "product_id", "image_url_main", "gallery").select("product_id", "image_url_main")


_RUNS = "r AS (SELECT o_orderpriority AS brand, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS seq, o_orderkey, o_orderstatus = 'F' AND o_totalprice > 20000 AS failed FROM orders)"


def runs(t):
    numbered = W.numbered(t.orders, "o_orderpriority", [F.col("o_orderkey")], F.floor(F.col("o_orderkey") / 65536))
    return numbered.select(F.col("o_orderpriority").alias("brand"), (F.col("idx") + 1).alias("seq"), "o_orderkey",
                           (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 20000)).toDF("brand", "seq", "o_orderkey", "failed")


@query("stop_the_line", f"""WITH {_RUNS}, s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY brand ORDER BY seq) AS f FROM r),
c AS (SELECT brand, min(seq) AS cut FROM s WHERE seq >= 5 AND f / seq > 0.34 GROUP BY 1)
SELECT s.brand, seq, o_orderkey, CAST(f AS BIGINT) AS failures, cut IS NOT NULL AS stopped FROM s LEFT JOIN c USING (brand) WHERE cut IS NULL OR seq <= cut""")
def stop_the_line(t):
    return W.stop_the_line(runs(t), "brand", "seq", F.col("failed"), threshold=0.34, chunk_rows=500).select(
        "brand", "seq", "o_orderkey", "failures", "stopped")


@query("rate_limit_flags", """SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS in_window, count(*) OVER w > 3 AS limited FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECONDS PRECEDING AND CURRENT ROW)""")
def rate_limit_flags(t):
    return W.rate_limit_flags(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3, 21600).select("event_id", "in_window", "limited")


@query("budget_cut", """WITH s AS (SELECT o_orderkey, o_orderpriority, CAST(sum(CAST(o_custkey AS BIGINT)) OVER (ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS b FROM orders)
SELECT o_orderkey, o_orderpriority, coalesce(b, 0) AS spent_before FROM s WHERE coalesce(b, 0) < 2000000""")
def budget_cut(t):
    work = t.orders.select("o_orderkey", "o_orderpriority", "o_custkey")
    chunk = F.struct("o_orderpriority", F.floor(F.col("o_orderkey") / 4096).alias("b"))
    return W.budget_cut(work, [F.col("o_orderpriority"), F.col("o_orderkey")], F.col("o_custkey"), 2_000_000, chunk, F.col("o_orderpriority")).select(
        "o_orderkey", "o_orderpriority", "spent_before")


@query("list_positions_deduped", f"""WITH {BRIDGE_SQL}, c AS (SELECT product_id, p_name AS entity, position, ingredient_id FROM bridge JOIN part ON p_partkey = ingredient_id)
SELECT product_id, entity, min(position) AS position, arg_min(ingredient_id, (position, ingredient_id)) AS ingredient_id FROM c GROUP BY 1, 2""")
def list_positions_deduped(t):
    named = bridge(t).join(t.part.selectExpr("p_partkey AS ingredient_id", "p_name AS entity"), "ingredient_id")
    return W.list_dedupe_positions(named, "product_id", "entity", "position", "ingredient_id")


@query("list_ranks", f"""WITH {BRIDGE_SQL} SELECT product_id, ingredient_id, CAST(count(*) OVER (PARTITION BY product_id) AS BIGINT) AS n,
 CAST(row_number() OVER (PARTITION BY product_id ORDER BY position, ingredient_id, tie) - 1 AS BIGINT) AS idx FROM bridge""")
def list_ranks(t):
    b = W.numbered(bridge(t), "product_id", [F.col("position"), F.col("ingredient_id"), F.col("tie")], F.floor(F.col("position") / 4))
    return b.select("product_id", "ingredient_id", "n", F.col("idx").cast("long").alias("idx"))


@query("top_products_per_category", P + """, r AS (SELECT product_category, product_id, price, row_number() OVER (PARTITION BY product_category ORDER BY price DESC NULLS LAST, product_id) AS rk FROM products WHERE product_category IS NOT NULL)
SELECT product_category, product_id, price, CAST(rk AS INT) AS rank FROM r WHERE rk <= 5""")
def top_products_per_category(t):
    d = products(t).filter(F.col("product_category").isNotNull()).select("product_category", "product_id", "price")
    return W.top_k(d, ["product_category"], [F.col("price").desc_nulls_last(), F.col("product_id")], 5)


@query("richest_lists", f"WITH {BRIDGE_SQL} SELECT product_id, {N} AS items FROM bridge GROUP BY 1 ORDER BY items DESC, product_id LIMIT 60")
def richest_lists(t):
    return bridge(t).groupBy("product_id").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), "product_id").limit(60)


@query("last_turns", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id, turn, role FROM r WHERE rn <= 4")
def last_turns(t):
    return W.last_turns(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", 2)


@query("last_user_message", "SELECT conv_id, arg_max(text, turn) AS last_message, max(turn) AS last_turn FROM conversations WHERE role='user' GROUP BY 1")
def last_user_message(t):
    return W.last_user_message(t.conversations, "conv_id", "turn", "role", "text")


@query("conversation_titles", "SELECT conv_id, left(arg_min(text, turn), 80) AS title FROM conversations WHERE role='user' GROUP BY 1")
def conversation_titles(t):
    return W.conversation_title(t.conversations, "conv_id", "turn", "role", "text")


@query("fill_down", """WITH h AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'u' || user_id END AS head FROM events)
SELECT event_id, last_value(head IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM h""")
def fill_down(t):
    d = t.events.selectExpr("event_id", "CASE WHEN event_type = 'signup' THEN 'u' || CAST(user_id AS STRING) END AS head")
    return W.fill_down(d, "event_id", "head", F.floor(F.col("event_id") / 512))


@query("pick_master", f"""WITH {BRIDGE_SQL}, u AS (SELECT ingredient_id, count(*) AS usage FROM bridge GROUP BY 1),
e AS (SELECT p_partkey AS id, p_name AS grp, p_type AS name, coalesce(usage, 0) AS usage, p_type = 'LARGE' AS curated FROM part LEFT JOIN u ON ingredient_id = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY curated DESC, usage DESC, length(name), id) AS rn, count(*) OVER (PARTITION BY grp) AS members FROM e)
SELECT grp, id AS master_id, CAST(members AS BIGINT) AS members FROM r WHERE rn = 1""")
def pick_master(t):
    used = bridge(t).groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("usage"))
    e = t.part.selectExpr("p_partkey AS id", "p_name AS grp", "p_type AS name").join(used.withColumnRenamed("ingredient_id", "id"), "id", "left").fillna(0, ["usage"])
    return W.pick_master(e, "grp", F.col("name") == "LARGE", "usage", "name", "id")


@query("url_priority_wave", """WITH c AS (SELECT * FROM (SELECT p_type AS bucket, p_partkey AS slug FROM part) ORDER BY bucket, slug LIMIT 400)
SELECT bucket, slug, CAST(row_number() OVER (PARTITION BY bucket ORDER BY slug) AS INT) AS rank_in_bucket FROM c""")
def url_priority_wave(t):
    return W.url_priority_wave(t.part.selectExpr("p_type AS bucket", "p_partkey AS slug"), "bucket", "slug", 400)


@query("previous_event_gap", """SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)), -1) AS gap_us FROM events""")
def previous_event_gap(t):
    d = t.events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = W.previous_value(d, ["user_id"], "us", F.floor(F.col("us") / 86_400_000_000), "us", "prev")
    return out.select("event_id", F.coalesce(F.col("us") - F.col("prev"), F.lit(-1)).alias("gap_us"))


@query("first_section_per_field", "SELECT source, lang, arg_min(text, doc_id) AS content FROM documents GROUP BY 1, 2")
def first_section_per_field(t):
    d = t.documents.select("source", "lang", "doc_id", F.col("text").alias("content"))
    return W.first_per_field(d, "source", "lang", "doc_id", "content")
