"""Report queries: counts, rates, coverage and funnels."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.operators import classify as C
from shelfgrade.operators import reports as R

from .base import BRIDGE_SQL, DESCRIBED_SQL, DOCS_SQL, INGREDIENTS_SQL, PRODUCTS_SQL, bridge, docs, ingredients, products, query

P = f"WITH {PRODUCTS_SQL} "
PD = f"WITH {DESCRIBED_SQL} "
N = "CAST(count(*) AS BIGINT)"


def cif(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


STATUSES = f"{N} AS total, {cif('verification_status = $$verified_inci$$')} AS verified, {cif('verification_status = $$catalog_only$$')} AS catalog_only, {cif('verification_status = $$quarantined$$')} AS quarantined"


@query("status_counts", P + f"SELECT {STATUSES} FROM products")
def status_counts(t):
    return R.status_counts(products(t))


@query("status_counts_by_brand", P + f"SELECT brand_slug, {STATUSES} FROM products GROUP BY brand_slug")
def status_counts_by_brand(t):
    return R.status_counts(products(t), "brand_slug")


_IN = "coalesce(product_category <> 'non_hair', true)"


@query("canonical_counts", P + f"""
SELECT brand_slug, {cif(_IN)} AS total, {cif(_IN + " AND verification_status='verified_inci'")} AS verified,
 {cif(_IN + " AND verification_status='catalog_only'")} AS catalog_only, {cif(_IN + " AND verification_status='quarantined'")} AS quarantined,
 {cif(_IN + " AND is_kit")} AS kits, {cif("product_category = 'non_hair'")} AS non_domain
FROM products WHERE NOT is_hidden GROUP BY brand_slug""")
def canonical_counts(t):
    return R.canonical_counts(products(t))


def pct(cond: str, digits: int = 1) -> str:
    return f"round(count(*) FILTER (WHERE {cond}) * 100 / greatest(count(*), 1), {digits})"


@query("brand_quality", PD + f"""
SELECT brand_slug, {N} AS products, round(avg(confidence), 2) AS avg_confidence,
 {pct("coalesce(description,'') <> ''")} AS description_pct, {pct("image_url_main IS NOT NULL")} AS image_pct,
 {pct("coalesce(product_category,'') <> ''")} AS category_pct, {pct("is_kit")} AS labels_pct
FROM products GROUP BY brand_slug""")
def brand_quality(t):
    return R.brand_quality(products(t, True), F.col("is_kit"))


@query("avg_list_size", f"""
WITH b AS (SELECT l_orderkey AS product_id, count(*) AS items FROM lineitem GROUP BY 1)
SELECT o_orderpriority AS brand_slug, {N} AS products, round(avg(items), 4) AS avg_items
FROM b JOIN orders ON o_orderkey = product_id GROUP BY 1""")
def avg_list_size(t):
    owners = t.orders.selectExpr("o_orderkey AS product_id", "o_orderpriority AS brand_slug")
    return R.avg_list_size(bridge(t), owners, "product_id", "brand_slug")


@query("dashboard_kpis", PD + f"""
SELECT {N} AS total_products, {cif("status_editorial='pendente'")} AS pending_review, {cif("verification_status='quarantined'")} AS quarantined,
 {cif("status_publicacao='publicado'")} AS published, round(avg(confidence), 1) AS avg_confidence,
 {pct("coalesce(product_category,'') <> '' AND product_category <> 'non_hair'")} AS category_pct,
 {pct("coalesce(description,'') <> ''")} AS description_pct, {pct("image_url_main IS NOT NULL")} AS image_pct,
 {pct("coalesce(size_volume,'') <> ''")} AS volume_pct, {pct("verification_status='verified_inci'")} AS list_coverage
FROM products""")
def dashboard_kpis(t):
    return R.dashboard_kpis(products(t, True))


@query("list_summary", P + f"""
SELECT brand_slug, {N} AS total, {cif("verification_status='catalog_only'")} AS pending, {cif("verification_status='verified_inci'")} AS verified,
 {pct("verification_status='verified_inci'")} AS pct FROM products GROUP BY brand_slug""")
def list_summary(t):
    return R.list_summary(products(t))


_COV = f"cov AS (SELECT o_orderpriority AS brand_slug, {N} AS extracted_total, {cif("o_orderstatus='F'")} AS verified_total FROM orders GROUP BY 1)"


def coverage(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("brand_slug")).agg(
        F.count(F.lit(1)).alias("extracted_total"), F.count_if(F.col("o_orderstatus") == "F").alias("verified_total"))


@query("coverage_report", f"""
WITH {_COV}, u AS (SELECT * FROM cov UNION ALL SELECT 'TOTAL', CAST(sum(extracted_total) AS BIGINT), CAST(sum(verified_total) AS BIGINT) FROM cov)
SELECT brand_slug, extracted_total AS extracted, verified_total AS verified,
 round(CASE WHEN extracted_total > 0 THEN verified_total / extracted_total ELSE 0 END, 4) AS rate FROM u""")
def coverage_report(t):
    return R.coverage_report(coverage(t))


@query("run_report", P + f""", runs AS (
 SELECT brand_slug, CAST(max(product_id) AS BIGINT) AS extracted, {cif("price > 950")} AS verified, {cif("price <= 950")} AS catalog_only, {cif("is_kit")} AS quarantined
 FROM products WHERE brand_slug LIKE 'brand-1%' GROUP BY 1),
live AS (SELECT brand_slug, {STATUSES} FROM products GROUP BY 1),
u AS (SELECT *, 'run' AS basis FROM runs UNION ALL SELECT *, 'products' FROM live WHERE brand_slug NOT IN (SELECT brand_slug FROM runs))
SELECT *, round(CASE WHEN extracted > 0 THEN verified / extracted ELSE 0 END, 4) AS verified_rate,
 round(CASE WHEN extracted > 0 THEN quarantined / extracted ELSE 0 END, 4) AS failure_rate FROM u""")
def run_report(t):
    p = products(t)
    runs = p.filter(F.startswith("brand_slug", F.lit("brand-1"))).groupBy("brand_slug").agg(
        F.max("product_id").alias("extracted"), F.count_if(F.col("price") > 950).alias("verified"),
        F.count_if(F.col("price") <= 950).alias("catalog_only"), F.count_if("is_kit").alias("quarantined"))
    return R.run_report(runs, p)


_SEALS = """seals AS (SELECT doc_id, list_filter([CASE WHEN contains(lower(text),'the ') THEN 'the' END, CASE WHEN contains(lower(text),' der ') THEN 'der' END], lambda x: x IS NOT NULL) AS detected,
 list_filter([CASE WHEN NOT contains(lower(text),'que') THEN 'no_que' END, CASE WHEN NOT contains(lower(text),'|') THEN 'no_bar' END], lambda x: x IS NOT NULL) AS inferred FROM documents)"""


def seal_arrays(t):
    low = F.lower("text")
    return t.documents.select(
        "doc_id",
        F.array_compact(F.array(F.when(F.contains(low, F.lit("the ")), F.lit("the")), F.when(F.contains(low, F.lit(" der ")), F.lit("der")))).alias("detected"),
        F.array_compact(F.array(F.when(~F.contains(low, F.lit("que")), F.lit("no_que")), F.when(~F.contains(low, F.lit("|")), F.lit("no_bar")))).alias("inferred"))


@query("seal_histogram", f"WITH {_SEALS}, e AS (SELECT unnest(list_concat(detected, inferred)) AS seal FROM seals) SELECT seal, {N} AS n FROM e GROUP BY seal")
def seal_histogram(t):
    return R.seal_histogram(seal_arrays(t), "detected", "inferred")


@query("products_with_seal", f"WITH {_SEALS} SELECT doc_id FROM seals WHERE list_contains(detected, 'der') OR list_contains(inferred, 'der')")
def products_with_seal(t):
    return R.products_with_seal(seal_arrays(t), "der", "detected", "inferred").select("doc_id")


@query("label_report", f"""WITH {_SEALS} SELECT {N} AS total, {cif('len(detected) > 0')} AS with_detected, {cif('len(inferred) > 0')} AS with_inferred,
 {cif('len(detected) > 0 AND len(inferred) > 0')} AS with_both, {cif('len(detected) > 0 OR len(inferred) > 0')} AS with_any FROM seals""")
def label_report(t):
    return R.label_report(seal_arrays(t), "detected", "inferred")


@query("audit_summary", f"""SELECT {N} AS total, {cif("event_type='purchase'")} AS ok, {cif("event_type='error'")} AS failed,
 round(count(*) FILTER (WHERE event_type='error') * 100 / count(*) FILTER (WHERE event_type IN ('purchase','error')), 1) AS fail_rate_pct FROM events""")
def audit_summary(t):
    return R.audit_summary(t.events, "purchase", "error")


@query("top_actions", f"SELECT coalesce(event_type, 'unknown') AS action, {N} AS n FROM events GROUP BY 1 ORDER BY n DESC, action LIMIT 10")
def top_actions(t):
    return R.top_actions(t.events, "event_type")


@query("global_stats", P + f""", {_COV.replace("o_orderpriority AS brand_slug", "o_orderpriority AS b")}
SELECT (SELECT {N} FROM products) AS products, (SELECT CAST(count(DISTINCT brand_slug) AS BIGINT) FROM products) AS brands,
 (SELECT round(avg(round(verified_total / extracted_total, 4)), 4) FROM cov) AS mean_rate""")
def global_stats(t):
    cov = coverage(t).withColumn("verified_rate", F.round(F.col("verified_total") / F.col("extracted_total"), 4))
    return R.global_stats(products(t), cov)


@query("catalog_snapshot", PD + f"""
SELECT {N} AS total, {cif("verification_status='catalog_only'")} AS catalog_only, {cif("verification_status='verified_inci'")} AS verified,
 {cif("verification_status='quarantined'")} AS quarantined, {pct("price IS NOT NULL", 2)} AS price_pct,
 {pct("trim(coalesce(description,'')) NOT IN ('','[]','null')", 2)} AS description_pct, {pct("size_volume IS NOT NULL", 2)} AS size_volume_pct,
 {pct("product_category IS NOT NULL", 2)} AS product_category_pct FROM products""")
def catalog_snapshot(t):
    return R.catalog_snapshot(products(t, True))


@query("catalog_snapshot_by_brand", PD + f"""
SELECT brand_slug, {N} AS total, {cif("verification_status='catalog_only'")} AS catalog_only, {cif("verification_status='verified_inci'")} AS verified,
 {cif("verification_status='quarantined'")} AS quarantined, {pct("price IS NOT NULL", 2)} AS price_pct,
 {pct("trim(coalesce(description,'')) NOT IN ('','[]','null')", 2)} AS description_pct, {pct("size_volume IS NOT NULL", 2)} AS size_volume_pct,
 {pct("product_category IS NOT NULL", 2)} AS product_category_pct FROM products GROUP BY brand_slug""")
def catalog_snapshot_by_brand(t):
    return R.catalog_snapshot(products(t, True), "brand_slug")


@query("ingredient_usage", f"""WITH {BRIDGE_SQL}, {INGREDIENTS_SQL}, u AS (SELECT ingredient_id, {N} AS n FROM bridge GROUP BY 1)
SELECT i.ingredient_id, canonical_name, coalesce(n, 0) AS usage FROM ingredients i LEFT JOIN u USING (ingredient_id)""")
def ingredient_usage(t):
    return R.ingredient_usage(ingredients(t).drop("category"), bridge(t)).select("ingredient_id", "canonical_name", "usage")


_AUDIT_SQL = """CASE WHEN status = 'verified_inci' AND contains(text_list, ',') THEN 'already_verified' WHEN contains(text_list, ',') THEN 'extracted_rejected'
 WHEN coalesce(text_list,'') <> '' THEN 'extraction_missed' ELSE 'no_inci_on_page' END"""
_AUDIT_DOCS = f"{DOCS_SQL}, a AS (SELECT *, split_part(description, chr(10), 1) AS text_list FROM docs), c AS (SELECT *, {_AUDIT_SQL} AS audit_class FROM a)"


def audit(t):
    d = docs(t).withColumn("text_list", F.substring_index("description", "\n", 1))
    n = F.when(F.contains("text_list", F.lit(",")), 1).otherwise(0)
    return d, C.inci_audit_class(F.col("status"), n, F.col("text_list"))


@query("list_audit", f"""WITH {_AUDIT_DOCS} SELECT brand_slug, {N} AS total, {cif("audit_class='already_verified'")} AS already_verified,
 {cif("audit_class='extracted_rejected'")} AS extracted_rejected, {cif("audit_class='extraction_missed'")} AS extraction_missed,
 {cif("audit_class='no_inci_on_page'")} AS no_inci_on_page, {cif("audit_class IN ('extracted_rejected','extraction_missed')")} AS recoverable
 FROM c GROUP BY brand_slug""")
def list_audit(t):
    return R.list_audit(*audit(t))


@query("audit_samples", f"""WITH {_AUDIT_DOCS}, r AS (SELECT brand_slug, audit_class, product_url, CAST(row_number() OVER (PARTITION BY brand_slug, audit_class ORDER BY product_url) AS INT) AS sample_no
 FROM c WHERE audit_class <> 'already_verified') SELECT * FROM r WHERE sample_no <= 3""")
def audit_samples(t):
    return R.audit_samples(*audit(t), "brand_slug", "product_url")


@query("classification_report", f"""WITH {_SEALS}, e AS (SELECT 'detected' AS dimension, unnest(detected) AS value FROM seals UNION ALL SELECT 'inferred', unnest(inferred) FROM seals)
SELECT dimension, value, {N} AS n FROM e GROUP BY ALL""")
def classification_report(t):
    return R.distribution(seal_arrays(t), {"detected": F.col("detected"), "inferred": F.col("inferred")})


@query("rollout_report", P + f""", b AS (SELECT brand_slug, {N} AS g FROM products WHERE gold_status='gold' GROUP BY 1),
a AS (SELECT brand_slug, {N} AS g FROM products WHERE gold_status IN ('gold','gold_candidate') OR is_kit GROUP BY 1)
SELECT coalesce(a.brand_slug, b.brand_slug) AS brand_slug, coalesce(b.g,0) AS gold_before, coalesce(a.g,0) AS gold_after, coalesce(a.g,0)-coalesce(b.g,0) AS delta
FROM b FULL JOIN a USING (brand_slug)""")
def rollout_report(t):
    p = products(t)
    before = p.filter("gold_status = 'gold'").groupBy("brand_slug").agg(F.count(F.lit(1)).alias("gold"))
    after = p.filter("gold_status IN ('gold','gold_candidate') OR is_kit").groupBy("brand_slug").agg(F.count(F.lit(1)).alias("gold"))
    return R.rollout_report(before, after)


@query("feedback_summary", f"""SELECT {cif('quality=1')} AS up, {cif('quality<>1')} AS down,
 round(count(*) FILTER (WHERE quality=1) * 100 / count(*), 1) AS useful_pct FROM labels""")
def feedback_summary(t):
    return R.feedback_summary(t.labels, F.when(F.col("quality") == 1, "up").otherwise("down"))


@query("recent_negative_feedback", "SELECT doc_id, toxic FROM labels WHERE quality <> 1 ORDER BY doc_id DESC LIMIT 20")
def recent_negative_feedback(t):
    return R.page(t.labels.filter("quality <> 1").select("doc_id", "toxic"), [F.desc("doc_id")], 20)


@query("conversation_list", f"SELECT conv_id, {N} AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_list(t):
    return R.conversation_list(t.conversations, "conv_id", "turn")


@query("repeat_questions", f"SELECT sha256(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13))) AS query_hash, {N} AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeat_questions(t):
    return R.repeat_questions(t.documents, "text")


@query("brands_with_many_products", P + f"SELECT brand_slug, {N} AS n FROM products GROUP BY 1 HAVING count(*) >= 80")
def brands_with_many_products(t):
    return R.brands_with_at_least(products(t), 80)


@query("distinct_brands", P + "SELECT CAST(count(DISTINCT brand_slug) AS BIGINT) AS brands, CAST(count(DISTINCT product_url) AS BIGINT) AS urls FROM products")
def distinct_brands(t):
    return products(t).agg(F.countDistinct("brand_slug").alias("brands"), F.countDistinct("product_url").alias("urls"))


_RULES = """rules AS (SELECT p_type AS category, c_mktsegment AS hair_type, CAST(CASE WHEN sum(CAST(round(l_discount*100) AS BIGINT)) * 100 > 500 * count(*) THEN 1
 WHEN sum(CAST(round(l_discount*100) AS BIGINT)) * 1000 < 4960 * count(*) THEN -1 ELSE 0 END AS INT) AS score
 FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey GROUP BY 1,2)"""


def rules_from_sales(t):
    """Compatibility rules derived from the tables: discount level per (part type, customer segment)."""
    d = (
        t.lineitem.select("l_orderkey", "l_partkey", F.round(F.col("l_discount") * 100).cast("long").alias("_d"))
        .join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")))
    total, n = F.sum("_d"), F.count(F.lit(1))
    score = F.when(total * 100 > 500 * n, 1).when(total * 1000 < 4960 * n, -1).otherwise(0)
    return d.groupBy(F.col("p_type").alias("category"), F.col("c_mktsegment").alias("hair_type")).agg(score.alias("score"))


@query("category_rules", f"WITH {_RULES} SELECT category, {N} AS rules, string_agg(hair_type || '=' || score, ', ' ORDER BY hair_type || '=' || score) AS listing FROM rules GROUP BY category")
def category_rules(t):
    return R.category_rules_view(rules_from_sales(t))


@query("ingredient_catalog", f"""WITH {BRIDGE_SQL}, {INGREDIENTS_SQL}, u AS (SELECT ingredient_id, {N} AS n FROM bridge GROUP BY 1)
SELECT i.ingredient_id, canonical_name, category, coalesce(n, 0) AS product_count FROM ingredients i LEFT JOIN u USING (ingredient_id) WHERE contains(lower(canonical_name), 'widget')""")
def ingredient_catalog(t):
    return R.ingredient_catalog(ingredients(t), bridge(t), "widget", "ingredient_id", "canonical_name").select(
        "ingredient_id", "canonical_name", "category", "product_count")


@query("call_ledger", f"""SELECT {N} AS calls, CAST(sum(length(text)) AS BIGINT) AS tokens_in, CAST(sum(turn) AS BIGINT) AS tokens_out,
 CAST(greatest(0, 1000 - count(*)) AS BIGINT) AS remaining FROM conversations""")
def call_ledger(t):
    return R.call_ledger(t.conversations, 1000, F.length("text"), F.col("turn"))


@query("source_stats", f"""SELECT source, {N} AS discovered, {cif('n_chars >= 200')} AS scraped, {cif("n_chars >= 200 AND contains(text, '|')")} AS with_list,
 {cif('n_chars < 200')} AS skipped FROM documents GROUP BY source""")
def source_stats(t):
    return R.source_stats(t.documents, "source", F.col("n_chars") >= 200, F.contains("text", F.lit("|")))


@query("multi_axis_counts", P + f"""SELECT brand_slug, verification_status, product_category, CAST(grouping_id(brand_slug, verification_status, product_category) AS BIGINT) AS level, {N} AS n
FROM products GROUP BY GROUPING SETS ((brand_slug), (verification_status), (product_category), (brand_slug, verification_status), ())""")
def multi_axis_counts(t):
    return R.multi_axis_counts(products(t))


@query("approx_profile")
def approx_profile(t):
    return R.approx_profile(products(t), "product_name", "product_url", "price")


@query("merged_profiles")
def merged_profiles(t):
    """Profiles per brand and in total, both from one set of sketches per brand and type."""
    stored = R.profile_sketches(products(t), ["brand_slug", "product_type"], "product_name", "product_url", "price")
    brands = R.merged_profile(stored, ["brand_slug"])
    return brands.unionByName(R.merged_profile(stored, []).withColumn("brand_slug", F.lit("*")))


@query("document_totals", f"SELECT {N} AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) // 4) AS BIGINT) AS token_estimate FROM documents")
def document_totals(t):
    return R.document_totals(t.documents, "text")


@query("url_depth_counts", f"SELECT len(string_split(split_part(url, '?', 1), '/')) - 3 AS depth, {N} AS n FROM pages GROUP BY 1")
def url_depth_counts(t):
    depth = (F.size(F.split(F.substring_index("url", "?", 1), "/")) - 3).cast("long")
    return R.value_counts(t.pages, depth, "depth")


@query("enrichable_brands", P + f"SELECT brand_slug, {N} AS n FROM products WHERE gold_status = 'catalog' GROUP BY 1")
def enrichable_brands(t):
    return R.enrichable_brands(products(t))
