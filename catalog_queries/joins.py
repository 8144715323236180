"""Join, linkage and scoring queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.functions import similarity as S
from shelfgrade.operators import linkage as K
from shelfgrade.operators import resolve as E
from shelfgrade.operators import windows as W
from shelfgrade.plans import scoring as Q
from shelfgrade.session import staged

from .base import BRIDGE_SQL, INGREDIENTS_SQL, PRODUCTS_SQL, bridge, ingredients, products, query
from .reports import _RULES, rules_from_sales

P = f"WITH {PRODUCTS_SQL} "
N = "CAST(count(*) AS BIGINT)"

_NAMES = """names AS (SELECT DISTINCT CASE WHEN l_linestatus = 'F' THEN upper(p_name) WHEN l_returnflag = 'A' THEN 'nick ' || p_name WHEN l_returnflag = 'R' THEN replace(p_name, 'o', 'ó') ELSE 'x' || p_name END AS raw_name FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def raw_names(t):
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return j.select(F.expr("CASE WHEN l_linestatus = 'F' THEN upper(p_name) WHEN l_returnflag = 'A' THEN 'nick ' || p_name WHEN l_returnflag = 'R' THEN replace(p_name, 'o', 'ó') ELSE 'x' || p_name END").alias("raw_name"))


@query("resolved_ingredients", f"""WITH {_NAMES}, i AS (SELECT lower(p_name) AS k, min(p_partkey) AS id FROM part GROUP BY 1), a AS (SELECT 'nick ' || lower(p_name) AS k, min(p_partkey) AS id FROM part WHERE p_size > 20 GROUP BY 1)
SELECT raw_name, coalesce(i1.id, a1.id, i2.id, -1) AS ingredient_id FROM names LEFT JOIN i i1 ON i1.k = lower(raw_name) LEFT JOIN a a1 ON a1.k = lower(raw_name) LEFT JOIN i i2 ON i2.k = trim(lower(strip_accents(raw_name)))""")
def resolved_ingredients(t):
    ing = t.part.selectExpr("p_partkey AS ingredient_id", "p_name AS canonical_name")
    al = t.part.filter("p_size > 20").selectExpr("p_partkey AS ingredient_id", "'Nick ' || p_name AS alias")
    r = E.resolve_ingredients(raw_names(t), ing, al)
    return r.select("raw_name", F.coalesce("ingredient_id", F.lit(-1)).alias("ingredient_id"))


def entries(t):
    b = W.numbered(bridge(t), "product_id", [F.col("position"), F.col("ingredient_id"), F.col("tie")], F.floor(F.col("position") / 1024))
    return b.join(ingredients(t), "ingredient_id", "left").select("product_id", "idx", "n", F.col("canonical_name").alias("name"), "category")


def owners(t):
    """Each list's owner, with two types: the own segment and one every owner shares."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("profile_id"), F.array_distinct(F.array("c_mktsegment", F.lit("BUILDING"))).alias("hair_types"))


_ENT = f"""{BRIDGE_SQL}, {INGREDIENTS_SQL}, {_RULES},
ent AS (SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY position, ingredient_id, tie) - 1 AS idx, count(*) OVER (PARTITION BY product_id) AS n, canonical_name AS name, category FROM bridge JOIN ingredients USING (ingredient_id)),
own AS (SELECT o_orderkey AS product_id, o_custkey AS profile_id, unnest(list_distinct([c_mktsegment, 'BUILDING'])) AS hair_type FROM orders JOIN customer ON o_custkey = c_custkey),
hit AS (SELECT product_id, profile_id, idx, name, category, hair_type, score, CAST(greatest(0.2::DOUBLE, 1.0::DOUBLE - idx * 0.8::DOUBLE / greatest(n, 1)) AS DECIMAL(12,9)) AS w FROM ent JOIN own USING (product_id) JOIN rules USING (category, hair_type)),
agg AS (SELECT product_id, profile_id, CAST(sum(score * w) AS DOUBLE) AS s, CAST(sum(w) AS DOUBLE) AS ws, count(*) FILTER (WHERE score <= -1) AS al, count(*) FILTER (WHERE score >= 1) AS be FROM hit GROUP BY 1, 2),
siz AS (SELECT product_id, {N} AS items, CAST(count(category) AS BIGINT) AS cat FROM ent GROUP BY 1), prs AS (SELECT DISTINCT product_id, profile_id FROM own)"""


def _scores_sql(base: str) -> str:
    return f"""WITH {_ENT}, o AS (SELECT p.product_id, p.profile_id, items, cat AS categorized, CASE WHEN coalesce(ws, 0) > 0 THEN s / {base} ELSE 0 END AS ov, coalesce(al, 0) AS alerts, coalesce(be, 0) AS benefits
 FROM prs p JOIN siz USING (product_id) LEFT JOIN agg ON agg.product_id = p.product_id AND agg.profile_id = p.profile_id)
SELECT product_id, profile_id, items, categorized, round(ov, 4) + 0.0 AS overall, round(categorized * 100.0::DOUBLE / greatest(items, 1), 4) AS coverage_pct, CAST(alerts AS BIGINT) AS alerts, CAST(benefits AS BIGINT) AS benefits FROM o"""


def _score_rows(t, floor: bool):
    s = Q.score_lists(entries(t), owners(t), rules_from_sales(t), floor_weight=floor)
    return s.select("product_id", "profile_id", "items", "categorized", F.round("overall", 4).alias("overall"), F.round("coverage_pct", 4).alias("coverage_pct"), "alerts", "benefits")


@query("list_scores", _scores_sql("greatest(ws, 1.0)"))
def list_scores(t):
    return _score_rows(t, True)


@query("list_scores_plain", _scores_sql("ws"))
def list_scores_plain(t):
    return _score_rows(t, False)


@query("first_alerts", f"""WITH {_ENT}, r AS (SELECT product_id, profile_id, idx, name, category, hair_type, CAST(row_number() OVER (PARTITION BY product_id, profile_id ORDER BY idx, hair_type) AS INT) AS finding_no FROM hit WHERE score <= -1)
SELECT product_id, profile_id, CAST(idx AS BIGINT) AS idx, name, category, hair_type, finding_no FROM r WHERE finding_no <= 10""")
def first_alerts(t):
    f = Q.findings(entries(t), owners(t), rules_from_sales(t))
    return f.select("product_id", "profile_id", F.col("idx").cast("long").alias("idx"), "name", "category", "hair_type", "finding_no")


@query("first_benefits", f"""WITH {_ENT}, r AS (SELECT product_id, profile_id, idx, hair_type, row_number() OVER (PARTITION BY product_id, profile_id ORDER BY idx, hair_type) AS k FROM hit WHERE score >= 1)
SELECT product_id, {N} AS n FROM r WHERE k <= 10 GROUP BY 1""")
def first_benefits(t):
    f = Q.findings(entries(t), owners(t), rules_from_sales(t), worst=False)
    return f.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


@query("alternatives", f"""WITH {_ENT}, pr AS (SELECT o_orderkey AS product_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE lower(o_orderpriority) END AS pt, CASE WHEN o_totalprice > 300000 AND o_orderpriority <> '2-HIGH' THEN 'gold' ELSE 'raw' END AS g, o_orderstatus AS st FROM orders),
pf AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 3 = 0 THEN '2-high' WHEN c_custkey % 3 = 1 THEN '3-medium' END AS want, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS without, CASE WHEN c_acctbal > 5000 THEN list_sort(list_distinct([c_mktsegment, 'MACHINERY'])) ELSE [c_mktsegment] END AS types FROM customer),
rw AS (SELECT product_id, pt, CASE WHEN g = 'gold' THEN 0 ELSE 1 END AS tier FROM pr WHERE pt IS NOT NULL AND (g = 'gold' OR st = 'F')),
tp AS (SELECT profile_id, types, want, without, CASE WHEN EXISTS (SELECT 1 FROM rw WHERE tier = 0 AND (CASE WHEN want IS NULL THEN pt <> '1-urgent' ELSE pt = want END) AND product_id IS DISTINCT FROM without) THEN 0 ELSE 1 END AS tier FROM pf),
asks AS (SELECT DISTINCT types, want, tier FROM tp), ok AS (SELECT rw.* FROM rw JOIN siz USING (product_id) WHERE items >= 3 AND cat >= 2),
ty AS (SELECT ent.product_id, hair_type, sum(score * CAST(greatest(0.2::DOUBLE, 1.0::DOUBLE - idx * 0.8::DOUBLE / greatest(n, 1)) AS DECIMAL(12,9))) AS s, sum(CAST(greatest(0.2::DOUBLE, 1.0::DOUBLE - idx * 0.8::DOUBLE / greatest(n, 1)) AS DECIMAL(12,9))) AS w FROM ent JOIN ok USING (product_id) JOIN rules USING (category) GROUP BY 1, 2),
sc AS (SELECT types, want, tier, ok.product_id, CAST(sum(s) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS score FROM asks JOIN ok USING (tier) JOIN ty ON ty.product_id = ok.product_id AND list_contains(types, hair_type) WHERE CASE WHEN want IS NULL THEN pt <> '1-urgent' ELSE pt = want END GROUP BY ALL),
few AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY types, want, tier ORDER BY round(score, 6) DESC, product_id) <= 4),
r AS (SELECT profile_id, product_id, score, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY round(score, 6) DESC, product_id) AS INT) AS rank FROM tp JOIN few ON few.types = tp.types AND few.want IS NOT DISTINCT FROM tp.want AND few.tier = tp.tier WHERE product_id IS DISTINCT FROM without)
SELECT profile_id, product_id, rank, round(score, 4) + 0.0 AS score FROM r WHERE rank <= 3""")
def alternatives(t):
    prods = t.orders.selectExpr("o_orderkey AS product_id", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE lower(o_orderpriority) END AS product_type",
                                "CASE WHEN o_totalprice > 300000 AND o_orderpriority <> '2-HIGH' THEN 'gold' ELSE 'raw' END AS gold_status", "CASE WHEN o_orderstatus = 'F' THEN 'verified_inci' END AS verification_status")
    prof = t.customer.select(
        F.col("c_custkey").alias("profile_id"), F.when(F.col("c_acctbal") > 5000, F.array("c_mktsegment", F.lit("MACHINERY"))).otherwise(F.array("c_mktsegment")).alias("hair_types"),
        F.when(F.col("c_custkey") % 3 == 0, "2-high").when(F.col("c_custkey") % 3 == 1, "3-medium").alias("want"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).alias("without"))
    a = Q.alternatives(prof, prods, entries(t), rules_from_sales(t), excluded_types=("1-urgent",), wanted_type="want", excluded_id="without")
    return a.select("profile_id", "product_id", "rank", F.round("score", 4).alias("score"))


@query("product_lists", f"""WITH {BRIDGE_SQL}, {INGREDIENTS_SQL}, b AS (SELECT product_id, position, canonical_name AS name FROM bridge JOIN ingredients USING (ingredient_id) WHERE tie <= 90)
SELECT product_id, position, name FROM b UNION ALL SELECT o_orderkey, i, CASE i WHEN 1 THEN o_orderstatus ELSE o_orderpriority END FROM orders, (SELECT unnest([1, 2])::INT AS i) WHERE o_orderkey NOT IN (SELECT product_id FROM b)""")
def product_lists(t):
    embedded = t.orders.select(F.col("o_orderkey").alias("product_id"), F.array("o_orderstatus", "o_orderpriority").alias("items"))
    return E.product_list(bridge(t).filter("tie <= 90"), ingredients(t), embedded, "product_id", "position")


@query("brand_blocks", P + f""", x AS (SELECT 'brand-' || (s_nationkey) AS brand_slug, {N} AS candidates FROM supplier WHERE s_acctbal > 0 GROUP BY 1), o AS (SELECT brand_slug, {N} AS products FROM products GROUP BY 1)
SELECT brand_slug, products, candidates, products * candidates AS pairs FROM o JOIN x USING (brand_slug)""")
def brand_blocks(t):
    ext = t.supplier.select(F.concat(F.lit("brand-"), F.col("s_nationkey").cast("string")).alias("brand_slug"), F.when(F.col("s_acctbal") > 0, F.array("s_name")).otherwise(F.array().cast("array<string>")).alias("items"))
    return K.block_by_brand(products(t), ext, "brand_slug", "items")


@query("ean_matches", P + """, e AS (SELECT CAST(1000000 + l_partkey AS VARCHAR) AS d, min(l_orderkey * 10 + l_linenumber) AS external_id FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
SELECT product_id, external_id, 1.0::DOUBLE AS score, 'auto_apply' AS action FROM products JOIN e ON regexp_replace(ean, '[^0-9]', '', 'g') = '789' || d""")
def ean_matches(t):
    ext = t.lineitem.filter("l_quantity > 30").selectExpr("l_orderkey * 10 + l_linenumber AS external_id", "'7 89.' || CAST(1000000 + l_partkey AS STRING) AS ean")
    return K.match_ean(products(t), ext, "product_id", "external_id")


def outside(t):
    """Catalogue rows as an outside source spells them."""
    name = F.concat_ws(" ", F.element_at(F.split("p_name", " "), 2), F.element_at(F.split("p_name", " "), 1), F.concat(F.col("p_size").cast("string"), F.lit("ml")))
    return t.spread("part").select(F.col("p_partkey").alias("external_id"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand_slug"), name.alias("product_name"),
                         F.when(F.col("p_type") == "LARGE", "first").otherwise("second").alias("source"), F.concat(F.lit("https://out/"), F.col("p_partkey").cast("string")).alias("source_url"))


@query("name_matches")
def name_matches(t):
    return K.match_names(products(t, spread=True), outside(t), preferred="first")


@query("matches_applied")
def matches_applied(t):
    m = K.match_names(products(t, spread=True), outside(t), preferred="first")
    p = products(t).select("product_id", "verification_status", "confidence", F.array("product_type").alias("inci_ingredients"), F.lit("jsonld").alias("extraction_method"))
    lists = outside(t).withColumn("inci_ingredients", F.split("product_name", " "))
    updated, queue, evidence = K.apply_matches(p, m, lists, "product_id", "external_id", "inci_ingredients")
    a = updated.groupBy("extraction_method").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("extraction_method", "outcome")
    b = queue.groupBy(F.concat(F.lit("queue_"), "status").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b).unionByName(evidence.groupBy("evidence_locator").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("evidence_locator", "outcome"))


@query("identified_products")
def identified_products(t):
    q = t.spread("part").select(
        F.col("p_partkey").alias("query_id"), F.when(F.col("p_size") > 25, F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("brand_slug"),
        F.when(F.col("p_size") < 10, F.concat(F.lit("789"), (F.col("p_partkey") + F.when(F.col("p_type") == "PROMO", 7).otherwise(1000000)).cast("string"))).alias("ean"),
        F.concat(F.upper(F.left("p_name", F.lit(1))), F.expr("substr(p_name, 2)"), F.lit("s")).alias("product_name_text"), F.concat(F.col("p_size").cast("string"), F.lit(" ml")).alias("volume_text"))
    return K.identify(q, products(t, spread=True))


@query("list_overlaps", r"""WITH d AS (SELECT doc_id, list_distinct(list_transform(string_split(split_part(text, chr(10), 1), ' '), lambda x: trim(regexp_replace(lower(strip_accents(x)), '\s+', ' ', 'g')))) AS a,
 list_distinct(list_transform(string_split(split_part(text, chr(10), 2), ' '), lambda x: trim(regexp_replace(lower(strip_accents(x)), '\s+', ' ', 'g')))) AS b FROM documents WHERE NOT regexp_matches(text, '\d|[-/]|kit'))
SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap, CASE WHEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.6 THEN 'confirmed' WHEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) < 0.3 THEN 'mismatch' ELSE 'possible_reformulation' END AS verdict FROM d""")
def list_overlaps(t):
    lines = F.split("text", "\n")
    d = t.documents.filter(~F.col("text").rlike(r"\d|[-/]|kit"))
    o = K.list_overlap(F.split(F.get(lines, F.lit(0)), " "), F.split(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), " "))
    return d.select("doc_id", F.round(o["overlap"], 6).alias("overlap"), o["verdict"].alias("verdict"))


@query("resolved_brands", """WITH b AS (SELECT lower(replace(p_brand, '#', '-')) AS slug, lower(p_brand) AS name FROM part GROUP BY ALL), q AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'brand-' || o_custkey WHEN 'O' THEN 'x brand#' || (o_custkey) || ' y' ELSE 'and#' || o_custkey END AS txt FROM orders),
m AS (SELECT txt, slug, CASE WHEN txt = slug OR txt = name THEN 0 ELSE 1 END AS r FROM (SELECT DISTINCT txt FROM q) JOIN b ON txt = slug OR txt = name OR contains(txt, name) OR contains(name, txt)),
k AS (SELECT txt, arg_min(slug, (r, slug)) AS slug FROM m GROUP BY 1) SELECT o_orderkey, coalesce(slug, '-') AS brand_slug FROM q LEFT JOIN k USING (txt)""")
def resolved_brands(t):
    b = t.part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand_slug"), F.col("p_brand").alias("brand_name")).distinct()
    q = t.orders.selectExpr("o_orderkey", "CASE o_orderstatus WHEN 'F' THEN 'Brand-' || CAST(o_custkey AS STRING) WHEN 'O' THEN 'x brand#' || CAST(o_custkey AS STRING) || ' y' ELSE 'and#' || CAST(o_custkey AS STRING) END AS txt")
    r = K.resolve_brand(q, b, "o_orderkey", "txt")
    return r.select("o_orderkey", F.coalesce("brand_slug", F.lit("-")).alias("brand_slug"))


@query("brands_from_urls", "SELECT page_id, CASE WHEN contains(url, 'therin') THEN 'rin' WHEN contains(url, 'blog') THEN 'log' WHEN contains(url, '.com') THEN 'com' ELSE '-' END AS brand_slug FROM pages")
def brands_from_urls(t):
    return t.pages.select("page_id", F.coalesce(K.brand_from_url("url", [("therin", "rin"), ("BLOG", "log"), (".com", "com")]), F.lit("-")).alias("brand_slug"))


_POOL = """q AS (SELECT s_suppkey AS query_id, CASE WHEN s_acctbal > 8500 THEN '789' || (1000000 + s_suppkey) END AS ean, CASE WHEN s_acctbal < 3000 THEN 'brand-' || s_nationkey END AS brand, CASE WHEN s_nationkey < 8 THEN 'red' WHEN s_nationkey < 16 THEN 'the small gear' ELSE 'big widget' END AS txt FROM supplier)"""


def _pool_queries(t):
    return t.supplier.selectExpr("s_suppkey AS query_id", "CASE WHEN s_acctbal > 8500 THEN '789' || CAST(1000000 + s_suppkey AS STRING) END AS ean", "CASE WHEN s_acctbal < 3000 THEN 'brand-' || CAST(s_nationkey AS STRING) END AS brand_slug",
                                 "CASE WHEN s_nationkey < 8 THEN 'red' WHEN s_nationkey < 16 THEN 'the small gear' ELSE 'big widget' END AS product_name_text")


@query("candidate_pools", P + f""", {_POOL} SELECT query_id, product_id FROM q JOIN products ON regexp_replace(products.ean, '[^0-9]', '', 'g') = q.ean
UNION SELECT query_id, product_id FROM q JOIN products ON contains(product_name, CASE WHEN txt = 'the small gear' THEN 'small' WHEN txt = 'big widget' THEN 'widget' ELSE '?' END) AND (brand IS NULL OR brand = brand_slug)""")
def candidate_pools(t):
    return K.candidate_pool(_pool_queries(t), products(t), "query_id", "product_id")


@query("candidate_pool_sizes", P + f""", {_POOL}, w AS (SELECT *, CASE WHEN txt = 'the small gear' THEN 'small' WHEN txt = 'big widget' THEN 'widget' END AS word FROM q)
SELECT query_id, CAST((SELECT count(*) FROM products p WHERE p.brand_slug = w.brand) AS BIGINT) AS by_brand, CAST((SELECT count(*) FROM products p WHERE regexp_replace(p.ean, '[^0-9]', '', 'g') = w.ean) AS BIGINT) AS by_ean,
 CAST((SELECT count(*) FROM products p WHERE contains(p.product_name, w.word) AND (w.brand IS NULL OR w.brand = p.brand_slug)) AS BIGINT) AS by_word FROM w""")
def candidate_pool_sizes(t):
    return K.candidate_pool_sizes(_pool_queries(t), products(t), "query_id")


_DET = "det AS (SELECT doc_id AS product_id, CASE WHEN quality = 1 THEN 'ok:' || toxic ELSE NULL END AS code FROM labels)"


def details(t):
    return t.labels.selectExpr("doc_id AS product_id", "CASE WHEN quality = 1 THEN 'ok:' || CAST(toxic AS STRING) END AS rejection_code")


@query("quarantine_list", P + f", {_DET} SELECT p.product_id, coalesce(code, '-') AS code FROM products p LEFT JOIN det USING (product_id) WHERE verification_status = 'quarantined'")
def quarantine_list(t):
    return E.quarantine_list(products(t), details(t), "product_id").select("product_id", F.coalesce("rejection_code", F.lit("-")).alias("code"))


@query("rejection_histogram", P + f", {_DET} SELECT coalesce(code, 'unknown') AS rejection_code, {N} AS n FROM det JOIN products USING (product_id) WHERE verification_status = 'quarantined' GROUP BY 1")
def rejection_histogram(t):
    return E.rejection_histogram(products(t), details(t), "product_id")


@query("review_queue_view", P + """, q AS (SELECT event_id AS review_id, CAST(floor(value * 10) AS BIGINT) AS product_id, user_id AS comparison_id, CASE WHEN event_type = 'click' THEN 'pending' ELSE 'done' END AS status FROM events)
SELECT review_id, product_id, brand_slug, coalesce(c_name, '-') AS pass_1_value FROM q JOIN products USING (product_id) LEFT JOIN customer ON c_custkey = comparison_id WHERE q.status = 'pending'""")
def review_queue_view(t):
    q = t.events.select(F.col("event_id").alias("review_id"), F.floor(F.col("value") * 10).alias("product_id"), F.col("user_id").alias("comparison_id"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"))
    comp = t.customer.selectExpr("c_custkey AS comparison_id", "c_name AS pass_1_value", "c_mktsegment AS pass_2_value", "'pending' AS resolution")
    v = E.review_queue_view(q, products(t), comp, "pending")
    return v.select("review_id", "product_id", "brand_slug", F.coalesce("pass_1_value", F.lit("-")).alias("pass_1_value"))


@query("ingredient_gaps", f"""WITH {BRIDGE_SQL}, {INGREDIENTS_SQL}, b AS (SELECT p_name AS raw, CASE WHEN p_size > 48 THEN -1 ELSE p_partkey END AS ingredient_id FROM bridge JOIN part ON p_partkey = ingredient_id)
SELECT raw, {N} AS n FROM b LEFT JOIN ingredients USING (ingredient_id) WHERE category IS NULL GROUP BY 1 ORDER BY n DESC, raw LIMIT 100""")
def ingredient_gaps(t):
    b = bridge(t).join(t.part, F.col("p_partkey") == F.col("ingredient_id")).selectExpr("p_name AS raw", "CASE WHEN p_size > 48 THEN -1 ELSE p_partkey END AS ingredient_id")
    return E.ingredient_gaps(b, ingredients(t), "raw")


@query("brand_listing", P + f""", cov AS (SELECT 'brand-' || n_nationkey AS brand_slug, CAST(n_regionkey AS BIGINT) AS discovered_total, CAST(n_regionkey AS BIGINT) AS extracted_total, CAST(0 AS BIGINT) AS verified_total, 'done' AS status FROM nation WHERE n_nationkey < 12),
live AS (SELECT brand_slug, {N} AS d, CAST(count(*) FILTER (WHERE verification_status='verified_inci') AS BIGINT) AS v FROM products GROUP BY 1),
kn AS (SELECT * FROM cov UNION ALL SELECT brand_slug, d, d, v, 'discovered' FROM live WHERE brand_slug NOT IN (SELECT brand_slug FROM cov)),
reg AS (SELECT 'brand-' || s_suppkey AS brand_slug, CASE WHEN s_acctbal > 2000 THEN 1 END AS priority, CASE WHEN s_acctbal > 5000 THEN 'blocked' END AS status FROM supplier),
al AS (SELECT * FROM kn UNION ALL SELECT brand_slug, 0, 0, 0, coalesce(status, 'registered') FROM reg WHERE priority IS NOT NULL AND brand_slug NOT IN (SELECT brand_slug FROM kn))
SELECT al.*, coalesce(reg.status, 'active') AS scope FROM al LEFT JOIN reg USING (brand_slug)""")
def brand_listing(t):
    cov = t.nation.filter("n_nationkey < 12").selectExpr("'brand-' || CAST(n_nationkey AS STRING) AS brand_slug", "CAST(n_regionkey AS BIGINT) AS discovered_total", "CAST(n_regionkey AS BIGINT) AS extracted_total", "CAST(0 AS BIGINT) AS verified_total", "'done' AS status")
    reg = t.supplier.selectExpr("'brand-' || CAST(s_suppkey AS STRING) AS brand_slug", "CASE WHEN s_acctbal > 2000 THEN 1 END AS priority", "CASE WHEN s_acctbal > 5000 THEN 'blocked' END AS status", "s_name AS notes")
    return E.brand_listing(cov, products(t), reg).drop("notes")


@query("duplicates_of_active", P + "SELECT product_id, product_url FROM products WHERE verification_status = 'quarantined' AND product_url IN (SELECT product_url FROM products WHERE verification_status <> 'quarantined')")
def duplicates_of_active(t):
    return E.dup_of_active(products(t), "product_url").select("product_id", "product_url")


_CUR = "cur AS (SELECT DISTINCT product_url FROM products WHERE price > 1000 UNION SELECT url FROM pages)"


@query("discontinued_products", P + f", {_CUR} SELECT product_id FROM products WHERE product_url NOT IN (SELECT product_url FROM cur)")
def discontinued_products(t):
    cur = products(t).filter("price > 1000").select("product_url").union(t.pages.select("url"))
    return E.discontinued(products(t), cur, "product_url").select("product_id")


@query("missing_urls", P + f", {_CUR} SELECT product_url FROM cur WHERE product_url NOT IN (SELECT product_url FROM products)")
def missing_urls(t):
    cur = products(t).filter("price > 1000").select("product_url").union(t.pages.select("url")).distinct()
    return E.missing_urls(cur, products(t), "product_url")


@query("pattern_mismatches", P + """, pat AS (SELECT 'brand-' || n_nationkey AS brand_slug, CASE WHEN n_regionkey < 3 THEN 'red|blue|small|old|hot' ELSE 'red' END AS pattern FROM nation),
j AS (SELECT product_id, brand_slug, regexp_matches(lower(product_url), pattern) AS fits FROM products JOIN pat USING (brand_slug)), s AS (SELECT brand_slug FROM j GROUP BY 1 HAVING avg(fits::INT) >= 0.5)
SELECT product_id FROM j JOIN s USING (brand_slug) WHERE NOT fits""")
def pattern_mismatches(t):
    pat = t.nation.selectExpr("'brand-' || CAST(n_nationkey AS STRING) AS brand_slug", "CASE WHEN n_regionkey < 3 THEN 'red|blue|small|old|hot' ELSE 'red' END AS pattern")
    return E.pattern_mismatch(products(t), pat, "brand_slug", "product_url").select("product_id")


@query("missing_gold_fields", P + "SELECT product_id FROM products WHERE gold_status = 'catalog' AND (NOT is_kit OR coalesce(size_volume, '') = '')")
def missing_gold_fields(t):
    return E.missing_fields(products(t), F.col("is_kit"), F.col("size_volume")).select("product_id")


@query("canonical_siblings", P + f"SELECT product_url AS canonical, {N} AS members, min(product_id) AS first_id FROM products GROUP BY 1 HAVING count(*) > 1")
def canonical_siblings(t):
    dirty = F.concat("product_url", F.when(F.col("product_id") % 2 == 0, "?utm_source=a#x").otherwise(""))
    return E.canonical_siblings(products(t).withColumn("u", dirty), "u", "product_id")


@query("compared_fields", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'auto_matched' WHEN o_orderstatus = 'O' THEN CASE WHEN abs(o_totalprice - (o_totalprice + o_custkey)) / o_totalprice <= 0.01 THEN 'auto_matched' ELSE 'pending' END ELSE 'pending' END AS resolution FROM orders""")
def compared_fields(t):
    c = F.col
    f = F.when(c("o_orderstatus") == "F", "product_name").when(c("o_orderstatus") == "O", "price").otherwise("size_volume")
    a = F.when(c("o_orderstatus") == "O", c("o_totalprice").cast("string")).otherwise(F.concat(F.lit(" A  "), "o_orderpriority"))
    b = F.when(c("o_orderstatus") == "O", (c("o_totalprice") + c("o_custkey")).cast("string")).when(c("o_orderstatus") == "F", F.concat(F.lit("a "), F.lower("o_orderpriority")))
    return t.orders.select("o_orderkey", E.compare_field(f, a, b).alias("resolution"))


@query("compared_lists")
def compared_lists(t):
    d = t.documents.select("doc_id", F.slice(F.split("text", " "), 1, 30).alias("a"), F.slice(F.split(F.regexp_replace("text", "ion", "on"), " "), 1, 30).alias("b"))
    return E.compare_lists(d, "doc_id", "a", "b")


@query("two_pass_comparison")
def two_pass_comparison(t):
    p1 = t.part.selectExpr("p_partkey AS product_id", "p_name AS product_name", "CAST(p_retailprice AS STRING) AS price", "p_name || ' of the ' || p_type || ' line by ' || p_brand AS description")
    p2 = t.part.selectExpr("p_partkey AS product_id", "upper(p_name) AS product_name", "CAST(p_retailprice * (1 + p_size / 2000) AS STRING) AS price", "p_name || ' of this ' || p_type || ' line by ' || lower(p_brand) AS description")
    comparisons, review = E.two_pass_compare(p1, p2, "product_id", ["product_name", "price", "description"])
    a = comparisons.groupBy("field_name", "resolution").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(review.groupBy("field_name", F.lit("review").alias("resolution")).agg(F.count(F.lit(1)).alias("n")))


@query("similar_documents_by_title")
def similar_documents_by_title(t):
    """Near-equal document openings of one source: the exact fuzzy join on another table."""
    d = t.documents.select(F.col("source").alias("block"), F.lower(F.left(F.regexp_replace("text", r"\s+", " "), F.lit(40))).alias("s")).distinct()
    d = staged(d.withColumn("ident", F.xxhash64("s")).select("block", "ident", F.array("s", S.sorted_words(F.col("s")), "s", S.sorted_words(F.col("s"))).alias("forms")))
    return K.similar_names(d, None, "block", 0.8, keyed=False).filter("left_id < right_id")
