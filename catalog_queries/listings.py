"""Listing and search queries: filters, order, pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.operators import reports as R

from .base import BRIDGE_SQL, DESCRIBED_SQL, INGREDIENTS_SQL, PRODUCTS_SQL, bridge, ingredients, products, query

P = f"WITH {PRODUCTS_SQL} "
PD = f"WITH {DESCRIBED_SQL} "
_VIS = "NOT is_hidden AND coalesce(product_category <> 'non_hair', true)"


@query("product_listing", P + f"SELECT product_id, product_name FROM products WHERE {_VIS} AND NOT is_kit ORDER BY product_id LIMIT 100 OFFSET 100")
def product_listing(t):
    return R.page(R.list_products(products(t), exclude_kits=True).select("product_id", "product_name"), [F.col("product_id")], 100, 100)


@query("product_search", PD + f"SELECT product_id, product_name FROM products WHERE {_VIS} AND (contains(lower(product_name), 'widget') OR contains(lower(description), 'widget'))")
def product_search(t):
    return R.list_products(products(t, True), search="widget").select("product_id", "product_name")


@query("verified_listing", P + f"SELECT product_id, brand_slug FROM products WHERE {_VIS} AND verification_status='verified_inci' AND brand_slug='brand-7'")
def verified_listing(t):
    return R.list_products(products(t), brand="brand-7", verified_only=True).select("product_id", "brand_slug")


@query("category_listing", P + "SELECT product_id FROM products WHERE NOT is_hidden AND product_category='promo'")
def category_listing(t):
    return R.list_products(products(t), category="promo").select("product_id")


@query("hidden_products", P + "SELECT product_id, product_name FROM products WHERE is_hidden")
def hidden_products(t):
    return R.list_products(products(t), include_hidden=True, foreign="").filter("is_hidden").select("product_id", "product_name")


_GAPS = {"no_category": "product_category IS NULL", "no_price": "price IS NULL", "no_volume": "size_volume IS NULL",
         "not_gold": "gold_status <> 'gold'", "gold_candidate": "gold_status = 'gold_candidate'", "no_list": "NOT is_kit"}


def _gap(name: str, cond: str):
    @query(f"gap_{name}", P + f"SELECT product_id, confidence FROM products WHERE verification_status <> 'quarantined' AND {cond}")
    def run(t):
        return products(t).filter((F.col("verification_status") != "quarantined") & R.gap_filter(name, F.col("is_kit"))).select("product_id", "confidence")


for _name, _cond in _GAPS.items():
    _gap(_name, _cond)


@query("gap_no_description", PD + "SELECT product_id, confidence FROM products WHERE verification_status <> 'quarantined' AND coalesce(description,'') = ''")
def gap_no_description(t):
    return products(t, True).filter((F.col("verification_status") != "quarantined") & R.gap_filter("no_description", F.lit(True))).select("product_id", "confidence")


@query("low_confidence_products", P + "SELECT product_id, confidence FROM products WHERE confidence < 50 AND verification_status <> 'quarantined' ORDER BY confidence, product_id LIMIT 20")
def low_confidence_products(t):
    return R.low_confidence(products(t)).select("product_id", "confidence")


@query("recent_activity", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_activity(t):
    return R.audit_search(t.events, "ts", limit=20).select("event_id", "event_type")


_CATS = "('promo','large','small')"


@query("review_candidates", P + f"""SELECT product_id, status_editorial FROM products WHERE verification_status <> 'quarantined'
 AND (coalesce(product_category IN {_CATS}, false) OR verification_status='verified_inci') AND (status_editorial IN ('pendente','rejeitado') OR confidence < 50)""")
def review_candidates(t):
    return R.review_candidates(products(t), ["promo", "large", "small"]).select("product_id", "status_editorial")


@query("review_candidates_pending", P + f"""SELECT product_id FROM products WHERE verification_status <> 'quarantined'
 AND (coalesce(product_category IN {_CATS}, false) OR verification_status='verified_inci') AND status_editorial IN ('pendente','rejeitado')""")
def review_candidates_pending(t):
    return R.review_candidates(products(t), ["promo", "large", "small"], "pending_editorial").select("product_id")


@query("gold_pool", P + "SELECT product_id, product_name FROM products WHERE gold_status='gold' AND contains(product_name, 'red') AND product_category='promo'")
def gold_pool(t):
    p = products(t).withColumn("hair_type", F.split("product_name", " "))
    return R.gold_pool(p, hair_type="red", category="promo").select("product_id", "product_name")


@query("next_wave", P + """, r AS (SELECT s_suppkey, 'brand-' || s_suppkey AS brand_slug, CASE WHEN s_acctbal < 4000 THEN 'tier_1_easy' ELSE 'tier_2_medium' END AS tier, CASE WHEN s_acctbal > 9000 THEN 'blocked' ELSE 'active' END AS status FROM supplier),
c AS (SELECT brand_slug, count(*) AS n FROM products WHERE price > 1095 GROUP BY 1), rec AS (SELECT 'brand-' || n_nationkey * 3 AS brand_slug FROM nation),
x AS (SELECT r.brand_slug, tier, coalesce(n, 0) AS n, rec.brand_slug IS NOT NULL AS recipe FROM r LEFT JOIN c USING (brand_slug) LEFT JOIN rec ON rec.brand_slug = r.brand_slug
 WHERE status NOT IN ('out_of_scope','blocked','no_source') AND r.brand_slug NOT IN (SELECT 'brand-' || r_regionkey FROM region)),
b AS (SELECT brand_slug, tier, CASE WHEN tier='tier_2_medium' AND recipe AND n=0 THEN 1 WHEN tier='tier_1_easy' AND n > 0 AND n < 10 THEN 2
 WHEN tier='tier_2_medium' AND NOT recipe AND n=0 THEN 3 WHEN tier='tier_1_easy' AND recipe AND n=0 THEN 4 END AS bucket, NOT recipe AS needs_recipe FROM x)
SELECT brand_slug, tier, bucket, needs_recipe FROM b WHERE bucket IS NOT NULL ORDER BY bucket, brand_slug LIMIT 40""")
def next_wave(t):
    reg = t.supplier.selectExpr("'brand-' || CAST(s_suppkey AS STRING) AS brand_slug", "CASE WHEN s_acctbal < 4000 THEN 'tier_1_easy' ELSE 'tier_2_medium' END AS tier",
                                "CASE WHEN s_acctbal > 9000 THEN 'blocked' ELSE 'active' END AS status")
    counts = products(t).filter("price > 1095").groupBy("brand_slug").agg(F.count(F.lit(1)).alias("n"))
    recipes = t.nation.selectExpr("'brand-' || CAST(n_nationkey * 3 AS STRING) AS brand_slug")
    skip = t.region.selectExpr("'brand-' || CAST(r_regionkey AS STRING) AS brand_slug")
    return R.next_wave(reg, counts, recipes, skip, 40)


@query("audit_search", """WITH l AS (SELECT 'auth' AS log, CAST(event_id AS VARCHAR) AS event_id, event_type, 'u' || user_id || '@x.com' AS email, CAST(NULL AS VARCHAR) AS target_id, ts FROM events WHERE event_type IN ('signup', 'error')
 UNION ALL SELECT 'admin', CAST(event_id AS VARCHAR), 'grant', 'a' || user_id % 7 || '@x.com', 'u' || user_id, ts FROM events WHERE event_type = 'purchase'
 UNION ALL SELECT 'retrieval', CAST(event_id AS VARCHAR), event_type, NULL, NULL, ts FROM events WHERE event_type IN ('click', 'view'))
SELECT log, event_id, event_type, coalesce(email, '-') AS email, coalesce(target_id, '-') AS target_id, strftime(ts, '%Y-%m-%d') AS day FROM l
WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND (email IN ('u8@x.com', 'a1@x.com') OR event_type IN ('click', 'error'))""")
def audit_search(t):
    e = t.events.withColumns({"ts": F.col("ts").cast("timestamp"), "who": F.concat(F.lit("u"), F.col("user_id").cast("string"))})
    mail = lambda c: F.concat(c, F.lit("@x.com"))
    log = R.audit_log(
        auth=(e.filter("event_type in ('signup', 'error')"), {"event_id": "event_id", "event_type": "event_type", "email": mail(F.col("who")), "user_id": "who", "created_at": "ts"}),
        admin=(e.filter("event_type = 'purchase'"), {"event_id": "event_id", "event_type": F.lit("grant"), "email": mail(F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string"))), "target_id": "who", "created_at": "ts"}),
        retrieval=(e.filter("event_type in ('click', 'view')"), {"event_id": "event_id", "event_type": "event_type", "created_at": "ts"}))
    found = R.audit_search(log, "created_at", user=F.col("email").isin("u8@x.com", "a1@x.com") | F.col("event_type").isin("click", "error"), since="2024-01-10", until="2024-01-20", date="event_date")
    return found.select("log", "event_id", "event_type", F.coalesce("email", F.lit("-")).alias("email"), F.coalesce("target_id", F.lit("-")).alias("target_id"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("newest_errors", """SELECT event_id, user_id FROM events WHERE event_type='error' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def newest_errors(t):
    return R.audit_search(t.events, "ts", kind=F.col("event_type") == "error", since="2024-01-10", until="2024-01-20", limit=100).select("event_id", "user_id")


@query("entity_history", "SELECT event_id, event_type FROM events WHERE user_id = 8 AND event_type = 'click'")
def entity_history(t):
    rev = t.events.selectExpr("event_id", "event_type", "CAST(user_id AS STRING) AS entity_id", "event_type AS field_name", "ts AS created_at")
    return R.history(rev, "8", "click").select("event_id", "event_type")


@query("newest_evidence", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events)
SELECT user_id, event_id, CAST(rk AS INT) AS rank FROM r WHERE rk <= 50""")
def newest_evidence(t):
    return R.newest(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 50).select("user_id", "event_id", "rank")


@query("conversation_detail", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def conversation_detail(t):
    return R.conversation_detail(t.conversations.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars")), "conv_id", "turn")


@query("product_ingredients_view", f"""WITH {BRIDGE_SQL}, {INGREDIENTS_SQL} SELECT product_id, position, canonical_name, coalesce(category, '?') AS category FROM bridge LEFT JOIN ingredients USING (ingredient_id)""")
def product_ingredients_view(t):
    v = R.product_ingredients_view(bridge(t), ingredients(t), "product_id", "position")
    return v.select("product_id", "position", "canonical_name", F.coalesce("category", F.lit("?")).alias("category"))


@query("product_detail", P + """, e AS (SELECT l_partkey AS product_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) AS rn, l_quantity FROM lineitem),
s AS (SELECT product_id, CAST(count(*) AS INT) AS shown FROM e WHERE rn <= 5 GROUP BY 1)
SELECT p.product_id, coalesce(shown, 0) AS shown, CAST((price IS NOT NULL AND currency IS NULL)::INT + (product_type IS NULL)::INT + (image_url_main IS NULL)::INT AS INT) AS issues FROM products p LEFT JOIN s USING (product_id)""")
def product_detail(t):
    from shelfgrade.operators.validate import field_issues

    ev = t.lineitem.selectExpr("l_partkey AS product_id", "l_shipdate AS extracted_at", "l_orderkey * 10 + l_linenumber AS evidence_id", "l_returnflag AS field_name",
                               "CAST(l_quantity AS STRING) AS raw_source_text")
    issues = field_issues(name="product_name", price="price", currency="currency", image="image_url_main", ptype="product_type")
    d = R.product_detail(products(t), ev, "product_id", issues, 5)
    return d.select("product_id", F.coalesce(F.size("evidence"), F.lit(0)).alias("shown"), F.size("issues").alias("issues"))
