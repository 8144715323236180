"""Reports: one pass over the rows each, conditional counts instead of one query per number."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .windows import top_k

def _n() -> Column:
    return F.count(F.lit(1))


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part * 100 / F.greatest(whole, F.lit(1)), digits)


def status_counts(products: DataFrame, *keys: str) -> DataFrame:
    s = F.col("verification_status")
    return products.groupBy(*keys).agg(
        _n().alias("total"), F.count_if(s == "verified_inci").alias("verified"),
        F.count_if(s == "catalog_only").alias("catalog_only"), F.count_if(s == "quarantined").alias("quarantined"))


def canonical_counts(products: DataFrame, foreign: str = "non_hair") -> DataFrame:
    """Six counts per brand in one pass; hidden rows out, foreign rows counted apart, kits inside."""
    inside = F.coalesce(F.col("product_category") != foreign, F.lit(True))
    s = F.col("verification_status")
    return products.filter(~F.col("is_hidden")).groupBy("brand_slug").agg(
        F.count_if(inside).alias("total"), F.count_if(inside & (s == "verified_inci")).alias("verified"),
        F.count_if(inside & (s == "catalog_only")).alias("catalog_only"),
        F.count_if(inside & (s == "quarantined")).alias("quarantined"),
        F.count_if(inside & F.col("is_kit")).alias("kits"), F.count_if(~inside).alias("non_domain"))


def brand_quality(products: DataFrame, has_labels: Column) -> DataFrame:
    def share(cond: Column, name: str) -> Column:
        return _pct(F.count_if(cond), _n()).alias(name)

    return products.groupBy("brand_slug").agg(
        _n().alias("products"), F.round(F.avg("confidence"), 2).alias("avg_confidence"),
        share(F.coalesce("description", F.lit("")) != "", "description_pct"),
        share(F.col("image_url_main").isNotNull(), "image_pct"),
        share(F.coalesce("product_category", F.lit("")) != "", "category_pct"), share(has_labels, "labels_pct"))


def avg_list_size(bridge: DataFrame, products: DataFrame, product: str, brand: str) -> DataFrame:
    per_product = bridge.groupBy(product).agg(_n().alias("items"))
    return per_product.join(products.select(product, brand), product).groupBy(brand).agg(
        _n().alias("products"), F.round(F.avg("items"), 4).alias("avg_items"))


def dashboard_kpis(products: DataFrame, foreign: str = "non_hair") -> DataFrame:
    def filled(col: str) -> Column:
        return F.coalesce(F.col(col), F.lit("")) != ""

    s = F.col("verification_status")
    return products.agg(
        _n().alias("total_products"), F.count_if(F.col("status_editorial") == "pendente").alias("pending_review"),
        F.count_if(s == "quarantined").alias("quarantined"),
        F.count_if(F.col("status_publicacao") == "publicado").alias("published"),
        F.round(F.avg("confidence"), 1).alias("avg_confidence"),
        _pct(F.count_if(filled("product_category") & (F.col("product_category") != foreign)), _n()).alias("category_pct"),
        _pct(F.count_if(filled("description")), _n()).alias("description_pct"),
        _pct(F.count_if(F.col("image_url_main").isNotNull()), _n()).alias("image_pct"),
        _pct(F.count_if(filled("size_volume")), _n()).alias("volume_pct"),
        _pct(F.count_if(s == "verified_inci"), _n()).alias("list_coverage"))


def list_summary(products: DataFrame) -> DataFrame:
    s = F.col("verification_status")
    return products.groupBy("brand_slug").agg(
        _n().alias("total"), F.count_if(s == "catalog_only").alias("pending"), F.count_if(s == "verified_inci").alias("verified"),
    ).withColumn("pct", _pct(F.col("verified"), F.col("total")))


def coverage_report(coverage: DataFrame) -> DataFrame:
    """One line per brand and a TOTAL line, from a rollup."""
    return coverage.rollup("brand_slug").agg(
        F.sum("extracted_total").alias("extracted"), F.sum("verified_total").alias("verified"), F.grouping("brand_slug").alias("_g"),
    ).select(
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("brand_slug")).alias("brand_slug"), "extracted", "verified",
        F.round(F.when(F.col("extracted") > 0, F.col("verified") / F.col("extracted")).otherwise(0.0), 4).alias("rate"))


def run_report(runs: DataFrame, products: DataFrame) -> DataFrame:
    """Per brand: the run's own numbers, or numbers from the products where no run exists."""
    live = status_counts(products, "brand_slug").select(
        "brand_slug", F.col("total").alias("extracted"), "verified", "catalog_only", "quarantined", F.lit("products").alias("basis"))
    own = runs.select("brand_slug", "extracted", "verified", "catalog_only", "quarantined", F.lit("run").alias("basis"))
    both = own.unionByName(live.join(own, "brand_slug", "left_anti"))

    def rate(c: str) -> Column:
        return F.round(F.when(F.col("extracted") > 0, F.col(c) / F.col("extracted")).otherwise(0.0), 4)

    return both.withColumns({"verified_rate": rate("verified"), "failure_rate": rate("quarantined")})


def seal_histogram(df: DataFrame, detected: str, inferred: str) -> DataFrame:
    return df.select(F.explode(F.concat(detected, inferred)).alias("seal")).groupBy("seal").agg(_n().alias("n"))


def products_with_seal(df: DataFrame, seal: str, detected: str, inferred: str) -> DataFrame:
    return df.filter(F.array_contains(detected, seal) | F.array_contains(inferred, seal))


def audit_summary(events: DataFrame, ok: str, fail: str, kind: str = "event_type") -> DataFrame:
    n_ok, n_fail = F.count_if(F.col(kind) == ok), F.count_if(F.col(kind) == fail)
    return events.agg(_n().alias("total"), n_ok.alias("ok"), n_fail.alias("failed")).withColumn(
        "fail_rate_pct", F.when(F.col("ok") + F.col("failed") > 0, F.round(F.col("failed") * 100 / (F.col("ok") + F.col("failed")), 1)))


def top_actions(events: DataFrame, kind: str, n: int = 10) -> DataFrame:
    return events.groupBy(F.coalesce(kind, F.lit("unknown")).alias("action")).agg(_n().alias("n")).orderBy(F.desc("n"), "action").limit(n)


def global_stats(products: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: rows, brands and the mean of the brands' rates."""
    a = products.agg(F.lit(1).alias("_k"), _n().alias("products"), F.countDistinct("brand_slug").alias("brands"))
    b = coverage.agg(F.lit(1).alias("_k"), F.round(F.avg("verified_rate"), 4).alias("mean_rate"))
    return a.join(b, "_k").drop("_k")


def gold_funnel(evaluated: DataFrame, *keys: str) -> DataFrame:
    """Tier counts and rows that one field keeps from gold. ``evaluated`` has gold_status and blockers."""
    g = F.col("gold_status")
    errors = F.size(F.array_distinct(F.transform(
        F.filter("blockers", lambda b: b["severity"] == "error"), lambda b: b["field"])))
    return evaluated.groupBy(*keys).agg(
        _n().alias("total"), F.count_if(g == "gold").alias("gold"), F.count_if(g == "gold_candidate").alias("gold_candidate"),
        F.count_if(g == "catalog").alias("catalog"), F.count_if(g == "raw").alias("raw"),
        F.count_if(g == "gold_rejected").alias("gold_rejected"),
        F.count_if((g == "catalog") & (errors == 1)).alias("one_field_away"),
    ).withColumn("gold_rate", F.round(F.col("gold") / F.greatest("total", F.lit(1)), 4))


def gold_gaps(evaluated: DataFrame) -> DataFrame:
    """Rows below gold per blocked field."""
    open_rows = evaluated.filter(~F.col("gold_status").isin("gold", "gold_rejected"))
    return open_rows.select(F.explode(F.array_distinct(F.transform("blockers", lambda b: b["field"]))).alias("field")).groupBy("field").agg(_n().alias("n"))


def catalog_snapshot(products: DataFrame, *keys: str) -> DataFrame:
    def share(c: str) -> Column:
        return _pct(F.count_if(~T.is_empty_value(c)), _n(), 2).alias(f"{c}_pct")

    s = F.col("verification_status")
    return products.groupBy(*keys).agg(
        _n().alias("total"), F.count_if(s == "catalog_only").alias("catalog_only"), F.count_if(s == "verified_inci").alias("verified"),
        F.count_if(s == "quarantined").alias("quarantined"), share("price"), share("description"), share("size_volume"),
        share("product_category"))


def ingredient_usage(ingredients: DataFrame, bridge: DataFrame, ident: str = "ingredient_id") -> DataFrame:
    used = bridge.groupBy(ident).agg(_n().alias("_n"))
    return ingredients.join(used, ident, "left").withColumn("usage", F.coalesce("_n", F.lit(0))).drop("_n")


def list_audit(products: DataFrame, audit_class: Column, brand: str = "brand_slug") -> DataFrame:
    c = F.col("_c")
    return products.withColumn("_c", audit_class).groupBy(brand).agg(
        _n().alias("total"), F.count_if(c == "already_verified").alias("already_verified"),
        F.count_if(c == "extracted_rejected").alias("extracted_rejected"),
        F.count_if(c == "extraction_missed").alias("extraction_missed"),
        F.count_if(c == "no_inci_on_page").alias("no_inci_on_page"),
    ).withColumn("recoverable", F.col("extracted_rejected") + F.col("extraction_missed"))


def audit_samples(products: DataFrame, audit_class: Column, brand: str, url: str, n: int = 3) -> DataFrame:
    d = products.withColumn("audit_class", audit_class).filter(F.col("audit_class") != "already_verified")
    return top_k(d.select(brand, "audit_class", url), [brand, "audit_class"], [F.col(url)], n, "sample_no")


def distribution(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) for several classifications; array columns count each value."""
    def tagged(dim: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(dim).alias("dimension"), v.alias("value")))

    entries = F.flatten(F.array(*[tagged(dim, values) for dim, values in cols.items()]))
    return df.select(F.explode(entries).alias("e")).groupBy("e.dimension", "e.value").agg(_n().alias("n"))


def label_report(df: DataFrame, detected: str, inferred: str) -> DataFrame:
    d, i = F.size(detected) > 0, F.size(inferred) > 0
    return df.agg(_n().alias("total"), F.count_if(d).alias("with_detected"), F.count_if(i).alias("with_inferred"),
                  F.count_if(d & i).alias("with_both"), F.count_if(d | i).alias("with_any"))


def rollout_report(before: DataFrame, after: DataFrame, key: str = "brand_slug") -> DataFrame:
    b, a = before.select(key, F.col("gold").alias("gold_before")), after.select(key, F.col("gold").alias("gold_after"))
    return b.join(a, key, "full").select(
        key, F.coalesce("gold_before", F.lit(0)).alias("gold_before"), F.coalesce("gold_after", F.lit(0)).alias("gold_after"),
        (F.coalesce("gold_after", F.lit(0)) - F.coalesce("gold_before", F.lit(0))).alias("delta"))


def feedback_summary(feedback: DataFrame, rating: Column) -> DataFrame:
    up, down = F.count_if(rating == "up"), F.count_if(rating == "down")
    return feedback.agg(up.alias("up"), down.alias("down")).withColumn(
        "useful_pct", F.when(F.col("up") + F.col("down") > 0, F.round(F.col("up") * 100 / (F.col("up") + F.col("down")), 1)))


def conversation_list(messages: DataFrame, thread: str, turn: str) -> DataFrame:
    return messages.groupBy(thread).agg(_n().alias("messages"), F.max(turn).alias("last_turn"))


def repeat_questions(messages: DataFrame, text: str) -> DataFrame:
    return messages.groupBy(T.query_hash(text).alias("query_hash")).agg(_n().alias("n")).filter(F.col("n") > 1)


def brands_with_at_least(products: DataFrame, n: int, brand: str = "brand_slug") -> DataFrame:
    return products.groupBy(brand).agg(_n().alias("n")).filter(F.col("n") >= n)


def value_counts(df: DataFrame, col: Column, name: str) -> DataFrame:
    return df.groupBy(col.alias(name)).agg(_n().alias("n"))


def category_rules_view(rules: DataFrame) -> DataFrame:
    """Rules per category as one ordered text; the rule table is a small dimension."""
    line = F.concat("hair_type", F.lit("="), F.col("score").cast("string"))
    return rules.groupBy("category").agg(_n().alias("rules"), F.array_join(F.sort_array(F.collect_list(line)), ", ").alias("listing"))


def ingredient_catalog(ingredients: DataFrame, bridge: DataFrame, search: str | None, ident: str, name: str) -> DataFrame:
    hits = ingredients.filter(F.contains(F.lower(name), F.lit(search.lower()))) if search else ingredients
    counts = bridge.groupBy(ident).agg(_n().alias("_n"))
    return hits.join(counts, ident, "left").withColumn("product_count", F.coalesce("_n", F.lit(0))).drop("_n")


def call_ledger(calls: DataFrame, budget: int, tokens_in: Column, tokens_out: Column) -> DataFrame:
    return calls.agg(_n().alias("calls"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out")).withColumn(
        "remaining", F.greatest(F.lit(0), F.lit(budget) - F.col("calls")))


def source_stats(df: DataFrame, source: str, scraped: Column, with_list: Column) -> DataFrame:
    return df.groupBy(source).agg(
        _n().alias("discovered"), F.count_if(scraped).alias("scraped"), F.count_if(scraped & with_list).alias("with_list"),
        F.count_if(~scraped).alias("skipped"))


def multi_axis_counts(products: DataFrame) -> DataFrame:
    """Counts by brand, by status, by category, by brand and status, and in total, in one pass."""
    b, s, c = F.col("brand_slug"), F.col("verification_status"), F.col("product_category")
    sets = [[b], [s], [c], [b, s], []]
    return products.groupingSets(sets, b, s, c).agg(F.grouping_id().alias("level"), _n().alias("n"))


def approx_profile(products: DataFrame, name: str, url: str, number: str) -> DataFrame:
    return products.agg(
        _n().alias("n"), F.approx_count_distinct(name).alias("names"), F.approx_count_distinct(url).alias("urls"),
        F.percentile_approx(number, [0.25, 0.5, 0.75], 10_000).alias("_p"),
    ).select("n", "names", "urls", F.col("_p")[0].alias("p25"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p75"))


def profile_sketches(products: DataFrame, by: list[str], name: str, url: str, number: str) -> DataFrame:
    """One row per group with its count and sketches of its distinct names and addresses and of its numbers' distribution.

    Sketches of any rows can be merged, so stored ones serve every coarser grouping and only new rows have to be read.
    """
    return products.groupBy(*by).agg(
        _n().alias("n"), F.hll_sketch_agg(name, 14).alias("names"), F.hll_sketch_agg(url, 14).alias("urls"), F.kll_sketch_agg_double(F.col(number).cast("double"), 400).alias("numbers"))


def merged_profile(sketches: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Counts, distinct counts and quantiles of any coarser grouping, from sketches alone; without ``by`` in total. Quantiles of no number are null."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("names").alias("_names"), F.hll_union_agg("urls").alias("_urls"), F.kll_merge_agg_double("numbers").alias("_numbers"))
    some = F.kll_sketch_get_n_double("_numbers") > 0
    return merged.select(
        *by, "n", F.hll_sketch_estimate("_names").alias("names"), F.hll_sketch_estimate("_urls").alias("urls"),
        *[F.when(some, F.kll_sketch_get_quantile_double("_numbers", F.lit(r))).alias(f"p{round(100 * r)}") for r in ranks])


def document_totals(docs: DataFrame, text: str) -> DataFrame:
    chars = F.sum(F.length(text))
    return docs.agg(_n().alias("documents"), chars.alias("chars"), F.sum(F.floor(F.length(text) / 4)).alias("token_estimate"))


# --- lists, pages, search -------------------------------------------------------------------

def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def list_products(
    products: DataFrame, brand: str | None = None, verified_only: bool = False, search: str | None = None,
    category: str | None = None, exclude_kits: bool = False, include_hidden: bool = False, foreign: str = "non_hair",
) -> DataFrame:
    """The filters of a product listing; order and page it with :func:`page`."""
    d = products
    if brand:
        d = d.filter(F.col("brand_slug") == brand)
    if verified_only:
        d = d.filter(F.col("verification_status") == "verified_inci")
    if category:
        d = d.filter(F.col("product_category") == category)
    else:
        d = d.filter(F.coalesce(F.col("product_category") != foreign, F.lit(True)))
    if exclude_kits:
        d = d.filter(~F.col("is_kit"))
    if not include_hidden:
        d = d.filter(~F.col("is_hidden"))
    if search:
        needle = F.lit(search.lower())
        d = d.filter(F.contains(F.lower("product_name"), needle) | F.coalesce(F.contains(F.lower("description"), needle), F.lit(False)))
    return d


def gap_filter(gap: str, has_list: Column) -> Column:
    """Condition of one of the ten data-gap filters."""
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    gaps = {
        "no_list": lambda: ~has_list, "no_description": lambda: blank("description"),
        "no_category": lambda: F.col("product_category").isNull(), "no_price": lambda: F.col("price").isNull(),
        "no_volume": lambda: F.col("size_volume").isNull(), "no_function": lambda: F.col("function_objective").isNull(),
        "no_hair_type": lambda: F.col("hair_type").isNull(), "no_ph": lambda: F.col("ph").isNull(),
        "not_gold": lambda: F.col("gold_status") != "gold", "gold_candidate": lambda: F.col("gold_status") == "gold_candidate",
    }
    return gaps[gap]()


def low_confidence(products: DataFrame, n: int = 20) -> DataFrame:
    bad = products.filter((F.col("confidence") < 50) & (F.col("verification_status") != "quarantined"))
    return bad.orderBy("confidence", "product_id").limit(n)


def review_candidates(products: DataFrame, categories: list[str], kind: str | None = None) -> DataFrame:
    d = products.filter((F.col("verification_status") != "quarantined") & (
        F.coalesce(F.col("product_category").isin(categories), F.lit(False)) | (F.col("verification_status") == "verified_inci")))
    weak, open_ = F.col("confidence") < 50, F.col("status_editorial").isin("pendente", "rejeitado")
    return d.filter({"low_confidence": weak, "pending_editorial": open_}.get(kind or "", weak | open_))


def gold_pool(products: DataFrame, hair_type: str | None = None, function: str | None = None, category: str | None = None) -> DataFrame:
    d = products.filter(F.col("gold_status") == "gold")
    if hair_type:
        d = d.filter(F.array_contains("hair_type", hair_type))
    if function:
        d = d.filter(F.col("function_objective") == function)
    return d.filter(F.col("product_category") == category) if category else d


def enrichable_brands(products: DataFrame) -> DataFrame:
    return products.filter(F.col("gold_status") == "catalog").groupBy("brand_slug").agg(_n().alias("n")).orderBy(F.desc("n"), "brand_slug")


def next_wave(registry: DataFrame, counts: DataFrame, recipes: DataFrame, skip: DataFrame, size: int) -> DataFrame:
    """Brands to process next: four buckets from tier, product count and recipe; bucket, then slug order."""
    live = registry.filter(~F.coalesce(F.col("status").isin("out_of_scope", "blocked", "no_source"), F.lit(False))).join(
        skip.select("brand_slug"), "brand_slug", "left_anti")
    d = live.join(counts.select("brand_slug", F.col("n").alias("_n")), "brand_slug", "left").join(
        recipes.select("brand_slug", F.lit(True).alias("_r")).distinct(), "brand_slug", "left")
    n, recipe = F.coalesce("_n", F.lit(0)), F.coalesce("_r", F.lit(False))
    easy, medium = F.col("tier") == "tier_1_easy", F.col("tier") == "tier_2_medium"
    bucket = (
        F.when(medium & recipe & (n == 0), 1).when(easy & (n > 0) & (n < 10), 2)
        .when(medium & ~recipe & (n == 0), 3).when(easy & recipe & (n == 0), 4))
    return d.withColumns({"bucket": bucket, "needs_recipe": ~recipe}).filter(F.col("bucket").isNotNull()).select(
        "brand_slug", "tier", "bucket", "needs_recipe").orderBy("bucket", "brand_slug").limit(size)


#: Columns of the joint audit log and their types.
AUDIT_COLUMNS = {"log": "string", "event_id": "string", "event_type": "string", "email": "string", "user_id": "string", "target_type": "string", "target_id": "string",
                 "detail": "string", "created_at": "timestamp", "event_date": "date"}


def audit_log(**logs: tuple[DataFrame, dict[str, Column | str]]) -> DataFrame:
    """One typed table of several logs (sign-ins, actions of administrators, retrievals ...): each is a table and its columns by their joint
    names. What a log does not have is null; the date follows from the time unless the log is stored by date.
    """
    def typed(log: str, df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
        got = {n: c if isinstance(c, Column) else F.col(c) for n, c in columns.items()} | {"log": F.lit(log)}
        got.setdefault("event_date", F.to_date(got["created_at"]))
        return df.select(*[got.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in AUDIT_COLUMNS.items()])

    return reduce(DataFrame.unionByName, [typed(log, *spec) for log, spec in logs.items()])


def audit_search(
    events: DataFrame, ts: str, user: Column | None = None, kind: Column | None = None, since: str | None = None,
    until: str | None = None, limit: int | None = None, tie: str = "event_id", date: str | None = None, target: Column | None = None,
) -> DataFrame:
    """Newest events first. Where the log is stored by the column ``date``, times also bound the dates, so that only their folders are read."""
    d = events
    for cond in (user, kind, target):
        d = d.filter(cond) if cond is not None else d
    for bound, cond in ((since, lambda c, x: c >= x), (until, lambda c, x: c <= x)):
        if bound:
            at = F.lit(bound).cast("timestamp")
            d = d.filter(cond(F.col(ts), at))
            d = d.filter(cond(F.col(date), at.cast("date"))) if date else d
    d = d.orderBy(F.desc(ts), F.desc(tie))
    return d if limit is None else d.limit(limit)


def history(revisions: DataFrame, entity: str, field: str | None = None) -> DataFrame:
    d = revisions.filter(F.col("entity_id") == entity)
    return (d.filter(F.col("field_name") == field) if field else d).orderBy("created_at")


def newest(df: DataFrame, keys: list[str], when: str, tie: str, n: int) -> DataFrame:
    """Newest n rows of each group, e.g. the evidence of a product."""
    return top_k(df, keys, [F.col(when).desc(), F.col(tie).desc()], n)


def product_detail(products: DataFrame, evidence: DataFrame, key: str, issues: Column, cap: int = 50) -> DataFrame:
    """Each product with its issue report and its newest evidence, at most ``cap`` entries as shown on a page."""
    recent = newest(evidence, [key], "extracted_at", "evidence_id", cap).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "field_name", "raw_source_text"))).alias("evidence"))
    return products.withColumn("issues", issues).join(recent, key, "left")


def conversation_detail(messages: DataFrame, thread: str, turn: str) -> DataFrame:
    """Messages in reading order, one per row; range-partitioned, so a long thread splits."""
    return messages.orderBy(thread, turn)


def product_ingredients_view(bridge: DataFrame, ingredients: DataFrame, product: str, position: str) -> DataFrame:
    return bridge.join(ingredients, "ingredient_id", "left").orderBy(product, position)
