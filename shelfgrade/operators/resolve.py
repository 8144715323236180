"""Entity look-ups and catalogue joins. Which side is broadcast is left to its measured size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.similarity import length_bound, sequence_ratio
from ..functions.urls import canonical_url, norm_root
from . import classify as C
from .windows import fill_down, running_sum


def resolve_ingredients(
    names: DataFrame, ingredients: DataFrame, aliases: DataFrame, name: str = "raw_name",
    ident: str = "ingredient_id", canonical: str = "canonical_name", alias: str = "alias",
) -> DataFrame:
    """(name, ingredient_id) per distinct name: same name without case, else alias, else folded name.

    The three keys of a name meet one key table in a single join; the lowest tier wins, then the
    smallest id. Names without a hit keep a null id.
    """
    distinct = names.select(F.col(name).alias("_raw")).distinct()
    table = (
        ingredients.select(F.lower(canonical).alias("_k"), F.lit(0).alias("_kind"), F.col(ident).alias("_id"))
        .unionByName(aliases.select(F.lower(alias).alias("_k"), F.lit(1).alias("_kind"), F.col(ident).alias("_id")))
        .groupBy("_k", "_kind").agg(F.min("_id").alias("_id"))
    )
    probes = distinct.select("_raw", F.explode(F.array(
        F.struct(F.lower("_raw").alias("_k"), F.lit(0).alias("_kind"), F.lit(0).alias("_tier")),
        F.struct(F.lower("_raw").alias("_k"), F.lit(1).alias("_kind"), F.lit(1).alias("_tier")),
        F.struct(T.fold("_raw").alias("_k"), F.lit(0).alias("_kind"), F.lit(2).alias("_tier")),
    )).alias("p")).select("_raw", "p.*")
    hits = probes.join(table, ["_k", "_kind"]).groupBy("_raw").agg(F.min(F.struct("_tier", "_id"))["_id"].alias(ident))
    return distinct.join(hits, "_raw", "left").select(F.col("_raw").alias(name), ident)


def product_list(bridge: DataFrame, ingredients: DataFrame, embedded: DataFrame, product: str, position: str) -> DataFrame:
    """(product, position, name) rows: the bridge where it has rows, else the embedded list.

    Rows, not arrays: a long list is spread like any other data.
    """
    normal = bridge.join(ingredients, "ingredient_id").select(product, position, F.col("canonical_name").alias("name"))
    rest = embedded.join(normal.select(product).distinct(), product, "left_anti")
    loose = rest.select(product, F.posexplode("items").alias("_p", "name")).select(
        product, (F.col("_p") + 1).cast(dict(bridge.dtypes)[position]).alias(position), "name")
    return normal.unionByName(loose)


def quarantine_list(products: DataFrame, details: DataFrame, key: str, code: str | None = None) -> DataFrame:
    """Quarantined rows with their details where there are any."""
    out = products.filter(F.col("verification_status") == "quarantined").join(details, key, "left")
    return out.filter(F.col("rejection_code") == code) if code else out


def rejection_histogram(products: DataFrame, details: DataFrame, key: str) -> DataFrame:
    q = products.filter(F.col("verification_status") == "quarantined").select(key)
    return details.join(q, key, "left_semi").groupBy(
        F.coalesce("rejection_code", F.lit("unknown")).alias("rejection_code")).agg(F.count(F.lit(1)).alias("n"))


def review_queue_view(queue: DataFrame, products: DataFrame, comparisons: DataFrame, status: str | None = None, brand: str | None = None) -> DataFrame:
    q = queue.filter(F.col("status") == status) if status else queue
    out = q.join(products.select("product_id", "brand_slug", "product_name"), "product_id").join(
        comparisons.select("comparison_id", "pass_1_value", "pass_2_value", "resolution"), "comparison_id", "left")
    return out.filter(F.col("brand_slug") == brand) if brand else out


def ingredient_gaps(bridge: DataFrame, ingredients: DataFrame, raw: str, top: int = 100) -> DataFrame:
    """Most frequent raw names whose ingredient is missing or has no category."""
    counted = bridge.groupBy(raw, "ingredient_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = counted.join(ingredients.select("ingredient_id", "category"), "ingredient_id", "left")
    open_names = joined.filter(F.col("category").isNull())
    return open_names.groupBy(raw).agg(F.sum("_n").alias("n")).orderBy(F.desc("n"), raw).limit(top)


def brand_listing(coverage: DataFrame, products: DataFrame, registry: DataFrame) -> DataFrame:
    """Coverage rows, brands seen only in products, and brands only registered with a priority."""
    cols = ["brand_slug", "discovered_total", "extracted_total", "verified_total", "status"]
    live = products.groupBy("brand_slug").agg(
        F.count(F.lit(1)).alias("discovered_total"),
        F.count_if(F.col("verification_status") == "verified_inci").alias("verified_total"),
    ).select("brand_slug", "discovered_total", F.col("discovered_total").alias("extracted_total"), "verified_total", F.lit("discovered").alias("status"))
    uncovered = live.join(coverage.select("brand_slug"), "brand_slug", "left_anti")
    known = coverage.select(cols).unionByName(uncovered.select(cols))
    zero = F.lit(0).cast("long")
    waiting = (
        registry.filter(F.col("priority").isNotNull()).join(known.select("brand_slug"), "brand_slug", "left_anti")
        .select("brand_slug", zero.alias("discovered_total"), zero.alias("extracted_total"), zero.alias("verified_total"),
                F.coalesce("status", F.lit("registered")).alias("status"))
    )
    scope = registry.select("brand_slug", F.coalesce("status", F.lit("active")).alias("scope"), "notes")
    return known.unionByName(waiting).join(scope, "brand_slug", "left").withColumn("scope", F.coalesce("scope", F.lit("active")))


def dup_of_active(products: DataFrame, url: str) -> DataFrame:
    active = products.filter(F.col("verification_status") != "quarantined").select(url).distinct()
    return products.filter(F.col("verification_status") == "quarantined").join(active, url, "left_semi")


def discontinued(products: DataFrame, current: DataFrame, url: str) -> DataFrame:
    return products.join(current.select(url), url, "left_anti")


def missing_urls(current: DataFrame, products: DataFrame, url: str) -> DataFrame:
    return current.join(products.select(url), url, "left_anti")


def pattern_mismatch(products: DataFrame, patterns: DataFrame, brand: str, url: str, min_share: float = 0.5) -> DataFrame:
    """Rows off their brand's URL pattern, for brands where at least half of the rows fit it."""
    tested = products.join(patterns, brand).withColumn("_fits", F.regexp_like(F.lower(url), F.col("pattern")))
    share = tested.groupBy(brand).agg(F.avg(F.col("_fits").cast("int")).alias("_share")).filter(F.col("_share") >= min_share)
    return tested.filter(~F.col("_fits")).join(share, brand).drop("_fits", "_share")


def missing_fields(products: DataFrame, has_list: Column, usage: Column) -> DataFrame:
    """Catalogue rows that lack the list or the usage text."""
    return products.filter((F.col("gold_status") == "catalog") & (~has_list | (F.coalesce(usage, F.lit("")) == "")))


def canonical_siblings(rows: DataFrame, url: str, key: str) -> DataFrame:
    """Canonical URLs held by several rows."""
    return (
        rows.withColumn("canonical", canonical_url(url)).filter(F.col("canonical").isNotNull())
        .groupBy("canonical").agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("first_id"))
        .filter(F.col("members") > 1)
    )


def compare_field(field: Column, a: Column, b: Column, similarity: Column | None = None, near: float = 0.90) -> Column:
    """auto_matched or pending for one field of two extraction passes.

    ``similarity`` is consulted for long texts only; leave it out to require equality there.
    """
    na, nb = T.norm_ws(a), T.norm_ws(b)
    p1, p2 = a.try_cast("double"), b.try_cast("double")
    price_ok = F.coalesce(((p1 == 0) & (p2 == 0)) | ((p1 > 0) & (F.abs(p1 - p2) / F.nullif(p1, F.lit(0.0)) <= 0.01)), F.lit(False))

    def bare(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, "^https?://", ""), "/+$", "")

    alike = F.lit(False) if similarity is None else F.coalesce(similarity >= near, F.lit(False))
    same = C.first_match([
        (a.isNull() & b.isNull(), F.lit(True)), (a.isNull() | b.isNull(), F.lit(False)), (field == "price", price_ok),
        (na == nb, F.lit(True)), (field.isin("description", "composition", "care_usage") & alike, F.lit(True)),
        ((field == "image_url_main") & (bare(na) == bare(nb)), F.lit(True)),
    ], F.lit(False))
    return F.when(same, "auto_matched").otherwise("pending")


def compare_lists(rows: DataFrame, key: str, a: str, b: str, near: float = 0.85) -> DataFrame:
    """(key, same, mismatches): lists of one length whose unequal pairs are all similar enough.

    Only unequal pairs that could still reach the bar go to the Python similarity.
    """
    na, nb = (F.transform(F.col(c), T.norm_ws) for c in (a, b))
    zipped = rows.select(key, (F.size(a) == F.size(b)).alias("_len"), F.greatest(F.size(a), F.size(b)).alias("_max"),
                         F.explode_outer(F.arrays_zip(na.alias("x"), nb.alias("y"))).alias("z"))
    pairs = zipped.select(key, "_len", "_max", F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    unsure = pairs.filter(F.col("_len") & (F.col("x") != F.col("y")) & (length_bound(F.col("x"), F.col("y")) >= near))
    ratios = unsure.select("x", "y").distinct().withColumn("_r", sequence_ratio("x", "y"))
    scored = pairs.join(ratios, ["x", "y"], "left")
    bad = F.when(F.col("_len"), (F.col("x") != F.col("y")) & (F.coalesce("_r", F.lit(0.0)) < near)).otherwise(F.lit(True))
    out = scored.groupBy(key).agg(
        F.count_if(F.coalesce(bad, F.lit(False)) & F.col("_len")).alias("_bad"), F.bool_and("_len").alias("_len"), F.max("_max").alias("_max"))
    return out.select(key, (F.col("_len") & (F.col("_bad") == 0)).alias("same"),
                      F.when(F.col("_len"), F.col("_bad")).otherwise(F.col("_max").cast("long")).alias("mismatches"))


def two_pass_compare(pass1: DataFrame, pass2: DataFrame, key: str, fields: list[str], long_texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(comparison rows, review rows) of two passes over the same products."""
    def long(df: DataFrame, out: str) -> DataFrame:
        return df.unpivot([key], fields, "field_name", out)

    both = long(pass1.select(key, *[F.col(f).cast("string") for f in fields]), "pass_1_value").join(
        long(pass2.select(key, *[F.col(f).cast("string") for f in fields]), "pass_2_value"), [key, "field_name"])
    a, b, f = F.col("pass_1_value"), F.col("pass_2_value"), F.col("field_name")
    if long_texts:
        x, y = T.norm_ws(a), T.norm_ws(b)
        need = f.isin("description", "composition", "care_usage") & (x != y) & (length_bound(x, y) >= 0.90)
        texts = both.filter(need).select(x.alias("_x"), y.alias("_y")).distinct().withColumn("_sim", sequence_ratio("_x", "_y"))
        both = both.withColumns({"_x": x, "_y": y}).join(texts, ["_x", "_y"], "left").drop("_x", "_y")
        resolved = compare_field(f, a, b, F.col("_sim"))
    else:
        resolved = compare_field(f, a, b)
    comparisons = both.withColumn("resolution", resolved).select(
        F.sha2(F.concat_ws("|", F.col(key).cast("string"), f), 256).alias("comparison_id"), key, "field_name", "pass_1_value", "pass_2_value", "resolution")
    review = comparisons.filter(F.col("resolution") == "pending").select(
        F.sha2(F.concat(F.lit("review|"), F.col("comparison_id")), 256).alias("review_id"), key, "comparison_id", "field_name", F.lit("pending").alias("status"))
    return comparisons, review


def merge_brand_sheets(national: DataFrame, international: DataFrame, principal: DataFrame, chunk_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Three brand sheets into (brands, entry points).

    National rows come first, international ones add slugs not yet present. The principal sheet lists a
    brand once and its entry points below it: the name is filled down by row number, brands get a
    running priority in sheet order, and their site and notes override. Column names: national
    (brand_name, site, has_list), international (brand_name, country, site), principal (row_no,
    brand_name, site, entry, notes).
    """
    def slugged(df: DataFrame) -> DataFrame:
        return df.filter(F.trim("brand_name") != "").withColumn("brand_name", F.trim("brand_name")).withColumn(
            "brand_slug", T.slugify("brand_name")).filter(F.col("brand_slug") != "")

    nat = slugged(national).select("brand_slug", "brand_name", "site", F.lit("Brasil").alias("country"), F.when(
        F.coalesce("has_list", F.lit("")) != "", F.concat(F.lit("inci_on_site="), F.col("has_list"))).alias("notes"), F.lit(0).alias("_rank"))
    intl = slugged(international).select("brand_slug", "brand_name", "site", "country", F.lit(None).cast("string").alias("notes"), F.lit(1).alias("_rank"))
    base = nat.unionByName(intl).groupBy("brand_slug").agg(
        F.min_by(F.struct("brand_name", "site", "country", "notes"), F.struct("_rank", "brand_name")).alias("b")).select("brand_slug", "b.*")
    filled = fill_down(
        principal.withColumn("_head", F.nullif(F.trim("brand_name"), F.lit(""))), "row_no", "_head", F.floor(F.col("row_no") / chunk_rows))
    rows = filled.filter(F.col("_head").isNotNull()).withColumn("brand_slug", T.slugify("_head"))
    heads = rows.filter(F.nullif(F.trim("brand_name"), F.lit("")).isNotNull())
    # The last heading row of a brand carries the priority, as a later row overwrites an earlier one.
    order = heads.groupBy("brand_slug").agg(
        F.max("row_no").alias("_at"), F.max_by("site", F.when(F.col("site").isNotNull(), F.col("row_no"))).alias("p_site"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("row_no"))).alias("p_notes"), F.min_by("_head", "row_no").alias("p_name"))
    numbers = running_sum(
        heads.select("row_no", F.lit(1).alias("_one")), ["_one"], [F.col("row_no")], F.floor(F.col("row_no") / chunk_rows),
        F.lit(1), "priority").select("row_no", "priority")
    ranked = order.join(numbers, order["_at"] == numbers["row_no"]).drop("row_no", "_at")
    entry = F.when(F.startswith("entry", F.lit("http")), F.trim("entry")).when(
        F.startswith("site", F.lit("http")) & F.nullif(F.trim("brand_name"), F.lit("")).isNotNull(), F.trim("site"))
    entries = rows.select("brand_slug", entry.alias("entrypoint")).filter(F.col("entrypoint").isNotNull()).distinct()
    brands = base.join(ranked, "brand_slug", "full").select(
        "brand_slug", F.coalesce("brand_name", "p_name").alias("brand_name"),
        F.trim(F.coalesce("p_site", "site", F.lit(""))).alias("official_url_root"), "country",
        F.coalesce("p_notes", "notes").alias("notes"), "priority")
    return brands, entries


def dedupe_brands_by_url(brands: DataFrame, entries: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Brands with one root URL become one: the first with a priority wins, else the first.

    The winner takes over the entry points, and country and notes where it has none.
    """
    root = norm_root("official_url_root")
    d = brands.withColumn("_key", F.when(root != "", root).otherwise(F.concat(F.lit("slug:"), F.col("brand_slug"))))
    rank = F.struct(F.when(F.col("priority").isNotNull(), 0).otherwise(1).alias("a"), F.col(order).alias("b"))

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)

    merged = d.groupBy("_key").agg(
        F.min_by(F.struct("brand_slug", "brand_name", "official_url_root", "priority"), rank).alias("w"),
        first("country"), first("notes"), F.count(F.lit(1)).alias("merged"))
    winner = d.select("brand_slug", "_key").join(merged.select("_key", F.col("w.brand_slug").alias("_win")), "_key")
    moved = entries.join(winner, "brand_slug").select(F.col("_win").alias("brand_slug"), "entrypoint").distinct()
    return merged.select("w.*", "country", "notes", "merged"), moved
