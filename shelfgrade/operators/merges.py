"""Merges, change capture and set operations over snapshots.

An update is a function of (old snapshot, batch) that returns the new snapshot. The joins are on
unique keys; nothing is collected.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.lists import DEFAULT_RULES, ListRules, tokens_of, validate_list
from ..functions.urls import canonical_url
from ..vocab import market as M
from . import classify as C
from .validate import FIELD_RULES, FieldRules, real_usage
from .windows import best_row, fill_first_image, fill_from_evidence, pick_master

# How each product column merges.
TEXT_FIELDS = ["description", "usage_instructions", "composition", "care_usage"]
LIST_FIELDS = ["inci_ingredients", "verification_status", "confidence", "extraction_method"]


def _both(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full join of two snapshots as (key, o, n): the sides stay whole structs, null when absent."""
    o = old.select(key, F.struct(*old.columns).alias("o"))
    n = new.select(key, F.struct(*new.columns).alias("n"))
    return o.join(n, key, "full")


def _filled(c: Column, dtype: str) -> Column:
    """Truthiness of the merge rules: empty texts, lists and zero do not count as a value."""
    if dtype == "string":
        return F.coalesce(c, F.lit("")) != ""
    if dtype.startswith("array"):
        return F.coalesce(F.size(c), F.lit(0)) > 0
    return c.isNotNull()


def better_text(old: Column, new: Column, junk: list[str] = M.JUNK_VALUES, min_len: int = 10) -> Column:
    """New text unless it is empty, junk or short; old junk always gives way, even to nothing."""
    o, n = (T.strip_ws(F.lower(F.coalesce(x, F.lit("")))) for x in (old, new))
    weak = (F.coalesce(new, F.lit("")) == "") | n.isin(junk) | (F.length(n) < min_len)
    return F.when(o.isin(junk), new).when(weak, old).otherwise(new)


def merge_never_downgrade(
    old: DataFrame, new: DataFrame, key: str = "product_url", texts: Sequence[str] = TEXT_FIELDS,
    lists: Sequence[str] = LIST_FIELDS, keep_not_null: Sequence[str] = ("price",), ident: str = "product_id",
    always_new: Sequence[str] = ("gender_target", "extracted_at"), junk: list[str] = M.JUNK_VALUES,
) -> DataFrame:
    """New snapshot: a verified list survives an extraction without one, texts only improve.

    Columns follow the old snapshot; a column missing from the batch keeps its old value.
    """
    types = dict(old.dtypes)
    j = _both(old, new, key)
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    first = lists[0]
    keep_list = (
        _filled(o(first), types[first]) & (o("verification_status") == "verified_inci") & ~_filled(n(first), types[first]))
    merged = [F.col(key)]
    for c in old.columns:
        if c == key:
            continue
        if c not in new.columns:
            merged.append(o(c).alias(c))
            continue
        if c == ident:
            value = F.coalesce(o(c), n(c))
        elif c in lists:
            value = F.when(F.coalesce(keep_list, F.lit(False)), o(c)).otherwise(n(c))
        elif c in texts:
            value = better_text(o(c), n(c), junk)
        elif c in keep_not_null:
            value = F.coalesce(n(c), o(c))
        elif c in always_new:
            value = n(c)
        else:
            value = F.when(_filled(n(c), types[c]), n(c)).otherwise(o(c))
        merged.append(
            F.when(F.col("n").isNull(), o(c)).when(F.col("o").isNull(), n(c)).otherwise(value).alias(c))
    return j.select(*merged).select(old.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Batch rows replace rows of the same key, apart from the columns in ``keep``."""
    o = old.alias("o")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    there = F.col("n._n").isNotNull()
    j = o.join(new.withColumn("_n", F.lit(1)).alias("n"), cond, "full")
    cols = []
    for c in old.columns:
        if c in keys or c in keep:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in new.columns:
            cols.append(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}").alias(c))
    return j.select(*cols)


def upsert_quarantine(details: DataFrame, gated: DataFrame, key: str = "product_id") -> DataFrame:
    """One detail row per quarantined product; the first failed check is the code."""
    new = gated.filter(F.col("gate.status") == "quarantined").select(
        key, F.col("gate.reason").alias("rejection_reason"), F.try_element_at(F.col("gate.failed"), F.lit(1)).alias("rejection_code"),
        F.lit("pending").alias("review_status"))
    return upsert(details, new, [key], keep=("rejection_code", "review_status"))


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the batch rows whose key is new; of equal batch keys the first row by value enters."""
    fresh = batch.join(target.select(*keys), list(keys), "left_anti")
    one = best_row(fresh, keys, [F.xxhash64(*batch.columns), F.to_json(F.struct(*batch.columns))])
    return target.unionByName(one.select(target.columns))


def import_products(target: DataFrame, batch: DataFrame, ident: str, url: str) -> DataFrame:
    """Batch rows meet target rows by id, else by URL. Verified rows stay; others are overwritten; the rest is new."""
    by_id = batch.join(target.select(F.col(ident), F.col(ident).alias("_t")), ident, "left")
    by_url = target.select(F.col(url).alias("_u"), F.col(ident).alias("_t2"))
    met = by_id.join(by_url, by_id[url] == by_url["_u"], "left").withColumn("_at", F.coalesce("_t", "_t2", ident))
    one = best_row(met.drop("_t", "_u", "_t2"), ["_at"], [F.col(ident)])
    j = target.select(F.col(ident).alias("_at"), F.struct(*target.columns).alias("o")).join(
        one.select("_at", F.struct(*batch.columns).alias("n")), "_at", "full")
    locked = F.col("n").isNull() | F.coalesce(F.col("o.verification_status") == "verified_inci", F.lit(False))
    return j.select(*[
        (F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c == ident else F.when(locked, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c)
        for c in target.columns])


def patch_rows(target: DataFrame, updates: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Sparse updates by key; null means untouched; columns off the allow-list are ignored."""
    fields = [c for c in allowed if c in updates.columns]
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in fields])
    j = target.join(u, key, "left")
    return j.select(*[F.coalesce(f"_u_{c}", c).alias(c) if c in fields else F.col(c) for c in target.columns])


def union_discovery(found: DataFrame, url: str, rank: str, blocked: Sequence[str] = ()) -> DataFrame:
    """Union of discovery sources: the first source of each URL, without blocked tokens."""
    one = best_row(found, [url], [F.col(c) for c in [rank, *[c for c in found.columns if c not in (url, rank)]]])
    return one.filter(~T.contains_any(F.lower(url), [b.lower() for b in blocked])) if blocked else one


def token_overlap(a: Column, b: Column) -> Column:
    """``struct<accept, share_b, share_a>`` of two lists by their tokens."""
    ta, tb = tokens_of(a), tokens_of(b)
    common = F.size(F.array_intersect(ta, tb))
    sa, sb = F.try_divide(common, F.size(ta)), F.try_divide(common, F.size(tb))
    accept = ((sb >= 0.9) & (F.size(ta) >= F.size(tb))) | ((sb >= 0.7) & (sa >= 0.7))
    return F.struct(F.coalesce(accept, F.lit(False)).alias("accept"), sb.alias("share_b"), sa.alias("share_a"))


def normalize_ingredients(
    rows: DataFrame, ingredients: DataFrame, aliases: DataFrame, product: str, position: str, raw: str
) -> tuple[DataFrame, DataFrame]:
    """(bridge, ingredients): raw names resolved by name, then alias; unknown names become new entities.

    New ids are hashes of the lower-cased name, so a re-run creates the same rows. The bridge keeps the
    first position of each entity.
    """
    names = rows.select(F.trim(raw).alias("_raw")).filter(F.col("_raw") != "").distinct().withColumn("_k", F.lower("_raw"))
    by_name = ingredients.groupBy(F.lower("canonical_name").alias("_k")).agg(F.min("ingredient_id").alias("_a"))
    by_alias = aliases.groupBy(F.lower("alias").alias("_k")).agg(F.min("ingredient_id").alias("_b"))
    made = F.concat(F.lit("n-"), F.substring(F.sha2("_k", 256), 1, 32))
    mapped = names.join(by_name, "_k", "left").join(by_alias, "_k", "left").withColumn(
        "ingredient_id", F.coalesce("_a", "_b", made))
    fresh = mapped.filter(F.col("_a").isNull() & F.col("_b").isNull()).groupBy("ingredient_id").agg(
        F.min("_raw").alias("canonical_name"))
    extra = [c for c in ingredients.columns if c not in ("ingredient_id", "canonical_name")]
    grown = ingredients.unionByName(fresh.select(
        "ingredient_id", "canonical_name", *[F.lit(None).cast(dict(ingredients.dtypes)[c]).alias(c) for c in extra]))
    bridge = rows.withColumn("_raw", F.trim(raw)).join(mapped.select("_raw", "ingredient_id"), "_raw").groupBy(product, "ingredient_id").agg(
        F.min(position).alias(position), F.min_by("_raw", F.struct(position, "_raw")).alias("raw_name"))
    return bridge, grown


def normalize_claims(df: DataFrame, key: str, detected: str, inferred: str, confidence: str) -> tuple[DataFrame, DataFrame]:
    """(product claims, claims): detected seals come from keywords, inferred ones from the list."""
    entries = F.concat(
        F.transform(F.col(detected), lambda s: F.struct(s.alias("claim"), F.lit("keyword").alias("source"))),
        F.transform(F.col(inferred), lambda s: F.struct(s.alias("claim"), F.lit("inci_inference").alias("source"))))
    links = df.select(key, F.explode(entries).alias("e"), F.col(confidence).alias("confidence_score")).select(key, "e.claim", "e.source", "confidence_score")
    claims = links.select("claim").distinct().select(
        "claim", T.title_case_claim("claim").alias("display_name"), F.lit("seal").alias("category"))
    return links, claims


def normalize_images(df: DataFrame, key: str, main: str, gallery: str) -> DataFrame:
    """Main image at position 0, gallery images from 1 on."""
    entries = F.concat(
        F.when(F.coalesce(F.col(main), F.lit("")) != "", F.array(F.struct(
            F.col(main).alias("url"), F.lit("main").alias("image_type"), F.lit(0).alias("position")))).otherwise(F.array()),
        F.filter(F.transform(F.coalesce(F.col(gallery), F.array().cast("array<string>")), lambda u, i: F.struct(
            T.strip_ws(u).alias("url"), F.lit("gallery").alias("image_type"), (i + 1).alias("position"))), lambda e: e["url"] != ""))
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.*")


def normalize_compositions(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(text), F.lit("")) != "").select(
        key, F.lit("Composição").alias("section_label"), F.col(text).alias("content"))


def replace_evidence(evidence: DataFrame, fresh: DataFrame, key: str, kinds: Column) -> DataFrame:
    """Old evidence of the given kinds goes for every key in the batch; the batch comes in."""
    touched = fresh.select(key).distinct().withColumn("_t", F.lit(True))
    kept = evidence.join(touched, key, "left").filter(~(F.coalesce("_t", F.lit(False)) & kinds)).drop("_t")
    return kept.unionByName(fresh.select(evidence.columns))


def sync_coverage(counts: DataFrame, old: DataFrame) -> DataFrame:
    """Fresh rollup with a change flag; ``last_run`` moves only when count or rate moved."""
    rate = F.round(F.when(F.col("total") > 0, F.col("verified") / F.col("total")).otherwise(0.0), 4)
    new = counts.withColumn("rate", rate).select("brand_slug", "total", "verified", "rate")
    o = old.select("brand_slug", F.col("total").alias("_t"), F.col("rate").alias("_r"), F.col("last_run").alias("_l"))
    changed = (F.coalesce("_t", F.lit(0)) != F.coalesce("total", F.lit(0))) | (
        F.abs(F.coalesce("_r", F.lit(0.0)) - F.coalesce("rate", F.lit(0.0))) > 1e-4)
    return new.join(o, "brand_slug", "full").select(
        "brand_slug", F.coalesce("total", "_t").alias("total"), "verified", F.coalesce("rate", "_r").alias("rate"),
        F.coalesce("_t", F.lit(0)).alias("previous_total"), (changed & F.col("total").isNotNull()).alias("changed"),
        F.when(changed & F.col("total").isNotNull(), F.current_timestamp()).otherwise(F.col("_l")).alias("last_run"))


def diff_revisions(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], source: str = "system") -> DataFrame:
    """One row per changed field of rows on both sides; null-safe comparison."""
    def texts(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select(key, *[T.serialize_value(F.col(f), kinds[f].startswith(("array", "map", "struct"))).alias(f) for f in fields])

    j = texts(old).alias("o").join(texts(new).alias("n"), key)
    entries = F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.col(f"o.{f}").alias("old_value"), F.col(f"n.{f}").alias("new_value")) for f in fields])
    return j.select(key, F.explode(F.filter(entries, lambda e: ~e["old_value"].eqNullSafe(e["new_value"]))).alias("e")).select(
        F.col(key).alias("entity_id"), "e.*", F.lit(source).alias("change_source"))


def review_transition(products: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Editorial and publication state after start, approve, correct or reject.

    The old publication state stays available for the revision rows, since the input is not changed.
    """
    d = F.col("decision")
    j = products.join(decisions.select(key, "decision", "reviewer"), key, "left")
    return j.withColumns({
        "status_editorial": F.when(d == "start", "em_revisao").when(d == "approve", "aprovado").when(d == "correct", "corrigido")
        .when(d == "reject", "rejeitado").otherwise(F.col("status_editorial")),
        "status_publicacao": F.when(d == "approve", "publicado").otherwise(F.col("status_publicacao")),
        "assigned_to": F.when(d == "start", F.col("reviewer")).when(d.isNotNull(), F.lit(None)).otherwise(F.col("assigned_to")),
    }).drop("decision", "reviewer")


def unknown_ids(batch: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """Ids of a batch that no product has; a batch with any is refused as a whole."""
    return batch.join(products.select(key), key, "left_anti")


def batch_status(products: DataFrame, batch: DataFrame, key: str, column: str, value: str) -> DataFrame:
    hit = batch.select(key).distinct().withColumn("_h", F.lit(True))
    return products.join(hit, key, "left").withColumn(
        column, F.when(F.coalesce("_h", F.lit(False)), F.lit(value)).otherwise(F.col(column))).drop("_h")


def apply_edit(products: DataFrame, edits: DataFrame, key: str, items: str, rules: ListRules = DEFAULT_RULES) -> DataFrame:
    """Manual list edits: verified only when the list validates, otherwise catalog_only."""
    j = products.join(edits.select(key, F.col(items).alias("_items")), key, "left")
    edited = F.col("_items").isNotNull()
    ok = validate_list(F.col("_items"), False, rules)["valid"]
    return j.withColumns({
        items: F.coalesce("_items", items),
        "verification_status": F.when(edited & ok, "verified_inci").when(edited, "catalog_only").otherwise(F.col("verification_status")),
        "extraction_method": F.when(edited, "manual").otherwise(F.col("extraction_method")),
    }).drop("_items")


def _leading(url: str, key: str) -> Column:
    """Order of the copies of one canonical URL: the row already at that URL, then the smallest key."""
    return F.struct(F.when(F.col(url) == F.col("_u"), 0).otherwise(1).alias("a"), F.col(key).alias("b"))


def _canonical_rows(products: DataFrame, url: str) -> DataFrame:
    return products.withColumn("_u", canonical_url(url)).filter(F.col("_u").isNotNull() & ~C.listing_page(F.col(url)))


def merge_duplicates(products: DataFrame, key: str, url: str, scalars: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(merged products, old id -> kept id) by canonical URL; listing pages go.

    Each scalar takes the first filled value of the copies, the leading copy first. Every aggregate
    keeps one value per task, so a URL with very many copies is no burden.
    """
    types = dict(products.dtypes)
    d, order = _canonical_rows(products, url), _leading(url, key)

    def first_filled(c: str) -> Column:
        filled = F.coalesce(T.strip_ws(F.col(c)), F.lit("")) != "" if types[c] == "string" else _filled(F.col(c), types[c])
        return F.min_by(c, F.when(filled, order)).alias(c)

    base = d.groupBy("_u").agg(
        F.min_by(key, order).alias(key), F.count(F.lit(1)).alias("members"), *[first_filled(c) for c in scalars])
    mapping = d.select("_u", F.col(key).alias("old_id")).join(
        base.select("_u", F.col(key).alias("kept_id")), "_u").select("old_id", "kept_id")
    return base.withColumnRenamed("_u", url), mapping


def merge_duplicate_lists(products: DataFrame, key: str, url: str, items: str) -> DataFrame:
    """Ordered union of the copies' lists as rows: (url, value, first_at); sort by ``first_at``."""
    d = _canonical_rows(products, url)
    at = F.struct(_leading(url, key).alias("copy"), F.col("pos"))
    return d.select("*", F.posexplode(items).alias("pos", "value")).groupBy("_u", "value").agg(
        F.min(at).alias("first_at")).withColumnRenamed("_u", url)


def rekey(children: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Children follow their merged parents."""
    m = mapping.select(F.col("old_id").alias(key), "kept_id")
    return children.join(m, key, "left").withColumn(key, F.coalesce("kept_id", key)).drop("kept_id")


def merge_ingredients(
    ingredients: DataFrame, bridge: DataFrame, usage: str, preferred: dict[str, str] = M.PREFERRED_NAMES,
    ident: str = "ingredient_id", name: str = "canonical_name", product: str = "product_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old -> master mapping, re-pointed bridge, aliases). Groups by curated name, else by folded name."""
    curated = C.map_values(T.fold(name), {M.plain(k): v for k, v in preferred.items()})
    d = ingredients.withColumn("_g", F.coalesce(curated, T.fold(name)))
    masters = pick_master(d, "_g", F.col(name) == F.col("_g"), usage, name, ident)
    mapping = d.join(masters, "_g").select(F.col(ident), "master_id", F.col(name).alias("alias"))
    moved = bridge.join(mapping.select(ident, "master_id"), ident).groupBy(product, "master_id").agg(F.min("position").alias("position"))
    aliases = mapping.filter(F.col(ident) != F.col("master_id")).select("alias", "master_id")
    return mapping.select(ident, "master_id"), moved, aliases


# Fixed values: (LIKE pattern, minimum length) of sentences stored as ingredient names.
SENTENCE_LIKE = [
    ("combinado %", 0), ("% dos ingredientes%", 0), ("com um %", 0), ("a arte %", 0), ("protagonista %", 0),
    ("as frutas %", 0), ("como %", 16), ("com %", 21), ("o %", 21), ("as %", 16), ("os %", 16), ("um %", 0),
    ("uma %", 0), ("para %", 16), ("que %", 0), ("no %", 16), ("% se destacam%", 0), ("% ressalta%", 0),
    ("% origem natural%", 0), ("% design %", 0), ("%aplicar%", 0), ("%enxaguar%", 0), ("%massagear%", 0),
    ("%embalagem%", 0), ("%informações%", 16), ("%conservar%", 0), ("%não ingerir%", 0),
    ("%fora do alcance%", 0), ("%prazo de validade%", 0), ("%registro anvisa%", 0), ("Ingredientes:%", 0),
    ("Ingredientes %", 0), ("%.%:%", 51), ("%.", 4),
]


def sentence_name(name: Column | str, likes: Sequence[tuple[str, int]] = SENTENCE_LIKE) -> Column:
    n = T._c(name)
    cond = F.length(F.trim(n)) < 2
    for pattern, least in likes:
        cond = cond | (n.like(pattern) & (F.length(n) >= least))
    return cond


def clean_ingredients(
    ingredients: DataFrame, likes: Sequence[tuple[str, int]] = SENTENCE_LIKE, ident: str = "ingredient_id", name: str = "canonical_name"
) -> tuple[DataFrame, DataFrame]:
    """(kept entities, old -> kept mapping): sentences go, case and trailing-dot variants merge into the smallest id."""
    good = ingredients.filter(~sentence_name(name, likes)).withColumn("_k", F.regexp_replace(F.trim(F.lower(name)), r"\.+$", ""))
    kept = good.groupBy("_k").agg(F.min(ident).alias("kept_id"))
    mapping = good.join(kept, "_k").select(ident, "kept_id")
    return good.join(mapping.filter(F.col(ident) == F.col("kept_id")).select(ident), ident, "left_semi").drop("_k"), mapping


def cascade_delete(children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    ids = gone.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in children.items()}


def backfill_usage(products: DataFrame, rules: FieldRules = FIELD_RULES) -> DataFrame:
    """Empty usage takes the care text when that reads like instructions."""
    empty = F.coalesce(T.strip_ws("usage_instructions"), F.lit("")) == ""
    take = empty & real_usage("care_usage", rules)
    return products.withColumns({
        "usage_instructions": F.when(take, T.strip_ws("care_usage")).otherwise(F.col("usage_instructions")), "backfilled": take})


def _loose(a: Column, b: Column, least: int) -> Column:
    return (a == b) | ((F.length(a) > least) & (F.length(b) > least) & (F.contains(a, b) | F.contains(b, a)))


def autoresolve(queue: DataFrame) -> DataFrame:
    """Resolution of pending review items, in layers; null stays pending.

    Input: current, pass_1_value, pass_2_value, field_name, current_items, pass_2_items, newest (flag).
    """
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\W+", "")
    cur, p1, p2 = (bare(c) for c in ("current", "pass_1_value", "pass_2_value"))
    moved = ~_loose(cur, p1, 20)
    ck, pk = T.alnum_key("current"), T.alnum_key("pass_2_value")
    same_text = (ck != "") & (pk != "") & ((ck == pk) | ((F.length(ck) > 30) & (F.contains(ck, pk) | F.contains(pk, ck))))
    l1, l2 = (F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("pass_1_value", "pass_2_value"))
    longer = ((l2 == 0) & (l1 > 50)) | ((l2 > 0) & (l1 > 2 * l2) & (l1 > 200))
    overlap = token_overlap(F.col("current_items"), F.col("pass_2_items"))["accept"]
    return queue.withColumn("resolution", C.first_match([
        (moved & _loose(cur, p2, 20), F.lit("auto_resolved_pass2")), (moved, F.lit("auto_resolved_post_fix")),
        ((F.col("field_name") == "inci_ingredients") & F.coalesce(overlap, F.lit(False)), F.lit("kept_pass_1")),
        (same_text, F.lit("kept_pass_1")),
        (T.is_empty_value("current") & ~T.is_empty_value("pass_2_value"), F.lit("accepted_pass_2")),
        (longer, F.lit("kept_longer")), (~F.col("newest"), F.lit("superseded")),
    ]))


def quarantine_backlog(products: DataFrame, name: str, url: str, relevance: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, details) after re-judging active rows by name and URL only."""
    verdict = C.domain_relevance(name, url) if relevance is None else relevance
    d = products.withColumn("_v", verdict)
    off = (F.col("verification_status") != "quarantined") & ~F.col("_v.relevant")
    details = d.filter(off).select(
        "product_id", F.col("_v.reason").alias("rejection_reason"), F.substring_index("_v.reason", ":", 1).alias("rejection_code"),
        F.lit("pending").alias("review_status"))
    return d.withColumn("verification_status", F.when(off, "quarantined").otherwise(F.col("verification_status"))).drop("_v"), details


def gap_fill(products: DataFrame, evidence: DataFrame, images: DataFrame, keywords: dict[str, str], key: str = "product_id") -> DataFrame:
    """Volume, category, description and image from what the row, its evidence and its images hold."""
    d = fill_from_evidence(products, evidence, key, "description")
    d = fill_first_image(d, images, key, "image_url_main", "image_urls_gallery")
    return d.withColumns({
        "size_volume": F.coalesce("size_volume", T.extract_volume("product_name", "description")),
        "product_category": F.coalesce("product_category", C.category_by_keyword("product_name", keywords))})


def sync_categories(ingredients: DataFrame, updates: DataFrame) -> DataFrame:
    """Categories by name without case; ``_updated`` marks the rows an update reached."""
    u = updates.groupBy(F.lower("canonical_name").alias("_k")).agg(F.max("category").alias("_c"))
    return ingredients.withColumn("_k", F.lower("canonical_name")).join(u, "_k", "left").withColumns({
        "updated": F.col("_c").isNotNull(), "category": F.coalesce("_c", "category")}).drop("_k", "_c")


def delete_brand(tables: dict[str, DataFrame], products: DataFrame, brand: str, key: str) -> dict[str, DataFrame]:
    gone = products.filter(F.col("brand_slug") == brand).select(key)
    kept = {"products": products.filter(F.col("brand_slug") != brand)}
    return {**kept, **cascade_delete(tables, gone, key)}


def registry_crud(registry: DataFrame, changes: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, refusals) for a batch with at most one change per slug.

    Creation needs a new slug, a name and an http root; a brand with products cannot be deleted.
    """
    have = registry.select("brand_slug", F.lit(True).alias("_have"))
    used = products.select("brand_slug", F.lit(True).alias("_used")).distinct()
    c = changes.join(have, "brand_slug", "left").join(used, "brand_slug", "left")
    there, busy = F.coalesce("_have", F.lit(False)), F.coalesce("_used", F.lit(False))
    bad = C.first_match([
        ((F.col("op") == "create") & there, F.lit("exists")), ((F.col("op") != "create") & ~there, F.lit("unknown")),
        ((F.col("op") == "create") & (F.coalesce(F.trim("brand_name"), F.lit("")) == ""), F.lit("name_missing")),
        (F.col("official_url_root").isNotNull() & (F.col("op") != "delete") & ~F.col("official_url_root").rlike("^https?://"), F.lit("bad_url")),
        ((F.col("op") == "delete") & busy, F.lit("has_products")),
    ])
    judged = c.withColumn("refusal", bad).drop("_have", "_used")
    ok = judged.filter(F.col("refusal").isNull())
    kept = registry.join(ok.filter(F.col("op") == "delete").select("brand_slug"), "brand_slug", "left_anti")
    fields = [x for x in registry.columns if x != "brand_slug" and x in changes.columns]
    patched = patch_rows(kept, ok.filter(F.col("op") == "patch").select("brand_slug", *fields), "brand_slug", fields)
    born = ok.filter(F.col("op") == "create").select(*[
        F.col(x) if x in changes.columns else F.lit(None).cast(dict(registry.dtypes)[x]).alias(x) for x in registry.columns])
    return patched.unionByName(born), judged.filter(F.col("refusal").isNotNull()).select("brand_slug", "op", "refusal")


def fill_missing(products: DataFrame, found: DataFrame, second: DataFrame, key: str, rules: FieldRules = FIELD_RULES) -> DataFrame:
    """Fill an empty list or usage text: a value found on the page first, then a second-pass value.

    Values count only after validation; filled cells are never cleared.
    """
    f = found.select(key, F.col("items").alias("_i1"), F.col("usage").alias("_u1"))
    s = second.select(key, F.col("items").alias("_i2"), F.col("usage").alias("_u2"))
    j = products.join(f, key, "left").join(s, key, "left")

    def good_list(c: str) -> Column:
        v = validate_list(F.col(c), False, rules.lists)
        return F.when(F.coalesce(v["valid"], F.lit(False)), v["cleaned"])

    need_list = F.coalesce(F.size("inci_ingredients"), F.lit(0)) <= 0
    need_use = F.coalesce(T.strip_ws("usage_instructions"), F.lit("")) == ""
    items = F.coalesce(good_list("_i1"), good_list("_i2"))
    usage = F.coalesce(F.when(real_usage("_u1", rules), T.strip_ws("_u1")), F.when(real_usage("_u2", rules), T.strip_ws("_u2")))
    got_list, got_use = need_list & items.isNotNull(), need_use & usage.isNotNull()
    return j.withColumns({
        "list_filled": got_list, "usage_filled": got_use,
        "verification_status": F.when(got_list, "verified_inci").otherwise(F.col("verification_status")),
        "confidence": F.when(got_list, 0.85).otherwise(F.col("confidence")),
        "inci_ingredients": F.when(got_list, items).otherwise(F.col("inci_ingredients")),
        "usage_instructions": F.when(got_use, usage).otherwise(F.col("usage_instructions")),
    }).drop("_i1", "_u1", "_i2", "_u2")


def create_products(products: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows without a URL get ``manual://brand/name``; taken URLs are rejected."""
    made = F.concat(F.lit("manual://"), F.col("brand_slug"), F.lit("/"), T.slugify("product_name"))
    d = batch.withColumn("product_url", F.coalesce(F.nullif(F.trim("product_url"), F.lit("")), made)).withColumns({
        "status_editorial": F.lit("pendente"), "status_publicacao": F.lit("rascunho"), "verification_status": F.lit("catalog_only")})
    taken = products.select("product_url").distinct()
    return d.join(taken, "product_url", "left_anti"), d.join(taken, "product_url", "left_semi")


def alias_crud(aliases: DataFrame, adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """Add unseen aliases (unique without case), delete named ones."""
    k = F.lower("alias").alias("_k")
    have = aliases.select(k)
    fresh = best_row(adds.withColumn("_k", F.lower("alias")).join(have, "_k", "left_anti"), ["_k"], [F.col("alias"), F.col("ingredient_id")]).drop("_k")
    gone = deletes.select(k).distinct()
    both = aliases.unionByName(fresh.select(aliases.columns)).withColumn("_k", F.lower("alias"))
    return both.join(gone, "_k", "left_anti").drop("_k")


def decide(queue: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Batch decisions on review or quarantine rows: status, notes and time."""
    d = decisions.select(key, F.col("status").alias("_s"), F.col("notes").alias("_n"), F.col("decided_at").alias("_t"))
    return queue.join(d, key, "left").withColumns({
        "status": F.coalesce("_s", "status"), "notes": F.coalesce("_n", "notes"), "decided_at": F.coalesce("_t", "decided_at"),
    }).drop("_s", "_n", "_t")


def drop_obvious_bad(products: DataFrame, name: str, url: str, min_len: int = 3) -> DataFrame:
    """Quarantined rows to delete: no real name, or their URL is on an active row."""
    q = products.filter(F.col("verification_status") == "quarantined")
    active = products.filter(F.col("verification_status") != "quarantined").select(url, F.lit(True).alias("_a")).distinct()
    short = F.length(T.strip_ws(F.coalesce(F.col(name), F.lit("")))) < min_len
    return q.join(active, url, "left").filter(short | F.coalesce("_a", F.lit(False))).drop("_a")


def pending_brands(registry: DataFrame, products: DataFrame, skip: DataFrame, terminal: Sequence[str] = ("out_of_scope", "blocked", "no_source")) -> DataFrame:
    open_ = registry.filter(~F.coalesce(F.col("status").isin(*terminal), F.lit(False)))
    return open_.join(products.select("brand_slug"), "brand_slug", "left_anti").join(skip.select("brand_slug"), "brand_slug", "left_anti")


def crawl_difference(first: DataFrame, second: DataFrame, url: str) -> DataFrame:
    """(url, status): in both crawls, only in the first, only in the second."""
    marks = first.select(url, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select(url, F.lit(0).alias("a"), F.lit(1).alias("b")))
    seen = marks.groupBy(url).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return seen.select(url, F.when(F.col("a") + F.col("b") == 2, "both").when(F.col("a") == 1, "gone").otherwise("new").alias("status"))

