"""Score ordered ingredient lists against profiles, for all (list, profile) pairs at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators.windows import top_k
from ..session import staged


def position_weight(idx: Column, n: Column) -> Column:
    """1 at the top of the list, falling by 0.8 over its length, never below 0.2."""
    return F.greatest(F.lit(0.2), F.lit(1.0) - idx * F.lit(0.8) / F.greatest(n, F.lit(1)))


def interpret(score: Column) -> Column:
    return (
        F.when(score >= 0.6, "Altamente compatível com o perfil").when(score >= 0.2, "Compatível com algumas reservas")
        .when(score >= -0.2, "Neutro — sem grandes benefícios ou alertas")
        .when(score >= -0.6, "Cuidado — possíveis incompatibilidades").otherwise("Não recomendado para este perfil"))


def _rule_hits(entries: DataFrame, profiles: DataFrame, rules: DataFrame, product: str) -> DataFrame:
    """entries(product, idx, n, category) x the product's profiles x rules."""
    typed = profiles.select(product, "profile_id", F.explode("hair_types").alias("hair_type"))
    weighted = entries.filter(F.col("category").isNotNull()).withColumn("weight", position_weight(F.col("idx"), F.col("n")))
    # Exact decimals: the sums do not depend on the order in which tasks add them up.
    weighted = weighted.withColumn("weight", F.col("weight").cast("decimal(12,9)"))
    return weighted.join(typed, product).join(rules.select("category", "hair_type", "score"), ["category", "hair_type"])


def score_lists(
    entries: DataFrame, profiles: DataFrame, rules: DataFrame, product: str = "product_id", floor_weight: bool = True
) -> DataFrame:
    """One row per (product, profile): overall, coverage_pct, counts of alerts and benefits, interpretation.

    ``entries``: product, idx (0-based), n (list length), name, category (null when unknown).
    ``profiles``: product, profile_id, hair_types. ``rules``: category, hair_type, score.
    With ``floor_weight`` the weight sum is at least 1; without it the plain sum divides.
    """
    hits = _rule_hits(entries, profiles, rules, product)
    sums = hits.groupBy(product, "profile_id").agg(
        F.sum(F.col("score") * F.col("weight")).alias("_s"), F.sum("weight").alias("_w"),
        F.count_if(F.col("score") <= -1).alias("alerts"), F.count_if(F.col("score") >= 1).alias("benefits"))
    sizes = entries.groupBy(product).agg(
        F.count(F.lit(1)).alias("items"), F.count("category").alias("categorized"))
    pairs = profiles.select(product, "profile_id").join(sizes, product)
    total, weight = F.col("_s").cast("double"), F.coalesce(F.col("_w").cast("double"), F.lit(0.0))
    base = F.greatest(weight, F.lit(1.0)) if floor_weight else weight
    overall = F.when(weight > 0, total / base).otherwise(0.0)
    out = pairs.join(sums, [product, "profile_id"], "left").withColumn("overall", overall)
    return out.select(
        product, "profile_id", "items", "categorized", "overall",
        (F.col("categorized") * 100.0 / F.greatest("items", F.lit(1))).alias("coverage_pct"),
        F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("benefits", F.lit(0)).alias("benefits"),
        interpret(F.col("overall")).alias("interpretation"))


def findings(entries: DataFrame, profiles: DataFrame, rules: DataFrame, product: str = "product_id", worst: bool = True, n: int = 10) -> DataFrame:
    """First n alerts (or benefits) of each (product, profile) in list order, one per row."""
    hits = _rule_hits(entries, profiles, rules, product)
    side = hits.filter(F.col("score") <= -1 if worst else F.col("score") >= 1)
    return top_k(side.select(product, "profile_id", "idx", "name", "category", "hair_type", "score"),
                 [product, "profile_id"], [F.col("idx"), F.col("hair_type")], n, "finding_no")


# Words in the names of rows that the fallback leaves out.
FALLBACK_WORDS = ["labial", "facial", "corporal", "perfume", "fps", "rímel", "rimel", "demaquilante", "sabonete em barra", "secativo", "desodorante"]


def fallback_guard(name: Column, category: Column, reason: Column, items: Column) -> Column:
    """Whether a verified row may stand in where no gold row is: with a list, in the domain by category and reason, by its name too."""
    return ((F.size(items) > 0) & (F.coalesce(category, F.lit("")) != "non_hair") & ~F.startswith(F.coalesce(reason, F.lit("")), F.lit("non_hair"))
            & ~T.contains_any(F.lower(F.coalesce(name, F.lit(""))), FALLBACK_WORDS))


def alternatives(
    profiles: DataFrame, products: DataFrame, entries: DataFrame, rules: DataFrame, k: int = 3, pool: int | None = None,
    excluded_types: tuple[str, ...] = ("oxidante", "descolorante", "coloracao"), min_items: int = 3, min_matched: int = 2,
    wanted_type: str | None = None, excluded_id: str | None = None, guard: Column | None = None, first: int = 64,
) -> DataFrame:
    """(profile_id, product_id, score, rank): the k best products per profile, over the whole catalogue.

    ``profiles``: profile_id, hair_types, and where named the columns ``wanted_type`` (only products of that type) and ``excluded_id``. Without a
    wanted type, ``excluded_types`` are left out. Products are those of the gold tier; where it holds none for the profile, verified ones
    that pass ``guard``. ``pool`` cuts a tier to its richest lists; by default nothing is cut.

    A score is a weighted mean, so it is at most the best of a product's scores for the single hair types. The ``first`` products of each type give
    each different set of types a k-th best score; only products that reach it for some single type are then scored in full.
    """
    asks = profiles.select(
        "profile_id", F.array_sort(F.array_distinct("hair_types")).alias("types"),
        F.coalesce(F.concat(F.lit("="), F.col(wanted_type)) if wanted_type else F.lit(None).cast("string"), F.lit("*")).alias("scope"),
        (F.col(excluded_id) if excluded_id else F.lit(None).cast(dict(products.dtypes)["product_id"])).alias("_without"))
    gold = F.coalesce(F.col("gold_status") == "gold", F.lit(False))
    verified = F.coalesce((F.col("verification_status") == "verified_inci") & (F.lit(True) if guard is None else guard), F.lit(False))
    scopes = F.array_compact(F.array(F.concat(F.lit("="), "product_type"), F.when(~F.col("product_type").isin(*excluded_types), "*")))
    rows = (products.filter(F.col("product_type").isNotNull() & (gold | verified))
            .select("product_id", F.when(gold, 0).otherwise(1).alias("tier"), F.explode(scopes).alias("scope")).join(asks.select("scope").distinct(), "scope", "left_semi"))
    lengths = entries.groupBy("product_id").agg(F.count(F.lit(1)).alias("items"), F.count("category").alias("matched"))
    listed = rows.join(lengths, "product_id")
    if pool:
        listed = top_k(listed, ["scope", "tier"], [F.desc("items"), F.col("product_id")], pool, "_place")
    usable = staged(listed.filter((F.col("items") >= min_items) & (F.col("matched") >= min_matched)).select("scope", "tier", "product_id"))
    # Each entry meets a rule for every hair type, so entries of other products go first.
    hits = entries.filter(F.col("category").isNotNull()).join(usable, "product_id", "left_semi").withColumn("weight", position_weight(F.col("idx"), F.col("n")).cast("decimal(12,9)")).join(
        rules.select("category", "hair_type", "score"), "category")
    per_type = hits.groupBy("product_id", "hair_type").agg(F.sum(F.col("score") * F.col("weight")).alias("_s"), F.sum("weight").alias("_w")).filter("_w > 0")
    facts = staged(usable.join(per_type, "product_id").withColumn("_r", F.col("_s").cast("double") / F.col("_w").cast("double")))
    sets = asks.select("types", "scope").distinct().withColumn("hair_type", F.explode("types"))
    key = ["types", "scope", "tier"]

    def scored(candidates: DataFrame) -> DataFrame:
        """The k best of each set and one more, in case a profile leaves one out."""
        sums = candidates.select(*key, "product_id").distinct().join(sets, ["types", "scope"]).join(
            facts, ["scope", "tier", "product_id", "hair_type"]).groupBy(*key, "product_id").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w"))
        scores = sums.select(*key, "product_id", (F.col("_s").cast("double") / F.col("_w").cast("double")).alias("score"))
        return top_k(scores, key, [F.round("score", 6).desc(), F.col("product_id")], k + 1, "_place")

    leaders = top_k(facts, ["scope", "tier", "hair_type"], [F.desc("_r"), F.col("product_id")], first, "_place").drop("_place")
    floor = scored(sets.join(leaders, ["scope", "hair_type"])).filter(F.col("_place") == k + 1).select(*key, (F.col("score") - 1e-6).alias("_floor"))
    reach = sets.join(facts, ["scope", "hair_type"]).join(floor, key, "left").filter(F.coalesce(F.col("_r") >= F.col("_floor"), F.lit(True)))
    best = scored(reach).drop("_place")
    # The gold tier counts for a profile if it holds a row besides the one that is left out.
    golden = rows.filter("tier = 0")
    many = golden.groupBy("scope").agg(F.count(F.lit(1)).alias("_gold"))
    out = asks.join(many, "scope", "left").join(golden.select("scope", F.col("product_id").alias("_without"), F.lit(1).alias("_own")), ["scope", "_without"], "left")
    tier = F.when(F.coalesce("_gold", F.lit(0)) - F.coalesce("_own", F.lit(0)) > 0, 0).otherwise(1)
    found = out.withColumn("tier", tier).join(best, key).filter(F.col("_without").isNull() | (F.col("product_id") != F.col("_without")))
    return top_k(found.select("profile_id", "product_id", "score"), ["profile_id"], [F.round("score", 6).desc(), F.col("product_id")], k)
