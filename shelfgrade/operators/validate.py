"""Validators and gates: every result is a status plus the list of reasons."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.lists import DEFAULT_RULES, ListRules, validate_list
from ..functions.text import _c, let
from ..functions.urls import has_url, host_allowed
from ..vocab import market as M
from . import classify as C


@dataclass(frozen=True)
class FieldRules:
    """Word lists of the cross-field checks."""

    anchors: list[str] = field(default_factory=lambda: list(M.ANCHOR_ENTRIES))
    marketing: list[str] = field(default_factory=lambda: list(M.MARKETING_PHRASES))
    usage: list[str] = field(default_factory=lambda: list(M.USAGE_PHRASES))
    actions: list[str] = field(default_factory=lambda: list(M.ACTION_VERBS))
    tab_labels: list[str] = field(default_factory=lambda: list(M.TAB_LABELS))
    pricing: str = M.PRICING_PATTERN
    categories: list[str] = field(default_factory=lambda: list(M.VALID_CATEGORIES))
    type_words: str = M.NAME_TYPE_WORDS
    min_description: int = 40
    lists: ListRules = DEFAULT_RULES


FIELD_RULES = FieldRules()


def _issue(cond: Column, field_name: str, code: str, severity: str, details: Column | None = None) -> Column:
    return F.when(cond, F.struct(
        F.lit(field_name).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        (F.lit("") if details is None else F.coalesce(details, F.lit(""))).alias("details"),
    ))


def list_issues(items: Column | str, r: FieldRules = FIELD_RULES) -> Column:
    """Issues of an ingredient list; the counts behind them are taken once."""
    def counted(arr: Column) -> Column:
        norm = F.transform(arr, lambda x: T.strip_ws(F.lower(x)))
        return let(norm, lambda ns: F.struct(
            F.size(arr).alias("n"), F.exists(ns, lambda x: x.isin(r.anchors)).alias("anchored"),
            F.size(F.filter(ns, lambda x: T.contains_any(x, r.marketing))).alias("ads"),
            F.size(F.filter(ns, lambda x: T.contains_any(x, r.usage))).alias("use"),
            F.size(F.filter(F.transform(arr, T.strip_ws), lambda x: (
                (F.length(x) > 50) & x.rlike(r"\.\s+[A-Z]")) | (T.word_count(x) > 12))).alias("sentences"),
            F.exists(arr, lambda x: x.rlike(r"\.\s*\*+[A-Z]") | F.lower(x).rlike(r"complex[*:\s]")).alias("complex"),
            F.size(F.filter(ns, lambda x: x.rlike(r.pricing))).alias("prices")))

    f = "inci_ingredients"
    none = F.lit(None).cast("string")

    def codes(c: Column) -> Column:
        many_use, only_ads = c["use"] * 10 > c["n"] * 3, (c["ads"] > 0) & ~c["anchored"]
        return F.array(
            F.when(only_ads, F.lit("inci_is_marketing")),
            F.when(~only_ads & (c["ads"] * 10 > c["n"] * 3), F.lit("inci_mixed_marketing")),
            F.when(many_use, F.lit("inci_is_usage")), F.when((c["use"] > 0) & ~many_use, F.lit("inci_has_usage_text")),
            F.when(c["sentences"] > 3, F.lit("inci_has_sentences")), F.when(c["complex"], F.lit("inci_marketing_complex")),
            F.when(c["prices"] >= 3, F.lit("inci_pricing_garbage")))

    # Severity of each code.
    severity = {"inci_is_marketing": "error", "inci_is_usage": "error", "inci_pricing_garbage": "error", "inci_marketing_complex": "info"}
    arr = _c(items)
    found = F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, let(let(arr, counted), codes)).otherwise(F.array(*[none] * 7))
    level = lambda code: C.first_match([(code == k, F.lit(v)) for k, v in severity.items()], F.lit("warning"))
    rows = F.transform(F.array_compact(found), lambda code: F.struct(
        F.lit(f).alias("field"), code.alias("code"), level(code).alias("severity"), F.lit("").alias("details")))
    return rows


def description_issues(description: Column | str) -> list[Column]:
    desc = T.strip_ws(F.coalesce(_c(description), F.lit("")))

    def listy(parts: Column) -> Column:
        short = F.filter(parts, lambda p: (F.length(p) < 40) & (T.word_count(p) <= 5))
        return (F.size(parts) > 10) & (F.size(short) * 10 > F.size(parts) * 7)

    return [
        _issue(let(F.transform(F.split(desc, ","), T.strip_ws), listy), "description", "desc_is_inci_list", "error"),
        _issue((desc != "") & (F.length(desc) < 20) & ~desc.rlike(r"\p{L}"), "description", "desc_too_short", "warning"),
    ]


def usage_issues(usage: Column | str, r: FieldRules = FIELD_RULES) -> list[Column]:
    s = T.strip_ws(F.lower(F.coalesce(_c(usage), F.lit(""))))
    return [_issue((F.length(s) > 50) & ~T.contains_any(s, r.actions), "usage_instructions", "usage_is_description", "warning")]


def field_issues(
    name: Column | str | None = None, items: Column | str | None = None, description: Column | str | None = None,
    usage: Column | str | None = None, benefits: Column | str | None = None, price: Column | str | None = None,
    currency: Column | str | None = None, image: Column | str | None = None, ptype: Column | str | None = None,
    rules: FieldRules = FIELD_RULES,
) -> Column:
    """Array of ``struct<field, code, severity, details>`` over one row; row-local."""
    def text(col) -> Column:
        return F.lit("") if col is None else T.strip_ws(F.coalesce(_c(col), F.lit("")))

    issues = [
        _issue(text(name) == "", "product_name", "name_missing", "error"),
        _issue(text(image) == "", "image_url_main", "image_missing", "warning"),
        _issue(text(ptype) == "", "product_type_normalized", "type_missing", "info"),
    ]
    row_issues = F.array_compact(F.array(*issues))
    if items is not None:
        row_issues = F.concat(row_issues, list_issues(items, rules))
    issues = []
    if description is not None:
        issues += description_issues(description)
    if usage is not None:
        issues += usage_issues(usage, rules)
    if benefits is not None:
        issues.append(_issue(F.exists(_c(benefits), lambda b: F.length(T.strip_ws(b)) > 120), "benefits_claims", "benefits_too_long", "warning"))
    if price is not None:
        p = _c(price)
        cur = F.lit("") if currency is None else F.coalesce(_c(currency), F.lit(""))
        issues += [
            _issue(p <= 0, "price", "price_invalid", "error"), _issue(p > 5000, "price", "price_outlier", "warning"),
            _issue(p.isNotNull() & (cur == ""), "currency", "price_no_currency", "warning"),
        ]
    return F.concat(row_issues, F.array_compact(F.array(*issues))) if issues else row_issues


def field_score(issues: Column) -> Column:
    """100, minus 20 per error and 5 per warning, never below 0."""
    cost = F.aggregate(
        issues, F.lit(0),
        lambda acc, i: acc + F.when(i["severity"] == "error", 20).when(i["severity"] == "warning", 5).otherwise(0),
    )
    return F.greatest(F.lit(0), F.lit(100) - cost)


def real_usage(usage: Column | str, rules: FieldRules = FIELD_RULES, min_len: int = 20) -> Column:
    """Long enough, with an action verb, and not a tab caption."""
    return let(T.strip_ws(F.coalesce(_c(usage), F.lit(""))), lambda s: (
        (F.length(s) >= min_len) & T.contains_any(F.lower(s), rules.actions) & ~C.tab_noise(s, rules.tab_labels)))


def qa_gate(
    name: Column, url: Column, image: Column, reason: Column, items: Column, composition: Column,
    confidence: Column, domains: list[str] | Column, in_section: Column | bool = False, min_conf: float = 0.80,
    rules: FieldRules = FIELD_RULES, garbage_words: list[str] = M.GARBAGE_NAMES,
    garbage_patterns: list[str] = M.GARBAGE_NAME_PATTERNS, rejection_verbs: list[str] = M.REJECTION_VERBS,
) -> Column:
    """``struct<status, passed, failed, reason>`` of one extracted product."""
    why = F.coalesce(reason, F.lit(""))
    blocked = F.startswith(why, F.lit("blocked:"))
    block_code = F.coalesce(F.nullif(F.regexp_replace(why, "^blocked:", ""), F.lit("")), F.lit("blocked"))
    nil, none = F.lit(""), F.array().cast("array<string>")
    name_code = F.coalesce(
        C.garbage_name(name, garbage_words, garbage_patterns),
        let(C.name_quality(name, rules.type_words), lambda nq: F.when(
            ~nq["valid"], F.concat(F.lit("name_low_quality:"), F.array_join(F.slice(nq["issues"], 1, 3), ",")))))
    reason_code = C.first_match([
        (F.startswith(why, F.lit("non_hair:")), why), (why == "no_hair_keyword", F.lit("no_hair_keyword")),
        (why == "", F.lit("no_hair_relevance")),
    ])
    facts = F.struct(
        name_code.alias("name"), reason_code.alias("reason"), F.coalesce(host_allowed(url, domains), F.lit(False)).alias("domain"),
        (F.coalesce(image, F.lit("")) != "").alias("image"), C.list_like(composition, False, rejection_verbs).alias("formal"),
        validate_list(items, in_section, rules.lists).alias("check"))

    def verdict(status: str, ok: Column, bad: Column, text: Column) -> Column:
        return F.struct(
            F.lit(status).alias("status"), ok.alias("passed"), bad.alias("failed"), text.alias("reason"))

    def judged(v: Column) -> Column:
        failed = F.array_compact(F.array(
            v["name"], F.when(~v["domain"], F.lit("domain_unofficial")), F.when(~v["image"], F.lit("no_image")), v["reason"]))
        passed = F.array_compact(F.array(
            F.when(v["name"].isNull(), F.lit("name_valid")), F.when(v["domain"], F.lit("domain_valid")),
            F.when(v["image"], F.lit("has_image")), F.when(v["reason"].isNull(), F.lit("hair_relevant"))))
        more = F.when(v["formal"], F.concat(passed, F.array(F.lit("composition_looks_like_inci")))).otherwise(passed)
        check = v["check"]
        return C.first_match(
            [
                (blocked, verdict("quarantined", none, F.array(block_code), block_code)),
                (F.size(failed) > 0, verdict("quarantined", passed, failed, F.array_join(failed, "; "))),
                (F.coalesce(F.size(items), F.lit(0)) <= 0, verdict("catalog_only", more, none, nil)),
                (~check["valid"], verdict(
                    "quarantined", more, F.array(F.concat(F.lit("inci_invalid:"), check["reason"])), check["reason"])),
                (confidence < min_conf, verdict(
                    "quarantined", F.concat(more, F.array(F.lit("inci_valid"))), F.array(F.lit("low_confidence")),
                    F.concat(F.lit("confidence "), confidence.cast("string"), F.lit(f" < {min_conf}")))),
            ],
            verdict("verified_inci", F.concat(more, F.array(F.lit("inci_valid"), F.lit("confidence_ok"))), none, nil),
        )

    return let(facts, judged)


def known_ratio(products: DataFrame, key: str, items: str, dictionary: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    """(key, known_ratio, n_known, n_terms): share of distinct folded entries in the dictionary.

    Distinct terms are resolved once, whatever number of products use them.
    """
    terms = products.select(key, F.explode(F.array_distinct(F.transform(F.col(items), lambda x: T.strip_ws(F.lower(x))))).alias("term"))
    terms = terms.filter(F.col("term") != "")
    names = dictionary.select(F.lower(F.col(name)).alias("term"))
    if alias:
        names = names.unionByName(dictionary.select(F.lower(F.col(alias)).alias("term")))
    known = names.filter(F.col("term").isNotNull()).distinct().withColumn("_known", F.lit(1))
    return (
        terms.join(known, "term", "left").groupBy(key)
        .agg(F.count("_known").alias("n_known"), F.count(F.lit(1)).alias("n_terms"))
        .withColumn("known_ratio", F.col("n_known") / F.col("n_terms"))
    )


def grounded_provenance(
    products: DataFrame, evidence: DataFrame, key: str, field_name: str = "inci_ingredients",
    ungrounded: tuple[str, ...] = ("llm_grounded",),
) -> DataFrame:
    """Adds ``grounded``: some evidence beyond the ungrounded methods, else the row's own method, else true."""
    seen = (
        evidence.filter((F.col("field_name") == field_name) & (F.coalesce(F.col("extraction_method"), F.lit("")) != ""))
        .groupBy(key).agg(F.bool_or(~F.col("extraction_method").isin(*ungrounded)).alias("_ev"))
    )
    own = F.when(F.col("extraction_method").isNotNull(), ~F.col("extraction_method").isin(*ungrounded))
    return products.join(seen, key, "left").withColumn("grounded", F.coalesce("_ev", own, F.lit(True))).drop("_ev")


def gold_gate(
    name: Column, items: Column, description: Column, usage: Column, image: Column, category_col: Column,
    status: Column, hidden: Column, reason: Column, kit: Column, ratio: Column | None = None,
    grounded: Column | None = None, rules: FieldRules = FIELD_RULES, hard_ratio: float = 0.3, soft_ratio: float = 0.6,
) -> Column:
    """``struct<gold_status, blockers array<struct<code, field, severity>>, name_score, terms>``.

    Disqualified rows are raw, rows with a missing or untrue field are catalog, complete rows with a
    weak trust signal are gold_candidate, the rest is gold.
    """
    def blocker(cond: Column, code: Column | str, field_name: str, severity: str = "error") -> Column:
        c = F.lit(code) if isinstance(code, str) else code
        return F.when(cond, F.struct(c.alias("code"), F.lit(field_name).alias("field"), F.lit(severity).alias("severity")))

    f = "inci_ingredients"
    desc_in = T.strip_ws(F.coalesce(description, F.lit("")))
    # Everything the blockers ask for, computed once per row.
    facts = F.struct(
        C.name_quality(name, rules.type_words).alias("nq"), validate_list(items, False, rules.lists).alias("check"),
        list_issues(items, rules).alias("found"), T.strip_ws(F.coalesce(usage, F.lit(""))).alias("use"),
        real_usage(usage, rules).alias("use_ok"), (F.length(desc_in) >= rules.min_description).alias("long"),
        C.tab_noise(desc_in, rules.tab_labels).alias("label"), F.array_compact(F.array(*description_issues(desc_in))).alias("desc"))

    def codes(issues: Column, severity: str) -> Column:
        return F.transform(F.filter(issues, lambda i: i["severity"] == severity), lambda i: i["code"])

    def first(code_list: Column) -> Column:
        return F.try_element_at(code_list, F.lit(1))

    def judged(v: Column) -> Column:
        nq, valid, use_ok, long, label = v["nq"], v["check"]["valid"], v["use_ok"], v["long"], v["label"]
        errors, warns, desc_errors = codes(v["found"], "error"), codes(v["found"], "warning"), codes(v["desc"], "error")
        has = F.coalesce(F.size(items), F.lit(0)) > 0
        clean = has & valid & (F.size(errors) == 0)
        r = F.lit(None).cast("double") if ratio is None else ratio
        g = F.lit(True) if grounded is None else F.coalesce(grounded, F.lit(True))
        disq = [
            blocker(F.coalesce(status == "quarantined", F.lit(False)), "quarantined", "verification_status"),
            blocker(F.coalesce(hidden, F.lit(False)), "hidden", "is_hidden"),
            blocker(F.startswith(F.coalesce(reason, F.lit("")), F.lit("non_hair")), "non_hair", "hair_relevance_reason"),
            blocker(~nq["valid"], "name_low_quality", "product_name"),
        ]
        required = [
            blocker(~has, "inci_missing", f),
            blocker(has & ~valid, F.concat(F.lit("inci_invalid:"), v["check"]["reason"]), f),
            blocker(has & valid & (F.size(errors) > 0), first(errors), f),
            blocker(clean & F.coalesce(r < hard_ratio, F.lit(False)), "inci_garbage", f),
            blocker(~has_url(image), "image_missing", "image_url_main"),
            blocker(~use_ok & (v["use"] == ""), "usage_missing", "usage_instructions"),
            blocker(~use_ok & (v["use"] != ""), "usage_not_instructions", "usage_instructions"),
            blocker(~long, "desc_missing", "description"),
            blocker(long & label, "desc_is_label", "description"),
            blocker(long & ~label & (F.size(desc_errors) > 0), first(desc_errors), "description"),
            blocker(~F.coalesce(category_col.isin(rules.categories), F.lit(False)), "category_invalid", "product_category"),
            blocker(F.coalesce(kit, F.lit(False)), "is_kit", "is_kit"),
        ]
        soft = [
            blocker(clean & (F.size(warns) > 0), first(warns), f, "warning"),
            blocker(clean & F.coalesce((r >= hard_ratio) & (r < soft_ratio), F.lit(False)), "inci_low_known_ratio", f, "warning"),
            blocker(clean & ~g, "inci_llm_only", f, "warning"),
        ]
        return F.struct(
            *[F.array_compact(F.array(*x)).alias(n) for n, x in (("d", disq), ("q", required), ("s", soft))],
            nq["score"].alias("score"), F.size(v["check"]["cleaned"]).alias("terms"))

    def verdict(b: Column) -> Column:
        tier = C.first_match([
            (F.size(b["d"]) > 0, F.lit("raw")), (F.size(b["q"]) > 0, F.lit("catalog")), (F.size(b["s"]) > 0, F.lit("gold_candidate")),
        ], F.lit("gold"))
        return F.struct(
            tier.alias("gold_status"), F.concat(b["d"], b["q"], b["s"]).alias("blockers"), b["score"].alias("name_score"), b["terms"].alias("terms"))

    return let(let(facts, judged), verdict)


def apply_gold(df: DataFrame, evaluation: Column, now: Column | None = None) -> DataFrame:
    """Write the tier, but never over a human rejection."""
    stamp = F.current_timestamp() if now is None else now
    keep = F.coalesce(F.col("gold_status") == "gold_rejected", F.lit(False))
    out = df.withColumn("_ev", evaluation)
    return out.withColumns({
        "gold_blockers": F.when(keep, F.lit(None)).otherwise(F.col("_ev.blockers")),
        "gold_evaluated_at": F.when(~keep, stamp),
        "gold_status": F.when(keep, F.col("gold_status")).otherwise(F.col("_ev.gold_status")),
    }).drop("_ev")


# Weight of the editorial state in the confidence score.
EDITORIAL_SCORES = {"pendente": 0.0, "em_revisao": 0.5, "aprovado": 1.0, "corrigido": 1.0, "rejeitado": 0.0}


def confidence_score(filled: list[Column], has_list: Column, n_validated: Column, n_total: Column, editorial: Column) -> Column:
    """``struct<score, completeness, parsing, review>``: 40 % completeness, 35 % parsed, 25 % reviewed."""
    complete = sum((c.cast("int") for c in filled), F.lit(0)) / F.lit(float(len(filled)))
    parsing = F.when(has_list & (n_total > 0), n_validated / n_total).otherwise(0.0)
    review = C.first_match([(editorial == k, F.lit(v)) for k, v in EDITORIAL_SCORES.items()], F.lit(0.0))
    return F.struct(
        F.round((complete * 0.40 + parsing * 0.35 + review * 0.25) * 100, 2).alias("score"),
        complete.alias("completeness"), parsing.alias("parsing"), review.alias("review"))


def data_quality_pct(filled: list[Column]) -> Column:
    return F.round(sum((c.cast("int") for c in filled), F.lit(0)) * 100 / F.lit(float(len(filled))), 0).cast("int")


def worst_quality_filter(df: DataFrame, pct: Column, name: str, minimum: int, type_words: str = M.NAME_TYPE_WORDS) -> DataFrame:
    """Adds ``worst``, the lower of field and name quality, and keeps rows at or above the minimum."""
    worst = F.least(pct, C.name_quality(name, type_words)["score"])
    return df.withColumn("worst", worst).filter(F.col("worst") >= minimum)


def promotable(df: DataFrame, items: str, requested: Column, rules: ListRules = DEFAULT_RULES) -> DataFrame:
    """Requested promotions out of quarantine: an unproven verified request becomes catalog_only."""
    ok = (F.coalesce(F.size(F.col(items)), F.lit(0)) > 0) & validate_list(F.col(items), False, rules)["valid"]
    granted = F.when((requested == "verified_inci") & ~F.coalesce(ok, F.lit(False)), F.lit("catalog_only")).otherwise(requested)
    return df.withColumns({"granted": granted, "downgraded": granted != requested})
