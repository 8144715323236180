"""Validator and gate queries over the lists and texts inside the documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.functions import lists as L
from shelfgrade.functions.text import once
from shelfgrade.operators import reports as R
from shelfgrade.operators import validate as V

from . import sqlx as X
from .base import BRIDGE_SQL, PRODUCTS_SQL, bridge, products, query

P = f"WITH {PRODUCTS_SQL} "
N = "CAST(count(*) AS BIGINT)"

RULES = L.ListRules(
    cut_markers=["ungheit", "| ation"], garbage=["ouou"], verbs=["ation", "eaux"], water=["the", "la", "der"], headings=["in", "les"],
    min_plain=6, max_len=30, max_words=4)


def word_lists(t):
    """Each document as a list of its words."""
    return t.spread("documents").select("doc_id", "lang", "source", "n_chars", "text", F.split("text", "[ \n]").alias("items"))


def phrase_lists(t):
    """Each document split at commas, full stops and line ends."""
    return t.spread("documents").select("doc_id", "lang", "source", "n_chars", "text", F.split("text", "[,.\n]").alias("items"))


def valid_sql(x: str, verbs=("ation", "eaux"), max_len=30, max_words=4) -> str:
    s = X.trim(x)
    return (f"(length({s}) BETWEEN 2 AND {max_len} AND NOT regexp_matches(lower({s}), 'https?://') AND {X.words(s)} <= {max_words} "
            f"AND ({X.words(s)} < 2 OR NOT {X.has_any(f'lower({s})', list(verbs))}))")


def checked_sql(split: str) -> str:
    """CTE chain ending in ``chk(doc_id, ..., cleaned, neat, reason)``."""
    return f"""raw AS (SELECT doc_id, lang, source, n_chars, text, {split} AS items FROM documents),
 nrm AS (SELECT *, list_transform(items, lambda x: {X.trim('lower(x)')}) AS norm, list_filter(list_transform(items, lambda x: {X.trim('x')}), lambda x: x <> '') AS neat FROM raw),
 okd AS (SELECT *, list_filter(neat, lambda x: {valid_sql('x')}) AS ok, list_filter(list_transform(norm, lambda x, i: CASE WHEN x IN ('the','la','der') THEN i END), lambda p: p IS NOT NULL) AS w FROM nrm),
 cl AS (SELECT *, list_transform(ok, lambda y: lower(y)) AS okl, len(list_filter(range(3, len(norm) // 2 + 1), lambda k: norm[1:k] = norm[k+1:2*k])) > 0 AS rep,
   len(list_filter(range(2, len(w) + 1), lambda j: w[j] - w[j-1] > 1)) > 0 OR len(list_filter(norm, lambda x: regexp_matches(x, '^(in|les)\\s*:'))) > 0 AS con FROM okd),
 chk AS (SELECT *, list_filter(ok, lambda x, i: list_position(okl, lower(x)) = i) AS cleaned FROM cl),
 res AS (SELECT *, CASE WHEN rep THEN 'repetition_detected' WHEN con THEN 'concat_detected' WHEN len(cleaned) < 6 THEN 'min_ingredients: only ' || len(cleaned) || ' valid terms' ELSE '' END AS reason FROM chk)"""


WORDS = "string_split_regex(text, '[ \\n]')"
PHRASES = "string_split_regex(text, '[,.\\n]')"
#: Everything after the first line.
USAGE = "CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"


def usage_text():
    return F.when(F.contains("text", F.lit("\n")), F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise("")


@query("valid_items", f"WITH i AS (SELECT doc_id, unnest({PHRASES}) AS item FROM documents) SELECT doc_id, {N} AS items, CAST(count(*) FILTER (WHERE {valid_sql('item')}) AS BIGINT) AS valid FROM i GROUP BY 1")
def valid_items(t):
    d = phrase_lists(t).select("doc_id", F.explode("items").alias("item"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(L.valid_item(F.col("item"), F.lit(False), RULES)).alias("valid"))


@query("list_repetition", f"WITH {checked_sql(PHRASES)} SELECT doc_id, rep AS repeated FROM chk")
def list_repetition(t):
    return phrase_lists(t).select("doc_id", L.has_repetition(F.col("items")).alias("repeated"))


@query("list_concatenation", f"WITH {checked_sql(WORDS)} SELECT doc_id, con AS joined FROM chk")
def list_concatenation(t):
    return word_lists(t).select("doc_id", L.has_concatenation(F.col("items"), RULES).alias("joined"))


def _validated(name: str, split: str, source):
    @query(name, f"""WITH {checked_sql(split)} SELECT doc_id, reason = '' AS valid, reason, CASE WHEN rep OR con THEN '' ELSE md5(array_to_string(cleaned, '|')) END AS cleaned,
 CAST(CASE WHEN rep OR con THEN 0 ELSE len(neat) - len(cleaned) END AS INT) AS removed FROM res""")
    def run(t):
        d = once(source(t), ["doc_id"], "v", L.validate_list("items", False, RULES))
        broken = F.col("v.reason").isin("repetition_detected", "concat_detected")
        return d.select("doc_id", F.col("v.valid").alias("valid"), F.col("v.reason").alias("reason"),
                        F.when(broken, "").otherwise(F.md5(F.array_join("v.cleaned", "|"))).alias("cleaned"), F.size("v.removed").alias("removed"))


_validated("validated_phrase_lists", PHRASES, phrase_lists)
_validated("validated_word_lists", WORDS, word_lists)


_CUT = X.cut("text", RULES.cut_markers, RULES.garbage).replace("| ation", "| ation")


@query("extracted_lists", f"""WITH c AS (SELECT doc_id, {_CUT} AS ct FROM documents), s AS (SELECT doc_id, ct, {X.neat_parts('ct')} AS parts FROM c),
 l AS (SELECT *, list_transform(parts, lambda y: lower(y)) AS low FROM s), d AS (SELECT doc_id, ct, list_filter(parts, lambda x, i: list_position(low, lower(x)) = i) AS items FROM l),
 n AS (SELECT doc_id, ct, list_filter(items, lambda x: {valid_sql('x')}) AS cleaned, list_transform(items, lambda x: {X.trim('lower(x)')}) AS norm FROM d),
 w AS (SELECT *, list_filter(list_transform(norm, lambda x, i: CASE WHEN x IN ('the','la','der') THEN i END), lambda p: p IS NOT NULL) AS wp FROM n)
SELECT doc_id, CASE WHEN ct = '' THEN 'empty_after_cleaning' WHEN len(list_filter(range(2, len(wp) + 1), lambda j: wp[j] - wp[j-1] > 1)) > 0 OR len(list_filter(norm, lambda x: regexp_matches(x, '^(in|les)\\s*:'))) > 0 THEN 'concat_detected'
 WHEN len(cleaned) < 6 THEN 'min_ingredients: only ' || len(cleaned) || ' valid terms' ELSE '' END AS reason FROM w""")
def extracted_lists(t):
    return t.documents.select("doc_id", L.extract_and_validate("text", False, RULES)["reason"].alias("reason"))


FIELDS = V.FieldRules(
    anchors=["the", "der"], marketing=["tion", "ungen"], usage=["eau", "ing"], actions=["the ", "der "], tab_labels=["the", "of", "der", "und"],
    pricing=r"and|que", categories=["en", "fr"], type_words="the|la|die|el", lists=RULES)

_ISSUES = f"""raw AS (SELECT doc_id, lang, n_chars, text, {PHRASES} AS items, {USAGE} AS usage FROM documents),
nrm AS (SELECT *, list_transform(items, lambda x: {X.trim('lower(x)')}) AS norm, list_transform(items, lambda x: {X.trim('x')}) AS tr, len(items) AS n, {X.trim('text')} AS des, {X.trim('lower(usage)')} AS us FROM raw),
cnt AS (SELECT *, len(list_filter(norm, lambda x: x IN ('the','der'))) > 0 AS anch, len(list_filter(norm, lambda x: {X.has_any('x', ['tion', 'ungen'])})) AS ads,
 len(list_filter(norm, lambda x: {X.has_any('x', ['eau', 'ing'])})) AS use, len(list_filter(tr, lambda x: (regexp_matches(x, '\\.\\s+[A-Z]') AND length(x) > 50) OR {X.words('x')} > 12)) AS sen,
 len(list_filter(items, lambda x: regexp_matches(x, '\\.\\s*\\*+[A-Z]') OR regexp_matches(lower(x), 'complex[*:\\s]'))) AS cpx, len(list_filter(norm, lambda x: regexp_matches(x, 'and|que'))) AS prc,
 list_transform(string_split(des, ','), lambda p: {X.trim('p')}) AS parts FROM nrm),
iss AS (SELECT *, len(list_filter(parts, lambda p: length(p) < 40 AND {X.words('p')} <= 5)) AS short FROM cnt),
fin AS (SELECT doc_id, lang, n_chars, list_filter([
 CASE WHEN lang = 'es' THEN 'image_missing:warning' END, CASE WHEN n_chars < 300 THEN 'type_missing:info' END,
 CASE WHEN ads > 0 AND NOT anch THEN 'inci_is_marketing:error' END, CASE WHEN NOT (ads > 0 AND NOT anch) AND ads * 10 > n * 3 THEN 'inci_mixed_marketing:warning' END,
 CASE WHEN use * 10 > n * 3 THEN 'inci_is_usage:error' END, CASE WHEN use > 0 AND use * 10 <= n * 3 THEN 'inci_has_usage_text:warning' END, CASE WHEN sen > 3 THEN 'inci_has_sentences:warning' END,
 CASE WHEN cpx > 0 THEN 'inci_marketing_complex:info' END, CASE WHEN prc >= 3 THEN 'inci_pricing_garbage:error' END,
 CASE WHEN len(parts) > 10 AND short * 10 > len(parts) * 7 THEN 'desc_is_inci_list:error' END,
 CASE WHEN length(us) > 50 AND NOT {X.has_any('us', ['the ', 'der '])} THEN 'usage_is_description:warning' END,
 CASE WHEN n_chars > 5000 THEN 'price_outlier:warning' END, CASE WHEN lang = 'fr' THEN 'price_no_currency:warning' END], lambda x: x IS NOT NULL) AS issues FROM iss)"""


def issue_rows(t):
    d = phrase_lists(t).withColumn("usage", usage_text())
    issues = V.field_issues(
        name="doc_id", items="items", description="text", usage="usage", price=F.col("n_chars").cast("double"),
        currency=F.when(F.col("lang") != "fr", "BRL"), image=F.when(F.col("lang") != "es", "x"), ptype=F.when(F.col("n_chars") >= 300, "t"), rules=FIELDS)
    return d.select("doc_id", "lang", "n_chars", issues.alias("issues"))


@query("field_issues", f"WITH {_ISSUES} SELECT doc_id, array_to_string(issues, ',') AS issues FROM fin")
def field_issues(t):
    return issue_rows(t).select("doc_id", F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(":"), i["severity"])), ",").alias("issues"))


@query("field_scores", f"WITH {_ISSUES} SELECT doc_id, CAST(greatest(0, 100 - 20 * len(list_filter(issues, lambda x: ends_with(x, ':error'))) - 5 * len(list_filter(issues, lambda x: ends_with(x, ':warning')))) AS INT) AS score FROM fin")
def field_scores(t):
    return issue_rows(t).select("doc_id", V.field_score(F.col("issues")).alias("score"))


@query("issue_histogram", f"WITH {_ISSUES}, e AS (SELECT unnest(issues) AS issue FROM fin) SELECT issue, {N} AS n FROM e GROUP BY 1")
def issue_histogram(t):
    d = issue_rows(t).select(F.explode("issues").alias("i"))
    return R.value_counts(d, F.concat("i.code", F.lit(":"), "i.severity"), "issue")


_LAB = X.rep("lower(" + X.collapse("strip_accents(u)") + ")", r"^[^\w]+")
_REAL = f"""length({X.trim('u')}) >= 20 AND {X.has_any("lower(" + X.trim('u') + ")", ['the ', 'der '])} AND NOT ({_LAB} IN ('the','of','der','und') OR ({' + '.join(f"contains(left({_LAB}, 80), '{w}')::INT" for w in ['the', 'of', 'der', 'und'])}) >= 2)"""


@query("real_usage", f"SELECT doc_id, {_REAL} AS real FROM (SELECT doc_id, {USAGE} AS u FROM documents)")
def real_usage(t):
    usage = usage_text()
    return t.documents.select("doc_id", V.real_usage(usage, FIELDS).alias("real"))


_KR = """d AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split_regex(text, '[ \\n]'), lambda x: trim(lower(x), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), lambda x: x <> '')) AS terms FROM documents),
t AS (SELECT doc_id, unnest(terms) AS term FROM d), k AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS term FROM benchmark),
r AS (SELECT doc_id, CAST(count(k.term) AS BIGINT) AS n_known, CAST(count(*) AS BIGINT) AS n_terms FROM t LEFT JOIN k USING (term) GROUP BY 1)"""


def ratios(t):
    words = t.benchmark.select(F.explode(F.split("text", " ")).alias("name"))
    return V.known_ratio(word_lists(t), "doc_id", "items", words, "name")


@query("known_ratio", f"WITH {_KR} SELECT doc_id, n_known, n_terms, n_known / n_terms AS known_ratio FROM r")
def known_ratio(t):
    return ratios(t)


@query("grounded_provenance", """WITH e AS (SELECT l_partkey AS p, bool_or(l_returnflag <> 'R') AS g FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45 GROUP BY 1)
SELECT p_partkey AS product_id, coalesce(g, p_type <> 'LARGE') AS grounded FROM part LEFT JOIN e ON p = p_partkey""")
def grounded_provenance(t):
    ev = t.lineitem.filter("l_quantity > 45").selectExpr("l_partkey AS product_id", "CASE WHEN l_linestatus = 'F' THEN 'inci_ingredients' ELSE 'x' END AS field_name",
                                                          "CASE WHEN l_returnflag = 'R' THEN 'llm_grounded' ELSE 'jsonld' END AS extraction_method")
    p = t.part.selectExpr("p_partkey AS product_id", "CASE WHEN p_type = 'LARGE' THEN 'llm_grounded' ELSE 'manual' END AS extraction_method")
    return V.grounded_provenance(p, ev, "product_id").select("product_id", "grounded")


def _gold_input(t):
    d = phrase_lists(t).withColumn("usage", usage_text())
    return d.join(ratios(t).select("doc_id", "known_ratio"), "doc_id", "left").join(t.labels, "doc_id", "left")


def evaluated(t):
    c = F.col
    name = F.concat(F.regexp_replace(F.left("text", F.lit(30)), r"\s+", " "), F.lit(" 10ml"))
    g = V.gold_gate(
        name, c("items"), c("text"), c("usage"), F.when(c("lang") != "es", "https://x.example.com/a.jpg"), c("lang"),
        F.when(c("n_chars") < 120, "quarantined").otherwise("active"), F.coalesce(c("toxic") == 1, F.lit(False)), F.when(c("source") == "src3", "non_hair:x"),
        c("source") == "src5", c("known_ratio"), F.coalesce(c("quality") == 1, F.lit(True)), FIELDS)
    return once(_gold_input(t), ["doc_id", "source"], "g", g).select("doc_id", "source", F.col("g.gold_status").alias("gold_status"), F.col("g.blockers").alias("blockers"))


_NAME = r"regexp_replace(left(text, 30), '\s+', ' ', 'g') || ' 10ml'"
_GOLD = f"""{_KR}, {checked_sql(PHRASES).replace("raw AS (SELECT doc_id, lang, source, n_chars, text,", "raw AS (SELECT doc_id, lang, source, n_chars, text, " + USAGE + " AS u, ")},
iss2 AS ({_ISSUES.replace("raw AS", "WITH raw AS", 1)} SELECT doc_id, issues FROM fin),
nm AS (SELECT doc_id, {X.trim(_NAME)} AS s FROM documents),
nq AS (SELECT doc_id, greatest(0, least(100, 50 + CASE WHEN regexp_matches(lower(s), '(^|[^0-9a-zà-ÿ_])(the|la|die|el)($|[^0-9a-zà-ÿ_])') THEN 40 ELSE -30 END - CASE WHEN regexp_matches(s, '^[a-z][a-z\\sçãáéíóúâêôõà]+$') THEN 30 ELSE 0 END - CASE WHEN regexp_matches(s, '\\?$') THEN 35 ELSE 0 END)) >= 60 AS good FROM nm),
j AS (SELECT res.*, iss2.issues, nq.good, n_known / n_terms AS ratio, coalesce(toxic = 1, false) AS hid, coalesce(quality = 1, true) AS grd,
 {_REAL} AS real, {X.trim('u')} AS us, {X.trim('text')} AS des, {X.rep("lower(" + X.collapse("strip_accents(" + X.trim('text') + ")") + ")", r"^[^\w]+")} AS lab,
 list_filter(iss2.issues, lambda x: starts_with(x, 'inci_') AND ends_with(x, ':error')) AS errs, list_filter(iss2.issues, lambda x: starts_with(x, 'inci_') AND ends_with(x, ':warning')) AS wrns
 FROM res JOIN iss2 USING (doc_id) JOIN nq USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN labels USING (doc_id)),
b AS (SELECT doc_id, source, reason = '' AND len(errs) = 0 AS clean, lab IN ('the','of','der','und') OR (contains(left(lab,80),'the')::INT + contains(left(lab,80),'of')::INT + contains(left(lab,80),'der')::INT + contains(left(lab,80),'und')::INT) >= 2 AS islab, * EXCLUDE (doc_id, source) FROM j),
tri AS (SELECT doc_id, source, list_filter([CASE WHEN n_chars < 120 THEN 'quarantined|verification_status|error' END, CASE WHEN hid THEN 'hidden|is_hidden|error' END, CASE WHEN source = 'src3' THEN 'non_hair|hair_relevance_reason|error' END,
  CASE WHEN NOT good THEN 'name_low_quality|product_name|error' END], lambda x: x IS NOT NULL) AS d,
 list_filter([CASE WHEN reason <> '' THEN 'inci_invalid:' || reason || '|inci_ingredients|error' END, CASE WHEN reason = '' AND len(errs) > 0 THEN replace(errs[1], ':error', '') || '|inci_ingredients|error' END,
  CASE WHEN clean AND ratio < 0.3 THEN 'inci_garbage|inci_ingredients|error' END, CASE WHEN lang = 'es' THEN 'image_missing|image_url_main|error' END, CASE WHEN NOT real AND us = '' THEN 'usage_missing|usage_instructions|error' END,
  CASE WHEN NOT real AND us <> '' THEN 'usage_not_instructions|usage_instructions|error' END, CASE WHEN length(des) < 40 THEN 'desc_missing|description|error' END, CASE WHEN length(des) >= 40 AND islab THEN 'desc_is_label|description|error' END,
  CASE WHEN length(des) >= 40 AND NOT islab AND list_contains(issues, 'desc_is_inci_list:error') THEN 'desc_is_inci_list|description|error' END, CASE WHEN lang NOT IN ('en','fr') THEN 'category_invalid|product_category|error' END,
  CASE WHEN source = 'src5' THEN 'is_kit|is_kit|error' END], lambda x: x IS NOT NULL) AS q,
 list_filter([CASE WHEN clean AND len(wrns) > 0 THEN replace(wrns[1], ':warning', '') || '|inci_ingredients|warning' END, CASE WHEN clean AND ratio >= 0.3 AND ratio < 0.6 THEN 'inci_low_known_ratio|inci_ingredients|warning' END,
  CASE WHEN clean AND NOT grd THEN 'inci_llm_only|inci_ingredients|warning' END], lambda x: x IS NOT NULL) AS s FROM b),
gold AS (SELECT doc_id, source, CASE WHEN len(d) > 0 THEN 'raw' WHEN len(q) > 0 THEN 'catalog' WHEN len(s) > 0 THEN 'gold_candidate' ELSE 'gold' END AS gold_status, list_concat(list_concat(d, q), s) AS blockers FROM tri)"""


@query("gold_gate", f"WITH {_GOLD} SELECT doc_id, gold_status, array_to_string(blockers, ',') AS blockers FROM gold")
def gold_gate(t):
    text = F.transform("blockers", lambda b: F.concat_ws("|", b["code"], b["field"], b["severity"]))
    return evaluated(t).select("doc_id", "gold_status", F.array_join(text, ",").alias("blockers"))


def cif(c: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT)"


_FUNNEL = f"""{N} AS total, {cif("gold_status='gold'")} AS gold, {cif("gold_status='gold_candidate'")} AS gold_candidate, {cif("gold_status='catalog'")} AS catalog, {cif("gold_status='raw'")} AS raw,
 {cif("gold_status='gold_rejected'")} AS gold_rejected, {cif("gold_status='catalog' AND len(list_distinct(list_transform(list_filter(blockers, lambda x: ends_with(x, '|error')), lambda x: split_part(x, '|', -2)))) = 1")} AS one_field_away,
 round(count(*) FILTER (WHERE gold_status='gold') / greatest(count(*), 1), 4) AS gold_rate"""


@query("gold_funnel", f"WITH {_GOLD} SELECT {_FUNNEL} FROM gold")
def gold_funnel(t):
    return R.gold_funnel(evaluated(t))


@query("gold_funnel_by_source", f"WITH {_GOLD} SELECT source, {_FUNNEL} FROM gold GROUP BY source")
def gold_funnel_by_source(t):
    return R.gold_funnel(evaluated(t), "source")


@query("gold_gaps", f"WITH {_GOLD}, e AS (SELECT unnest(list_distinct(list_transform(blockers, lambda x: split_part(x, '|', -2)))) AS field FROM gold WHERE gold_status NOT IN ('gold','gold_rejected')) SELECT field, {N} AS n FROM e GROUP BY 1")
def gold_gaps(t):
    return R.gold_gaps(evaluated(t))


@query("gold_applied", f"WITH {_GOLD} SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 1 THEN 'gold_rejected' ELSE gold_status END AS gold_status, coalesce(toxic, 0) <> 1 AS stamped FROM gold LEFT JOIN labels USING (doc_id)")
def gold_applied(t):
    d = evaluated(t).withColumnRenamed("gold_status", "fresh").join(t.labels, "doc_id", "left").withColumn("gold_status", F.when(F.col("toxic") == 1, "gold_rejected"))
    ev = F.struct(F.col("fresh").alias("gold_status"), F.col("blockers"))
    return V.apply_gold(d, ev).select("doc_id", "gold_status", F.col("gold_evaluated_at").isNotNull().alias("stamped"))


_QA_NAME = X.trim(_NAME)


@query("qa_gate", f"""WITH {checked_sql(PHRASES)}, nm AS (SELECT doc_id, {_QA_NAME} AS s FROM documents),
q AS (SELECT res.*, s, contains(lower(s), 'ungheit') AS g1, regexp_matches(lower(s), '^\\s*(la)\\s+') AS g2,
 list_filter([CASE WHEN NOT regexp_matches(lower(s), '(^|[^0-9a-zà-ÿ_])(the|la|die|el)($|[^0-9a-zà-ÿ_])') THEN 'sem_sinal_forte' END, CASE WHEN regexp_matches(s, '^[a-z][a-z\\sçãáéíóúâêôõà]+$') THEN 'tudo_lowercase' END, CASE WHEN regexp_matches(s, '\\?$') THEN 'pergunta' END], lambda x: x IS NOT NULL) AS iss,
 greatest(0, least(100, 50 + CASE WHEN regexp_matches(lower(s), '(^|[^0-9a-zà-ÿ_])(the|la|die|el)($|[^0-9a-zà-ÿ_])') THEN 40 ELSE -30 END - CASE WHEN regexp_matches(s, '^[a-z][a-z\\sçãáéíóúâêôõà]+$') THEN 30 ELSE 0 END - CASE WHEN regexp_matches(s, '\\?$') THEN 35 ELSE 0 END)) AS score FROM res JOIN nm USING (doc_id)),
f AS (SELECT *, CASE WHEN source = 'src3' THEN 'non_hair:x' WHEN source = 'src4' THEN 'blocked:waf' ELSE 'hair_keyword:x' END AS why, list_filter([CASE WHEN g1 THEN 'name_garbage' WHEN g2 THEN 'name_editorial_or_invalid' WHEN score < 60 THEN 'name_low_quality:' || array_to_string(iss[1:3], ',') END,
 CASE WHEN source = 'src6' THEN 'domain_unofficial' END, CASE WHEN lang = 'es' THEN 'no_image' END, CASE WHEN source = 'src3' THEN 'non_hair:x' END], lambda x: x IS NOT NULL) AS bad FROM q)
SELECT doc_id, CASE WHEN source = 'src4' THEN 'quarantined' WHEN len(bad) > 0 THEN 'quarantined' WHEN lang = 'fr' THEN 'catalog_only' WHEN reason <> '' THEN 'quarantined' WHEN n_chars < 700 THEN 'quarantined' ELSE 'verified_inci' END AS status,
 CASE WHEN source = 'src4' THEN 'waf' WHEN len(bad) > 0 THEN array_to_string(bad, '; ') WHEN lang = 'fr' THEN '' WHEN reason <> '' THEN reason WHEN n_chars < 700 THEN 'confidence 0.5 < 0.8' ELSE '' END AS reason FROM f""")
def qa_gate(t):
    c = F.col
    d = phrase_lists(t)
    name = F.concat(F.regexp_replace(F.left("text", F.lit(30)), r"\s+", " "), F.lit(" 10ml"))
    url = F.concat(F.lit("https://"), F.when(c("source") == "src6", "bad.org").otherwise("shop.example.com"), F.lit("/p"))
    why = F.when(c("source") == "src3", "non_hair:x").when(c("source") == "src4", "blocked:waf").otherwise("hair_keyword:x")
    g = V.qa_gate(name, url, F.when(c("lang") != "es", "i"), why, F.when(c("lang") != "fr", c("items")), F.lit(None).cast("string"),
                  F.when(c("n_chars") < 700, 0.5).otherwise(0.9), ["example.com"], False, rules=FIELDS, garbage_words=["ungheit"], garbage_patterns=[r"^\s*(la)\s+"])
    return d.select("doc_id", g.alias("g")).select("doc_id", F.col("g.status").alias("status"), F.col("g.reason").alias("reason"))


@query("confidence_scores", P + f""", {BRIDGE_SQL}, b AS (SELECT ingredient_id AS product_id, {N} AS n, CAST(count(*) FILTER (WHERE position <= 3) AS BIGINT) AS v FROM bridge GROUP BY 1)
SELECT p.product_id, round(((1 + (product_category IS NOT NULL)::INT + 1 + (price IS NOT NULL)::INT + (NOT is_kit)::INT + (image_url_main IS NOT NULL)::INT) / 6.0::DOUBLE * 0.40::DOUBLE
 + CASE WHEN NOT is_kit AND coalesce(n, 0) > 0 THEN v / n ELSE 0 END * 0.35::DOUBLE + CASE status_editorial WHEN 'em_revisao' THEN 0.5 WHEN 'aprovado' THEN 1.0 WHEN 'corrigido' THEN 1.0 ELSE 0.0 END::DOUBLE * 0.25::DOUBLE) * 100, 2) AS score
FROM products p LEFT JOIN b USING (product_id)""")
def confidence_scores(t):
    c = F.col
    counts = bridge(t).groupBy(c("ingredient_id").alias("product_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("position") <= 3).alias("v"))
    p = products(t).join(counts, "product_id", "left")
    filled = [F.lit(True), c("product_category").isNotNull(), F.lit(True), c("price").isNotNull(), ~c("is_kit"), c("image_url_main").isNotNull()]
    s = V.confidence_score(filled, ~c("is_kit"), F.coalesce("v", F.lit(0)), F.coalesce("n", F.lit(0)), c("status_editorial"))
    return p.select("product_id", s["score"].alias("score"))


_DQ = "((size_volume IS NOT NULL)::INT + (price IS NOT NULL)::INT + (image_url_main IS NOT NULL)::INT + (product_category IS NOT NULL)::INT)"


def quality(t):
    cols = [F.col(c).isNotNull() for c in ("size_volume", "price", "image_url_main", "product_category")]
    return products(t).withColumn("pct", V.data_quality_pct(cols))


@query("data_quality", P + f"SELECT product_id, CAST(round({_DQ} * 100 / 4.0::DOUBLE, 0) AS INT) AS pct FROM products")
def data_quality(t):
    return quality(t).select("product_id", "pct")


@query("worst_quality", P + f"""SELECT product_id, CAST(least({_DQ} * 25, CASE WHEN regexp_matches(lower(product_name), '(^|[^0-9a-zà-ÿ_])(gear|widget)($|[^0-9a-zà-ÿ_])') AND regexp_matches(product_name, '\\d+ml') THEN 90
  WHEN regexp_matches(lower(product_name), '(gear|widget)') AND false THEN 0 ELSE greatest(0, 20 - CASE WHEN NOT regexp_matches(product_name, '\\d') THEN 30 ELSE 0 END - CASE WHEN length(product_name) < 15 AND NOT regexp_matches(product_name, '\\d+ml') THEN 15 ELSE 0 END) END) AS INT) AS worst
FROM products WHERE least({_DQ} * 25, CASE WHEN regexp_matches(lower(product_name), '(^|[^0-9a-zà-ÿ_])(gear|widget)($|[^0-9a-zà-ÿ_])') AND regexp_matches(product_name, '\\d+ml') THEN 90 ELSE 20 END) >= 50""")
def worst_quality(t):
    return V.worst_quality_filter(quality(t), F.col("pct"), "product_name", 50, "gear|widget").select("product_id", "worst")


@query("promotion_requests", f"""WITH {checked_sql(PHRASES)} SELECT doc_id, CASE WHEN lang = 'en' AND reason <> '' THEN 'catalog_only' WHEN lang = 'en' THEN 'verified_inci' ELSE 'catalog_only' END AS granted, lang = 'en' AND reason <> '' AS downgraded FROM res""")
def promotion_requests(t):
    asked = F.when(F.col("lang") == "en", "verified_inci").otherwise("catalog_only")
    return V.promotable(phrase_lists(t), "items", asked, RULES).select("doc_id", "granted", "downgraded")


@query("promotion_counts", f"""WITH {checked_sql(PHRASES)} SELECT CASE WHEN lang = 'en' AND reason = '' THEN 'verified_inci' ELSE 'catalog_only' END AS granted, {N} AS n, CAST(count(*) FILTER (WHERE lang = 'en' AND reason <> '') AS BIGINT) AS downgraded FROM res GROUP BY 1""")
def promotion_counts(t):
    asked = F.when(F.col("lang") == "en", "verified_inci").otherwise("catalog_only")
    return V.promotable(phrase_lists(t), "items", asked, RULES).groupBy("granted").agg(F.count(F.lit(1)).alias("n"), F.count_if("downgraded").alias("downgraded"))


