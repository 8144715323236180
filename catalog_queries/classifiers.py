"""Classifier queries: the operators with word lists of the synthetic tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.functions import lists as L
from shelfgrade.functions import text as T
from shelfgrade.operators import classify as C
from shelfgrade.operators import reports as R

from shelfgrade.vocab import market as M

from . import sqlx as X
from .base import DOCS_SQL, PRODUCTS_SQL, docs, products, query

P = f"WITH {PRODUCTS_SQL} "
N = "CAST(count(*) AS BIGINT)"

TYPES = [("tool", ["gear", "bolt"]), ("toy", ["gizmo", "widget"]), ("wear", ["ring"]), ("cold", ["cold "]), ("hot", ["hot "])]
_TYPE_SQL = "CASE WHEN contains(lower(n),'gear') OR contains(lower(n),'bolt') THEN 'tool' WHEN contains(lower(n),'gizmo') OR contains(lower(n),'widget') THEN 'toy' WHEN contains(lower(n),'ring') THEN 'wear' WHEN contains(lower(n),'cold ') THEN 'cold' WHEN contains(lower(n),'hot ') THEN 'hot' END"


@query("product_types", P + f"SELECT product_id, coalesce({_TYPE_SQL.replace('lower(n)', 'lower(product_name)')}, '?') AS product_type FROM products")
def product_types(t):
    return products(t).select("product_id", F.coalesce(C.product_type("product_name", TYPES), F.lit("?")).alias("product_type"))


@query("categories", P + f"""SELECT product_id, coalesce(CASE WHEN contains(lower(product_name),'red') OR contains(lower(product_name),'blue') THEN 'coloracao'
 ELSE CASE {_TYPE_SQL.replace('lower(n)', 'lower(product_name)')} WHEN 'tool' THEN 'hardware' WHEN 'wear' THEN 'soft' WHEN 'toy' THEN 'soft' END END, '?') AS category FROM products""")
def categories(t):
    c = C.category(C.product_type("product_name", TYPES), "product_name", ["red", "blue"], {"tool": "hardware", "wear": "soft", "toy": "soft"})
    return products(t).select("product_id", F.coalesce(c, F.lit("?")).alias("category"))


@query("gender_targets", P + """SELECT product_id, CASE WHEN contains(lower(s),'old') THEN 'unisex' WHEN contains(lower(s),'small') OR contains(lower(s),'brand-2') THEN 'kids' WHEN contains(lower(s),'hot') THEN 'men' ELSE 'unknown' END AS gender
 FROM (SELECT product_id, product_name || ' ' || product_url AS s FROM products)""")
def gender_targets(t):
    return products(t).select("product_id", C.gender_target("product_name", "product_url", ["old"], ["small", "brand-2"], ["hot"]).alias("gender"))


_B = "(^|[^0-9a-zà-ÿ_])"
_E = "([^0-9a-zà-ÿ_]|$)"


@query("domain_relevance", f"""WITH d AS (SELECT doc_id, lower(left(text, 60)) AS n, lower(text) || ' ' || lower('https://' || source) AS x FROM documents),
r AS (SELECT doc_id, CASE WHEN regexp_matches(n, '{_B}der{_E}') THEN 'non_hair:der' WHEN contains(n, 'ungheit') THEN 'non_hair:ungheit'
 WHEN regexp_matches(n, '{_B}the{_E}') THEN 'hair_keyword:the' WHEN contains(n, 'eauaux') THEN 'hair_keyword:eauaux' WHEN regexp_matches(n, '{_B}la{_E}') THEN 'hair_type:la'
 WHEN regexp_matches(x, '{_B}der{_E}') THEN 'non_hair_url:der' WHEN contains(x, 'ungheit') THEN 'non_hair_url:ungheit'
 WHEN regexp_matches(x, '{_B}the{_E}') THEN 'hair_keyword_url:the' WHEN contains(x, 'eauaux') THEN 'hair_keyword_url:eauaux' ELSE 'no_hair_keyword' END AS reason FROM d)
SELECT doc_id, reason, starts_with(reason, 'hair_') AS relevant FROM r""")
def domain_relevance(t):
    v = C.domain_relevance(F.left("text", F.lit(60)), F.concat(F.lit("https://"), "source"), "text", ["der", "ungheit"], ["the", "eauaux"], ["la"])
    return t.documents.select("doc_id", v["reason"].alias("reason"), v["relevant"].alias("relevant"))


@query("kit_flags", P + r"SELECT product_id, regexp_matches(lower(product_url), '/small-|/red-') OR regexp_matches(lower(product_name), '^\s*(kit|combo|duo|trio)\s') AS kit FROM products")
def kit_flags(t):
    return products(t).select("product_id", C.is_kit("product_url", "product_name", ["/small-", "/red-"]).alias("kit"))


_URL_CASE = """CASE WHEN regexp_matches(low, '/es/') THEN 'kit' WHEN regexp_matches(split_part(low,'?',1), '(^|.*)/de(/.*|$)') THEN 'non_hair'
 WHEN list_has_any(list_transform(string_split(regexp_replace(split_part(low,'?',1), '^[^/]*//[^/]*/?', ''), '/'), lambda s: replace(s, '.html', '')), ['474','148']) THEN 'other'
 WHEN regexp_matches(split_part(low,'?',1), '/products/[\\w][\\w-]+') THEN 'product'
 WHEN contains(low, '?cgid=') OR contains(low, 'category=') THEN 'category'
 WHEN (contains(low, '/fr/') AND ends_with(regexp_replace(low, '/+$', ''), '/fr')) OR (contains(low, '/fr/') AND length(low) - length(replace(low,'/','')) <= 4 AND len(list_filter(string_split(split_part(low,'?',1),'/'), lambda s: s <> '')) <= 4 AND NOT regexp_matches(low, '\\.html$|/\\d\\d$')) THEN 'category'
 WHEN regexp_matches(low, '\\.html$|/\\d\\d$') THEN 'product'
 WHEN contains(low, 'blog') OR contains(low, 'spam-farm') THEN CASE WHEN len(list_filter(string_split(split_part(low,'?',1),'/')[4:], lambda s: s <> '')) >= 2 THEN 'product' ELSE 'category' END ELSE 'other' END"""
_URL_ARGS = dict(foreign=["de"], categories=["/fr/"], hints=[r"\.html$", r"/\d\d$"], info=["474", "148"], words=["blog", "spam farm"], kits=["/es/"])


@query("url_types", f"SELECT page_id, {_URL_CASE} AS url_type FROM (SELECT page_id, lower(url) AS low FROM pages)")
def url_types(t):
    return t.pages.select("page_id", C.url_type("url", **_URL_ARGS).alias("url_type"))


@query("url_type_counts", f"WITH u AS (SELECT {_URL_CASE} AS url_type FROM (SELECT lower(url) AS low FROM pages)) SELECT url_type, {N} AS n FROM u GROUP BY 1")
def url_type_counts(t):
    return R.value_counts(t.pages, C.url_type("url", **_URL_ARGS), "url_type")


_MARKS = [("feed", ["class=\"ad\"", "track\\(1"]), ("shop", ["therin", "<h1>the"]), ("blog", ["lang=\"es\"", "article"])]


@query("platforms", """WITH h AS (SELECT page_id, lower(html) AS s FROM pages)
SELECT page_id, CASE WHEN regexp_matches(s, 'track\\(1') THEN 'feed' WHEN regexp_matches(s, 'therin|<h1>the') THEN 'shop' WHEN regexp_matches(s, 'lang="es"|article') THEN 'blog' ELSE '?' END AS platform FROM h""")
def platforms(t):
    marks = [("feed", [r"track\(1"]), *_MARKS[1:]]
    return t.pages.select("page_id", F.coalesce(C.platform("html", None, marks), F.lit("?")).alias("platform"))


@query("platform_votes", """WITH h AS (SELECT page_id, lower(html) AS s FROM pages), v AS (SELECT page_id, regexp_matches(s,'class="ad"')::INT + regexp_matches(s,'track\\(1')::INT AS a,
 regexp_matches(s,'therin')::INT + regexp_matches(s,'<h1>the')::INT AS b, regexp_matches(s,'lang="es"')::INT + regexp_matches(s,'article')::INT AS c FROM h)
SELECT page_id, CASE WHEN greatest(a,b,c) = 0 THEN '?' WHEN a >= b AND a >= c THEN 'feed' WHEN b >= c THEN 'shop' ELSE 'blog' END AS platform FROM v""")
def platform_votes(t):
    return t.pages.select("page_id", F.coalesce(C.platform_votes("html", _MARKS), F.lit("?")).alias("platform"))


@query("blocked_pages", "SELECT page_id, contains(lower(html), 'ungheit') OR contains(lower(html), 'eauaux') AS blocked FROM pages")
def blocked_pages(t):
    return t.pages.select("page_id", C.blocked_page("html", marks=["ungheit", "eauaux"]).alias("blocked"))


_TIER = """WITH p AS (SELECT page_id, url, length(html) AS len, contains(lower(html), 'track(1') AS blocked, CASE WHEN contains(url, '/en/') THEN 'vtex' WHEN contains(url, '/fr/') THEN 'own' END AS plat, contains(url, 'www.') AS sitemap,
 CASE WHEN contains(url, '/es/') THEN 'blocked' ELSE 'active' END AS status FROM pages),
x AS (SELECT page_id, CASE WHEN status = 'blocked' THEN 'tier_skip' WHEN NOT starts_with(url, 'https') THEN 'tier_4_no_site' WHEN blocked THEN 'tier_5_waf' WHEN len < 3000 THEN 'tier_4_no_site'
 WHEN plat = 'vtex' AND sitemap THEN 'tier_1_easy' WHEN plat = 'vtex' THEN 'tier_2_check' ELSE 'tier_3_custom' END AS tier FROM p)"""


def tiers(t):
    c = F.col
    status = F.when(c("url").contains("/es/"), "blocked").otherwise("active")
    plat = F.when(c("url").contains("/en/"), "vtex").when(c("url").contains("/fr/"), "own")
    code = F.when(F.length("html") < 3000, 404).otherwise(200)
    return t.pages.select("page_id", C.brand_tier(status, F.startswith("url", F.lit("https")), code, F.length("html"),
                          F.contains(F.lower("html"), F.lit("track(1")), plat, c("url").contains("www."), F.lit("yes")).alias("tier"))


@query("brand_tiers", _TIER + " SELECT page_id, tier FROM x")
def brand_tiers(t):
    return tiers(t)


@query("tier_summary", _TIER + f" SELECT tier, {N} AS n FROM x GROUP BY 1")
def tier_summary(t):
    return R.value_counts(tiers(t), F.col("tier"), "tier")


#: Every line of every document as a name.
_LINES = "(SELECT doc_id, CAST(i - 1 AS INT) AS i, ls[i] AS name FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


def lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "name"))


_NQ = "d AS (SELECT doc_id, i, trim(name, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM " + _LINES + r"""),
f AS (SELECT doc_id, i, s, lower(s) AS low, len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) AS words FROM d),
g AS (SELECT *, regexp_matches(low, '(^|[^0-9a-zà-ÿ_])\d+(\.\d+)?\s*(ml|g|kg|l|oz)($|[^0-9a-zà-ÿ_])') AS vol, regexp_matches(low, '(^|[^0-9a-zà-ÿ_])(the|la|die|el)($|[^0-9a-zà-ÿ_])') AS typ, regexp_matches(low, '^(kit|combo)($|[^0-9a-zà-ÿ_])') AS kit FROM f),
n AS (SELECT doc_id, i, CASE WHEN vol AND typ THEN 'volume+tipo' WHEN kit AND words >= 3 THEN 'kit+desc' WHEN typ AND words >= 3 THEN 'tipo+contexto' ELSE '' END AS signal,
 greatest(0, least(100, 50 + CASE WHEN vol AND typ THEN 40 WHEN kit AND words >= 3 THEN 30 WHEN typ AND words >= 3 THEN 20 ELSE -30 END
 - CASE WHEN regexp_matches(s, '^[a-z][a-z\sçãáéíóúâêôõà]+$') AND words >= 2 THEN 30 ELSE 0 END - CASE WHEN regexp_matches(s, '\?$') THEN 35 ELSE 0 END
 - CASE WHEN regexp_matches(s, '^[^!]*!$') AND words <= 6 THEN 25 ELSE 0 END - CASE WHEN length(s) < 15 AND NOT vol THEN 15 ELSE 0 END - CASE WHEN length(s) >= 80 THEN 10 ELSE 0 END)) AS score FROM g)"""


@query("name_quality", f"WITH {_NQ} SELECT doc_id, i, signal, CAST(score AS INT) AS score, score >= 60 AS valid FROM n")
def name_quality(t):
    q = C.name_quality("name", "the|la|die|el")
    return lines(t).select("doc_id", "i", F.array_join(q["signals"], "").alias("signal"), q["score"].alias("score"), q["valid"].alias("valid"))


@query("garbage_names", "WITH n AS (SELECT doc_id, i, lower(trim(name, ' ' || chr(10) || chr(9) || chr(13))) AS s FROM " + _LINES + r""")
SELECT doc_id, i, CASE WHEN contains(s, 'ungheit') OR contains(s, 'aux ') THEN 'name_garbage' WHEN regexp_matches(s, '^\s*(the|la)\s+|(?:\d+\s+th)') THEN 'name_editorial_or_invalid' ELSE 'ok' END AS code FROM n""")
def garbage_names(t):
    code = C.garbage_name(F.col("name"), ["ungheit", "aux "], [r"^\s*(the|la)\s+", r"\d+\s+th"])
    return lines(t).select("doc_id", "i", F.coalesce(code, F.lit("ok")).alias("code"))


@query("junk_names", "SELECT doc_id, i, name LIKE 'The %' OR name LIKE '%ung%' OR name LIKE 'La %que%' OR length(trim(name)) < 6 AS junk FROM " + _LINES)
def junk_names(t):
    return lines(t).select("doc_id", "i", C.junk_name("name", ["The %", "%ung%", "La %que%"]).alias("junk"))


@query("safe_names", P + r"SELECT product_id, regexp_matches(lower(product_name), '(^|[^0-9a-zà-ÿ_])(gear|bolt)') AND regexp_matches(lower(product_name), '\d+\s*(ml|g|kg|l)($|[^0-9a-zà-ÿ_])') AS safe FROM products")
def safe_names(t):
    return products(t).select("product_id", C.safe_name("product_name", "gear|bolt").alias("safe"))


@query("non_domain_names", P + "SELECT product_id, contains(product_name,'gizmo') OR contains(product_name,'old ') AS off FROM products")
def non_domain_names(t):
    return products(t).select("product_id", C.non_domain_name("product_name", ["gizmo", "old "]).alias("off"))


@query("listing_pages", "WITH p AS (SELECT page_id, regexp_replace(split_part(split_part(url,'#',1),'?',1), '/+$', '') AS path FROM pages) SELECT page_id, NOT ends_with(path, '.html') AND (contains(path, '/fr/') OR contains(path, 'blog')) AS listing FROM p")
def listing_pages(t):
    return t.pages.select("page_id", C.listing_page("url", ["/fr/", "blog"]).alias("listing"))


_LABELS = ["the", "of", "de la", "der", "and", "que"]


@query("tab_noise", "WITH n AS (SELECT doc_id, " + X.rep("lower(" + X.collapse("strip_accents(text)") + ")", r"^[^\w]+") + " AS s FROM documents) SELECT doc_id, s IN ('the','of','de la','der','and','que') OR ("
       + " + ".join(f"contains(left(s, 80), '{w}')::INT" for w in _LABELS) + ") >= 2 AS noise FROM n")
def tab_noise(t):
    return t.documents.select("doc_id", C.tab_noise("text", _LABELS).alias("noise"))


@query("list_like_texts", "SELECT doc_id, length(p) >= 30 AND regexp_matches(p, '[,;●•·]') AND NOT (contains(lower(p), 'ungheit') OR contains(lower(p), 'tion ')) AS listy, length(p) >= 30 AND regexp_matches(p, '[,;●•·]') AS in_section FROM (SELECT doc_id, text AS p FROM documents)")
def list_like_texts(t):
    p = F.col("text")
    return t.documents.select("doc_id", C.list_like(p, False, ["ungheit", "tion "]).alias("listy"), C.list_like(p, True).alias("in_section"))


@query("list_or_composition", r"""WITH d AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'ingredients_inci' ELSE 'composition' END AS field, text,
 len(list_intersect(list_distinct(list_transform(string_split_regex(lower(text), '\s+'), lambda w: trim(w, ',.;:()'))), ['the','of','and','de','der','la'])) >= 3 AS strong,
 length(text) >= 30 AND regexp_matches(text, '[,;●•·]') AND NOT contains(lower(text), 'ation') AS listy FROM documents)
SELECT doc_id, CASE WHEN field='ingredients_inci' AND NOT (listy OR strong) THEN 'composition' WHEN field='composition' AND strong THEN 'ingredients_inci' ELSE field END AS field FROM d""")
def list_or_composition(t):
    f = F.when(F.col("n_chars") % 2 == 0, "ingredients_inci").otherwise("composition")
    return t.documents.select("doc_id", C.list_or_composition(f, "text", ["the", "of", "and", "de", "der", "la"], ["ation"]).alias("field"))


@query("real_lists", r"""WITH d AS (SELECT doc_id, lower(text) AS s FROM documents) SELECT doc_id, regexp_matches(s, '(^|[^0-9a-zà-ÿ_])(of|die|que)([^0-9a-zà-ÿ_]|$)')
 AND regexp_matches(left(s, 600), '(^|[^0-9a-zà-ÿ_])(the|la)(|[^0-9a-zà-ÿ_.\n][^.\n]{0,399})[,;|/]') AS real FROM d""")
def real_lists(t):
    return t.documents.select("doc_id", C.real_list("text", "of|die|que", "the|la").alias("real"))


_SEALS = [("small", ["tion of", "der die"]), ("bright", ["the", "les"]), ("plain", ["que", "und"])]


def _seal_sql() -> str:
    parts = []
    for seal, words in _SEALS:
        for rank, f in enumerate(("head", "body")):
            for i, w in enumerate(words):
                parts.append(f"SELECT doc_id, '{seal}' AS seal, '{w}' AS keyword, '{f}' AS field, {rank} AS fr, {i} AS kr FROM f WHERE regexp_matches({f}, '(^|[^0-9a-z_À-ÖØ-öø-ÿ])({w})($|[^0-9a-z_À-ÖØ-öø-ÿ])')")
    return " UNION ALL ".join(parts)


@query("detected_seals", "WITH f AS (SELECT doc_id, strip_accents(lower(left(text, 100))) AS head, strip_accents(lower(text)) AS body FROM documents), h AS (" + _seal_sql()
       + "), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seal ORDER BY fr, kr) AS rn FROM h) SELECT doc_id, seal, keyword, field FROM r WHERE rn = 1")
def detected_seals(t):
    d = t.documents.select("doc_id", F.left("text", F.lit(100)).alias("head"), F.col("text").alias("body"))
    return C.detect_seals(d, "doc_id", ["head", "body"], _SEALS).select("doc_id", "seal", "keyword", "field")


@query("seals_in_images", "WITH f AS (SELECT doc_id, strip_accents(lower(left(text, 100))) AS head, replace(strip_accents(lower(text)), chr(10), ' ' || chr(10) || ' ') AS body FROM documents), h AS (" + _seal_sql()
       + ") SELECT DISTINCT doc_id, seal FROM h WHERE field = 'body' AND (doc_id, seal) NOT IN (SELECT (doc_id, seal) FROM h WHERE field = 'head')")
def seals_in_images(t):
    d = t.documents.select("doc_id", F.left("text", F.lit(100)).alias("head"), F.split("text", "\n").alias("images"))
    found = C.detect_seals(d, "doc_id", ["head"], _SEALS)
    return C.detect_seals_in_images(d, "doc_id", "images", found, _SEALS).select("doc_id", "seal")


@query("inferred_seals", """WITH d AS (SELECT doc_id, lower(replace(text, ',', chr(10))) AS s FROM documents),
f AS (SELECT doc_id, regexp_matches(s,'ion') AS silicone, regexp_matches(s,'ing|eau') AS sulfate, regexp_matches(s,'the') AS paraben, regexp_matches(s,'der|la') AS petro, regexp_matches(s,'que') OR regexp_matches(s,'(^|[^0-9a-zà-ÿ_])ci\\s*\\d{4,5}($|[^0-9a-zà-ÿ_])') AS dye, regexp_matches(s,'ou') AS nopoo FROM d)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT silicone THEN 'silicone_free' END, CASE WHEN NOT sulfate THEN 'sulfate_free' END, CASE WHEN NOT paraben THEN 'paraben_free' END, CASE WHEN NOT petro THEN 'petrolatum_free' END,
 CASE WHEN NOT dye THEN 'dye_free' END, CASE WHEN NOT sulfate THEN 'low_poo' END, CASE WHEN NOT nopoo AND NOT silicone THEN 'no_poo' END], lambda x: x IS NOT NULL), ',') AS seals FROM f""")
def inferred_seals(t):
    items = F.split("text", ",")
    s = C.infer_seals(items, ["ing", "eau"], ["ion"], ["ou"], ["the"], ["der", "la"], ["que"])
    return t.documents.select("doc_id", F.array_join(s, ",").alias("seals"))


@query("seal_confidence", """SELECT doc_id, CASE WHEN q > 0 AND n_chars > 900 THEN 0.9 WHEN q > 0 THEN 0.8 WHEN n_chars > 900 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT doc_id, n_chars, length(text) - length(replace(text, '|', '')) AS q FROM documents)""")
def seal_confidence(t):
    return t.documents.select("doc_id", C.seal_confidence(L._count(F.col("text"), "|"), F.when(F.col("n_chars") > 900, 1).otherwise(0)).alias("confidence"))


_HT = [("liso", ["the", "les"]), ("crespo", ["würd", "ea"]), ("seco", ["que"])]
_W = "(^|[^0-9a-z_]){}(s|es)?($|[^0-9a-z_])"


def _hit(col: str, w: str) -> str:
    return f"regexp_matches({col}, '{_W.format('(' + w + ')')}')"


@query("hair_types", f"""WITH d AS (SELECT doc_id, lower(strip_accents(left(text, 50))) AS n, trim(lower(strip_accents(left(text, 50))) || ' ' || lower(strip_accents(text))) AS b FROM documents),
h AS (SELECT doc_id, {_hit('b', 'the|les')} AS l, {_hit('b', 'wurd|ea')} AS c, {_hit('b', 'que')} AS s, contains(n, CASE WHEN {_hit('b', 'the')} THEN 'the' ELSE 'les' END) AS ln, contains(n, CASE WHEN {_hit('b', 'wurd')} THEN 'wurd' ELSE 'ea' END) AS cn, contains(n, 'que') AS sn FROM d)
SELECT doc_id, array_to_string(list_filter([CASE WHEN l THEN 'liso' END, CASE WHEN c THEN 'crespo' END, CASE WHEN s THEN 'seco' END], lambda x: x IS NOT NULL), ',') AS types,
 least(100, CASE WHEN l THEN CASE WHEN ln THEN 40 ELSE 25 END ELSE 0 END + CASE WHEN c THEN CASE WHEN cn THEN 40 ELSE 25 END ELSE 0 END + CASE WHEN s THEN CASE WHEN sn THEN 40 ELSE 25 END ELSE 0 END) / 100.0::DOUBLE AS confidence FROM h""")
def hair_types(t):
    h = C.hair_types(F.left("text", F.lit(50)), "text", _HT)
    return T.once(t.spread("documents"), ["doc_id"], "h", h).select("doc_id", F.array_join("h.types", ",").alias("types"), "h.confidence")


@query("audience_ages", f"""WITH d AS (SELECT doc_id, lower(strip_accents(left(text, 50))) AS n, trim(lower(strip_accents(left(text, 50))) || ' ' || lower(strip_accents(text))) AS b FROM documents)
SELECT doc_id, CASE WHEN {_hit('b', 'der')} THEN 'under_3' WHEN {_hit('b', 'que')} OR {_hit('b', 'les')} THEN 'kids' WHEN {_hit('b', 'ea')} THEN 'teen' ELSE 'adult' END AS age,
 CASE WHEN {_hit('b', 'der')} THEN CASE WHEN {_hit('n', 'der')} THEN 0.9 ELSE 0.7 END WHEN {_hit('b', 'que')} THEN CASE WHEN {_hit('n', 'que')} THEN 0.9 ELSE 0.7 END
 WHEN {_hit('b', 'les')} THEN CASE WHEN {_hit('n', 'les')} THEN 0.9 ELSE 0.7 END WHEN {_hit('b', 'ea')} THEN CASE WHEN {_hit('n', 'ea')} THEN 0.9 ELSE 0.7 END ELSE 0.5 END::DOUBLE AS confidence FROM d""")
def audience_ages(t):
    a = C.audience_age(F.left("text", F.lit(50)), "text", [("under_3", ["der"]), ("kids", ["que", "les"]), ("teen", ["ea"])])
    return T.once(t.spread("documents"), ["doc_id"], "a", a).select("doc_id", "a.age", "a.confidence")


_FN = [("limpar", ["es"], ["the"]), ("nutrir", ["fr"], ["que", "der"]), ("tratar", [], ["und"])]


@query("function_objectives", f"""WITH d AS (SELECT doc_id, lang, lower(strip_accents(left(text, 50))) AS n, trim(lower(strip_accents(left(text, 50))) || ' ' || lower(strip_accents(text))) AS b FROM documents)
SELECT doc_id, CASE WHEN lang='es' THEN 'limpar' WHEN lang='fr' THEN 'nutrir' WHEN {_hit('b', 'the')} THEN 'limpar' WHEN {_hit('b', 'que')} OR {_hit('b', 'der')} THEN 'nutrir' WHEN {_hit('b', 'und')} THEN 'tratar' ELSE '?' END AS func,
 CASE WHEN lang IN ('es','fr') THEN 0.9 WHEN {_hit('b', 'the')} THEN CASE WHEN {_hit('n', 'the')} THEN 0.75 ELSE 0.55 END WHEN {_hit('b', 'que')} THEN CASE WHEN {_hit('n', 'que')} THEN 0.75 ELSE 0.55 END
 WHEN {_hit('b', 'der')} THEN CASE WHEN {_hit('n', 'der')} THEN 0.75 ELSE 0.55 END WHEN {_hit('b', 'und')} THEN CASE WHEN {_hit('n', 'und')} THEN 0.75 ELSE 0.55 END ELSE 0.0 END::DOUBLE AS confidence FROM d""")
def function_objectives(t):
    f = C.function_objective(F.left("text", F.lit(50)), "lang", "text", _FN)
    return t.documents.select("doc_id", F.coalesce(f["function"], F.lit("?")).alias("func"), f["confidence"].alias("confidence"))


@query("applied_classification", f"""WITH d AS (SELECT doc_id, source, lang, lower(strip_accents(left(text, 50))) AS n, trim(lower(strip_accents(left(text, 50))) || ' ' || lower(strip_accents(text))) AS b FROM documents)
SELECT doc_id, CASE WHEN {_hit('b', 'der')} OR {_hit('b', 'que')} THEN CASE WHEN {_hit('b', 'der')} THEN 'under_3' ELSE 'kids' END ELSE source END AS audience_age,
 CASE WHEN lang='es' THEN 'limpar' WHEN lang='fr' THEN 'nutrir' WHEN {_hit('b', 'the')} THEN CASE WHEN {_hit('n', 'the')} THEN 'limpar' ELSE '-' END ELSE '-' END AS function_objective FROM d""")
def applied_classification(t):
    d = t.documents.select("doc_id", "lang", "text", F.left("text", F.lit(50)).alias("name"), F.col("source").alias("audience_age"), F.lit("-").alias("function_objective"))
    out = C.apply_classification(d, "name", "text", "lang", 0.6, _HT, [("under_3", ["der"]), ("kids", ["que"])], [("limpar", ["es"], ["the"]), ("nutrir", ["fr"], [])])
    return out.select("doc_id", "audience_age", "function_objective")


@query("ingredient_categories", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN regexp_matches(p_name, '^red|gear$') THEN 'a' WHEN regexp_matches(p_name, 'widget|^hot') THEN 'b' WHEN regexp_matches(p_name, 'old') THEN 'c' ELSE '?' END AS ingredient_category
 FROM lineitem JOIN part ON l_partkey = p_partkey""")
def ingredient_categories(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    out = C.ingredient_category(d, "p_name", [("a", ["^red", "gear$"]), ("b", ["widget", "^hot"]), ("c", ["old"])])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("ingredient_category", F.lit("?")).alias("ingredient_category"))


_ALLERGENS = [("strong", "high", ["the", "und"]), ("soft", "info", ["la", "de", "of"]), ("mid", "caution", ["que", "and"])]
_AL_SQL = r"""w AS (SELECT doc_id, list_transform(string_split_regex(text, '[ \n]'), lambda x: trim(lower(regexp_replace(strip_accents(x), '\s+', ' ', 'g')), ' .,;:*')) AS k FROM documents),
v AS (SELECT * FROM (VALUES ('the','strong','high',2), ('und','strong','high',2), ('la','soft','info',0), ('de','soft','info',0), ('of','soft','info',0), ('que','mid','caution',1), ('and','mid','caution',1)) AS x(name, cls, sev, r)),
h AS (SELECT DISTINCT doc_id, v.* FROM (SELECT doc_id, unnest(k) AS name FROM w) JOIN v USING (name))"""


@query("allergens", f"WITH {_AL_SQL} SELECT doc_id, string_agg(name || ':' || cls, ',' ORDER BY -r, name) AS found FROM h GROUP BY 1")
def allergens(t):
    d = t.documents.select("doc_id", C.allergens(F.split("text", "[ \n]"), _ALLERGENS).alias("a")).filter(F.size("a") > 0)
    return d.select("doc_id", F.array_join(F.transform("a", lambda h: F.concat(T.norm_entry(h["ingredient"]), F.lit(":"), h["allergen_class"])), ",").alias("found"))


@query("allergen_summaries", f"WITH {_AL_SQL} SELECT doc_id, CAST(count(*) AS INT) AS n, arg_max(sev, r) AS worst, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes FROM h GROUP BY 1")
def allergen_summaries(t):
    s = C.allergen_summary(C.allergens(F.split("text", "[ \n]"), _ALLERGENS))
    d = T.once(t.spread("documents"), ["doc_id"], "s", s).filter("s.count > 0")
    return d.select("doc_id", F.col("s.count").alias("n"), F.col("s.worst").alias("worst"), F.array_join("s.classes", ",").alias("classes"))


@query("routine_roles", r"""WITH w AS (SELECT doc_id, lang, list_transform(string_split(text, ' '), lambda x: trim(lower(regexp_replace(strip_accents(x), '\s+', ' ', 'g')), ' .,;:*')) AS k FROM documents)
SELECT doc_id, CASE lang WHEN 'en' THEN 'lavar' WHEN 'fr' THEN 'tratar' ELSE '?' END AS step, CASE WHEN list_has_any(k, ['than']) THEN 'intensa' WHEN list_has_any(k, ['que','und']) THEN 'suave' ELSE '?' END AS cleansing,
 list_has_any(k, ['with']) AS insoluble, list_has_any(k, ['from','les']) AS drying FROM w""")
def routine_roles(t):
    r = C.routine_role(F.split("text", " "), "lang", ["than"], ["que", "und"], ["with"], ["from", "les"], {"en": "lavar", "fr": "tratar"})
    return t.documents.select("doc_id", F.coalesce(r["step"], F.lit("?")).alias("step"), F.coalesce(r["cleansing"], F.lit("?")).alias("cleansing"),
                              r["insoluble_silicone"].alias("insoluble"), r["drying_alcohol"].alias("drying"))


_IN_ARGS = dict(safety="würz|ungheit|thea", product="que|und", product_verb="la|der", recommend="ent.+ion|on", routine="be|le")


@query("intents", r"""WITH m AS (SELECT conv_id, turn, trim(lower(strip_accents(text)), ' ' || chr(10) || chr(9) || chr(13)) AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN s = '' THEN 'geral' WHEN regexp_matches(s, '(?s)(^|[^0-9a-z_])(wurz|ungheit|thea)') THEN 'saude_couro'
 WHEN regexp_matches(s, '(?s)(^|[^0-9a-z_])(que|und)') AND regexp_matches(s, '(^|[^0-9a-z_])(la|der)($|[^0-9a-z_])') THEN 'analise_produto'
 WHEN regexp_matches(s, '(?s)(^|[^0-9a-z_])(ent.+ion|on)') THEN 'recomendacao' WHEN regexp_matches(s, '(?s)(^|[^0-9a-z_])(be|le)') THEN 'rotina_cuidado' ELSE 'geral' END AS intent FROM m""")
def intents(t):
    args = {**_IN_ARGS, "safety": "wurz|ungheit|thea"}
    return t.conversations.select("conv_id", "turn", C.intent("text", False, **args).alias("intent"))


def _profile():
    c = F.col
    return {
        "curl_type": F.when(c("c_nationkey") < 8, "liso").when(c("c_nationkey") < 16, "cacheado").otherwise("transicao"),
        "curl_subtype": F.when(c("c_acctbal") > 5000, "3b").when(c("c_acctbal") > 2000, "nao_sei").otherwise(""),
        "thickness": F.when(c("c_mktsegment") == "BUILDING", "finos").when(c("c_mktsegment") == "MACHINERY", "grossos").otherwise("medios"),
        "scalp_oiliness": F.when(c("c_acctbal") < 1000, "alta").when(c("c_acctbal") < 4000, "baixa").otherwise("normal"),
        "dryness_damage": F.when(c("c_nationkey") > 20, "bastante").when(c("c_nationkey") > 10, "um_pouco").otherwise("nao"),
        "chemical_treatments": F.when(c("c_mktsegment") == "HOUSEHOLD", F.array(F.lit("coloracao"))).when(
            c("c_mktsegment") == "FURNITURE", F.array(F.lit("alisamento"), F.lit("descoloracao"))).otherwise(F.array().cast("array<string>")),
        "heat_usage": F.when(c("c_nationkey") == 3, "diariamente").otherwise("raro"),
        "sun_exposure": F.when(c("c_nationkey") == 4, "alta").otherwise("baixa"), "water_exposure": F.lit("nunca"),
        "scalp_issues": c("c_acctbal") < 0,
    }


_PROF = """p AS (SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN 'liso' WHEN c_nationkey < 16 THEN 'cacheado' ELSE 'transicao' END AS curl, c_acctbal AS bal, c_nationkey AS k, c_mktsegment AS seg FROM customer)"""


@query("profile_types", f"""WITH {_PROF}, l AS (SELECT c_custkey, list_filter([CASE WHEN bal > 5000 THEN 'cacheado' WHEN curl <> 'transicao' THEN curl END,
 CASE WHEN bal < 1000 THEN 'oleoso' WHEN bal < 4000 THEN 'seco' ELSE 'normal' END, CASE WHEN k > 10 THEN 'seco' END, CASE WHEN k > 20 THEN 'danificado' END,
 CASE WHEN seg IN ('HOUSEHOLD','FURNITURE') THEN 'com_quimica' END, CASE WHEN seg IN ('HOUSEHOLD','FURNITURE') THEN 'tingido' END, CASE WHEN seg = 'FURNITURE' THEN 'danificado' END, CASE WHEN seg = 'FURNITURE' THEN 'sensibilizado' END,
 CASE seg WHEN 'BUILDING' THEN 'fino' WHEN 'MACHINERY' THEN 'grosso' END, CASE WHEN k IN (3,4) THEN 'danificado' END], lambda x: x IS NOT NULL) AS t FROM p)
SELECT c_custkey, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS types FROM l""")
def profile_types(t):
    return t.customer.select("c_custkey", F.array_join(C.profile_to_types(_profile()), ",").alias("types"))


@query("profile_summaries", f"""WITH {_PROF} SELECT c_custkey, concat_ws(', ', CASE curl WHEN 'transicao' THEN 'em transição capilar' ELSE curl END || CASE WHEN bal > 5000 THEN ' 3B' ELSE '' END,
 CASE seg WHEN 'BUILDING' THEN 'fios finos' WHEN 'MACHINERY' THEN 'fios grossos' ELSE 'fios médios' END, CASE WHEN bal < 1000 THEN 'couro oleoso' WHEN bal < 4000 THEN 'couro seco' ELSE 'couro normal' END,
 CASE WHEN k > 20 THEN 'ressecado/danificado' WHEN k > 10 THEN 'leve ressecamento' END, CASE seg WHEN 'HOUSEHOLD' THEN 'química: coloração' WHEN 'FURNITURE' THEN 'química: alisamento/progressiva, descoloração' ELSE 'sem química' END,
 CASE WHEN bal < 0 THEN 'sintomas no couro cabeludo' END) AS summary FROM p""")
def profile_summaries(t):
    return t.customer.select("c_custkey", C.profile_summary(_profile()).alias("summary"))


@query("inci_audit_classes", f"""WITH {DOCS_SQL} SELECT product_id, CASE WHEN status='verified_inci' AND contains(description, '|') THEN 'already_verified' WHEN contains(description, '|') THEN 'extracted_rejected' WHEN n_chars > 300 THEN 'extraction_missed' ELSE 'no_inci_on_page' END AS audit FROM docs""")
def inci_audit_classes(t):
    d = docs(t)
    comp = F.when(F.col("n_chars") > 300, F.col("description"))
    return d.select("product_id", C.inci_audit_class(F.col("status"), F.when(F.contains("description", F.lit("|")), 1), comp).alias("audit"))


@query("reclassified", P + f"""SELECT product_id, CASE WHEN contains(product_name, 'old') THEN 'quarantined' ELSE verification_status END AS verification_status,
 coalesce({_TYPE_SQL.replace('lower(n)', 'lower(product_name)')}, '?') AS product_type FROM products""")
def reclassified(t):
    d = C.reclassify(products(t), "product_name", "product_url", TYPES, ["red"], {"tool": "hardware"}, ["old"])
    return d.select("product_id", "verification_status", F.coalesce("product_type_normalized", F.lit("?")).alias("product_type"))


@query("brand_name_only", "SELECT p_partkey, p_size = 1 AS only_brand FROM part")
def brand_name_only(t):
    slug = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    name = F.when(F.col("p_size") == 1, F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", C.brand_name_only(name, slug).alias("only_brand"))


@query("keyword_categories", P + "SELECT product_id, CASE WHEN contains(product_name,'small ring') THEN 'x' WHEN contains(product_name,'widget') THEN 'w' WHEN contains(product_name,'small') THEN 's' WHEN contains(product_name,'ring') THEN 'r' ELSE '?' END AS category FROM products")
def keyword_categories(t):
    c = C.category_by_keyword("product_name", {"ring": "r", "widget": "w", "small": "s", "small ring": "x"})
    return products(t).select("product_id", F.coalesce(c, F.lit("?")).alias("category"))


# --- the default vocabularies, over texts made of the tables and the words themselves ------------------

_NAMES = sorted({*M.PREFERRED_NAMES, *M.PREFERRED_NAMES.values(), "Behentrimonium Methosulfate", "Isopropyl Myristate", "Salicylic Acid", "Methylparaben", "Parabenol X", "Stearic Acid",
                 "Magnesium Chloride", "Cetearyl Glucoside", "PEG-40 Hydrogenated Castor Oil", "PEG-90M", "CI 77491", "Aloe Extract", "Sodium Laureth Sulfate", "Cocos Nucifera Oil", "Kaolin Clay"})
_Q = lambda x: x.replace("'", "''")


@query("default_ingredient_categories", f"""WITH w AS (SELECT [{', '.join(f"'{_Q(n)}'" for n in _NAMES)}] AS ws),
n AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN p_name ELSE ws[p_partkey % {len(_NAMES)} + 1] END AS name FROM part, w), f AS (SELECT *, lower(strip_accents(name)) AS x FROM n)
SELECT p_partkey, name, CASE {' '.join(f"WHEN regexp_matches(x, '{_Q('|'.join(f'(?:{p})' for p in ps))}') THEN '{c}'" for c, ps in M.INGREDIENT_CATEGORIES)} ELSE '?' END AS ingredient_category FROM f""")
def default_ingredient_categories(t):
    words = F.array(*[F.lit(n) for n in _NAMES])
    d = t.part.select("p_partkey", F.when(F.col("p_size") > 45, F.col("p_name")).otherwise(F.get(words, (F.col("p_partkey") % len(_NAMES)).cast("int"))).alias("name"))
    return C.ingredient_category(d, "name").select("p_partkey", "name", F.coalesce("ingredient_category", F.lit("?")).alias("ingredient_category"))


_PHRASES = [(seal, i, w) for seal, ws in M.SEALS for i, w in enumerate(ws)]


@query("default_seals", f"""WITH v AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {i}, '{w}')" for s, i, w in _PHRASES)}) AS x(seal, kr, word)),
ws AS (SELECT [{', '.join(f"'{w}'" for _, _, w in _PHRASES)}] AS ws), d AS (SELECT p_partkey, p_name || ' ' || ws[p_partkey % {len(_PHRASES)} + 1] || ', ' || p_brand AS s FROM part, ws),
h AS (SELECT p_partkey, seal, word, kr FROM d JOIN v ON regexp_matches(lower(s), '(^|[^0-9a-z_À-ÖØ-öø-ÿ])(' || word || ')($|[^0-9a-z_À-ÖØ-öø-ÿ])')),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, seal ORDER BY kr) AS rn FROM h) SELECT p_partkey, seal, word AS keyword FROM r WHERE rn = 1""")
def default_seals(t):
    words = F.array(*[F.lit(w) for _, _, w in _PHRASES])
    d = t.part.select("p_partkey", F.concat("p_name", F.lit(" "), F.get(words, (F.col("p_partkey") % len(_PHRASES)).cast("int")), F.lit(", "), "p_brand").alias("s"))
    return C.detect_seals(d, "p_partkey", ["s"]).select("p_partkey", "seal", "keyword")
