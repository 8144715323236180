"""Ordered, first-match rule classifiers as column expressions.

A rule list is ``[(label, words)]`` and becomes one CASE chain: no join, no shuffle, evaluation
stops at the first hit, and the scan stays in one stage.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.lists import first_by
from ..functions.text import _c, let
from ..vocab import market as M

Rules = list[tuple[str, list[str]]]


def first_match(pairs: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE chain over (condition, value) pairs."""
    if not pairs:
        return F.lit(None) if default is None else default
    chain = reduce(lambda acc, p: acc.when(p[0], p[1]), pairs[1:], F.when(*pairs[0]))
    return chain if default is None else chain.otherwise(default)


def by_substring(text: Column, rules: Rules) -> Column:
    """Label of the first rule one of whose words occurs in the (already lower-cased) text."""
    return let(text, lambda x: first_match([(T.contains_any(x, words), F.lit(label)) for label, words in rules]))


def by_pattern(text: Column, rules: Rules) -> Column:
    """Label of the first rule one of whose patterns matches; one alternation per rule."""
    return let(text, lambda x: first_match([(x.rlike("|".join(f"(?:{p})" for p in pats)), F.lit(label)) for label, pats in rules]))


# --- product type, category, audience -------------------------------------------------------

def product_type(name: Column | str, rules: Rules = M.PRODUCT_TYPES) -> Column:
    return by_substring(F.lower(_c(name)), rules)


def map_values(col: Column, mapping: dict[str, str]) -> Column:
    """Small literal mapping as a CASE chain grouped by target value."""
    groups: dict[str, list[str]] = {}
    for key, value in mapping.items():
        groups.setdefault(value, []).append(key)
    return first_match([(col.isin(keys), F.lit(value)) for value, keys in groups.items()])


def category(
    ptype: Column | str, name: Column | str, colour_words: list[str] | None = None,
    mapping: dict[str, str] | None = None, colour_label: str = "coloracao",
) -> Column:
    words = M.COLOUR_WORDS if colour_words is None else colour_words
    by_type = map_values(_c(ptype), M.CATEGORY_OF_TYPE if mapping is None else mapping)
    return F.when(T.contains_any(F.lower(_c(name)), words), F.lit(colour_label)).otherwise(by_type)


def gender_target(
    name: Column | str, url: Column | str, unisex: list[str] = M.UNISEX_WORDS,
    kids: list[str] = M.KIDS_WORDS, men: list[str] = M.MEN_WORDS,
) -> Column:
    both = F.lower(F.concat_ws(" ", _c(name), _c(url)))
    return F.coalesce(
        by_substring(both, [("unisex", unisex), ("kids", kids), ("men", men)]), F.lit("unknown")
    )


def _first_word(text: Column, words: list[str]) -> Column:
    """First word of a long list that the text holds.

    Short single words must stand alone, longer words and phrases may be part of a word. The list is one
    literal array, so the generated code stays small whatever its length.
    """
    if not words:
        return F.lit(None).cast("string")

    def whole(w: str) -> bool:
        return len(w) < 6 and w.replace("_", "a").isalnum()

    # First character: w for whole words, s for substrings.
    entries = T.literal_list([("w" if whole(w) else "s") + w.lower() for w in words])
    both = F.struct(text.alias("text"), F.concat(F.lit(" "), F.regexp_replace(text, f"[^{T.WORD}]", " "), F.lit(" ")).alias("padded"))

    def hit(b: Column, e: Column) -> Column:
        word = F.substring(e, 2, 1000)
        return F.when(F.startswith(e, F.lit("w")), F.contains(b["padded"], F.concat(F.lit(" "), word, F.lit(" ")))).otherwise(F.contains(b["text"], word))

    return let(both, lambda b: F.substring(F.try_element_at(F.filter(entries, lambda e: hit(b, e)), F.lit(1)), 2, 1000))


def domain_relevance(
    name: Column | str, url: Column | str, description: Column | str | None = None,
    foreign: list[str] = M.FOREIGN_WORDS, native: list[str] = M.DOMAIN_WORDS, types: list[str] = M.DOMAIN_TYPES,
) -> Column:
    """``struct<relevant, reason>``: words in the name decide before words elsewhere, foreign before native."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    desc = F.lit("") if description is None else F.lower(F.coalesce(_c(description), F.lit("")))
    extra = F.concat_ws(" ", desc, F.lower(F.coalesce(_c(url), F.lit(""))))
    steps = [
        (n, foreign, False, "non_hair:"), (n, native, True, "hair_keyword:"), (n, types, True, "hair_type:"),
        (extra, foreign, False, "non_hair_url:"), (extra, native, True, "hair_keyword_url:"),
    ]
    picks = [
        F.concat(F.lit(("1" if ok else "0") + prefix), _first_word(text, words))
        for text, words, ok, prefix in steps
    ]
    hit = F.coalesce(*picks, F.lit("0no_hair_keyword"))
    return F.struct(
        F.startswith(hit, F.lit("1")).alias("relevant"), F.regexp_replace(hit, "^[01]", "").alias("reason")
    )


def is_kit(url: Column | str, name: Column | str | None = None, patterns: list[str] = M.KIT_URL_PATTERNS) -> Column:
    hit = F.coalesce(F.lower(_c(url)).rlike("|".join(patterns)), F.lit(False))
    if name is None:
        return hit
    return hit | F.coalesce(F.lower(_c(name)).rlike(r"^\s*(kit|combo|duo|trio)\s"), F.lit(False))


# --- URLs, platforms, probes ----------------------------------------------------------------

def url_type(
    url: Column | str, brand_pattern: Column | str | None = None, foreign: list[str] = M.FOREIGN_WORDS,
    categories: list[str] = M.CATEGORY_PATHS, hints: list[str] = M.PRODUCT_HINTS,
    info: list[str] = M.INFO_SEGMENTS, words: list[str] | None = None, kits: list[str] = M.KIT_URL_PATTERNS,
) -> Column:
    """product, category, kit, non_hair or other.

    With a brand's own pattern (a column, may be null) only matching URLs are products.
    """
    low = F.lower(_c(url))
    path = F.substring_index(low, "?", 1)
    query = F.when(F.contains(low, F.lit("?")), F.regexp_extract(low, r"\?([^?]*)", 1)).otherwise("")
    after_host = F.when(F.startswith(path, F.lit("http")), F.regexp_replace(path, r"^[^/]*//[^/]*/?", "")).otherwise(path)
    segments = F.transform(F.split(after_host, "/"), lambda s: F.replace(s, F.lit(".html"), F.lit("")))
    words20 = M.URL_DOMAIN_WORDS if words is None else words
    strict = F.lit(False) if brand_pattern is None else _c(brand_pattern).isNotNull()
    own = F.lit(False) if brand_pattern is None else F.coalesce(F.regexp_like(low, _c(brand_pattern)), F.lit(False))
    trimmed = F.regexp_replace(low, "/+$", "")
    depth_ok = (F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit(""))) <= 4) & (
        F.size(F.filter(F.split(path, "/"), lambda s: s != "")) <= 4
    )
    hinted = low.rlike("|".join(hints))
    foreign_path = "(^|.*)/(" + "|".join(T.escape_regex(w) for w in foreign) + ")(/.*|$)"
    ends_cat = F.lit(False)
    for c in categories:
        ends_cat = ends_cat | (F.contains(low, F.lit(c)) & F.endswith(trimmed, F.lit(c.rstrip("/"))))
    in_cat = T.contains_any(low, categories) & depth_ok & ~hinted
    word_forms = sorted({f for w in words20 for f in (w.replace(" ", "-"), w.replace(" ", ""))})
    deep = F.filter(F.slice(F.split(path, "/"), F.lit(4), F.greatest(F.size(F.split(path, "/")), F.lit(1))), lambda s: s != "")
    worded = T.contains_any(low, word_forms)
    return first_match(
        [
            (low.rlike("|".join(kits)), F.lit("kit")),
            (F.regexp_replace(low, r"\?.*$", "").rlike(foreign_path) | low.rlike(
                "/(" + "|".join(T.escape_regex(w) for w in foreign) + ")/"), F.lit("non_hair")),
            (F.exists(segments, lambda s: s.isin(info)), F.lit("other")),
            (own, F.lit("product")),
            (~strict & path.rlike(r"/products/[\w][\w-]+") & ~path.rlike("/products/*$"), F.lit("product")),
            (F.contains(query, F.lit("cgid=")) | F.contains(query, F.lit("category=")), F.lit("category")),
            (ends_cat | in_cat, F.lit("category")),
            (~strict & hinted, F.lit("product")),
            (worded & ~strict & ((F.size(deep) >= 2) | (F.size(F.split(F.try_element_at(deep, F.lit(1)), "-")) >= 3)),
             F.lit("product")),
            (worded, F.lit("category")),
        ],
        F.lit("other"),
    )


def platform(text: Column | str, server: Column | str | None = None, marks: Rules = M.PLATFORM_MARKS, limit: int | None = None) -> Column:
    """First platform with a signature in the page (its first ``limit`` characters, if given), then the server header."""
    found = by_pattern(F.lower(T.head(_c(text), limit)), marks)
    if server is None:
        return found
    return F.coalesce(found, F.when(F.contains(F.lower(_c(server)), F.lit("shopify")), F.lit("shopify")))


def url_platform(url: Column | str) -> Column:
    return F.coalesce(by_pattern(F.lower(_c(url)), M.URL_PLATFORM_MARKS), F.lit("custom"))


def platform_votes(text: Column | str, marks: Rules = M.PLATFORM_MARKS) -> Column:
    """Platform with the most signatures present; the earlier platform wins a tie."""
    low = F.lower(_c(text))
    votes = F.array(*[
        F.struct(
            reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in pats]).alias("hits"),
            F.lit(-i).alias("rank"), F.lit(label).alias("label"),
        )
        for i, (label, pats) in enumerate(marks)
    ])
    best = F.array_max(votes)
    return F.when(best["hits"] > 0, best["label"])


def blocked_page(html: Column | str, status: Column | str | None = None, marks: list[str] = M.CHALLENGE_MARKS, limit: int | None = None) -> Column:
    """A challenge page by its marks (in the first ``limit`` characters, if given) or its status."""
    hit = T.contains_any(F.lower(T.head(_c(html), limit)), marks)
    return hit if status is None else hit | _c(status).isin(403, 429)


def brand_tier(
    status: Column, has_site: Column, http_status: Column, html_length: Column, blocked: Column,
    plat: Column, has_sitemap: Column, list_flag: Column, known: list[str] = M.KNOWN_PLATFORMS,
) -> Column:
    """Onboarding tier of one brand from a row of probe results."""
    return first_match(
        [
            (status.isin("blocked", "blocked_maintenance", "no_source"), F.lit("tier_skip")),
            (~has_site, F.lit("tier_4_no_site")),
            (http_status.isNull() | (http_status >= 500), F.lit("tier_4_no_site")),
            (blocked, F.lit("tier_5_waf")),
            ((http_status == 404) | (html_length < 1000), F.lit("tier_4_no_site")),
            (plat.isin(known) & has_sitemap & (list_flag != "no"), F.lit("tier_1_easy")),
            (plat.isin(known), F.lit("tier_2_check")),
        ],
        F.lit("tier_3_custom"),
    )


# --- names ----------------------------------------------------------------------------------

def name_quality(name: Column | str, type_words: str = M.NAME_TYPE_WORDS) -> Column:
    """``struct<score, valid, issues, signals>`` of a product name: 50, plus one signal, minus penalties."""
    edge_l, edge = "(^|[^0-9a-zà-ÿ_])", "($|[^0-9a-zà-ÿ_])"

    def facts(s: Column) -> Column:
        low = F.lower(s)
        return F.struct(
            s.alias("s"), low.alias("low"), T.word_count(s).alias("words"),
            low.rlike(edge_l + r"\d+(\.\d+)?\s*(ml|g|kg|l|oz)" + edge).alias("volume"),
            low.rlike(edge_l + "(" + type_words + ")" + edge).alias("type"), low.rlike("^(kit|combo)" + edge).alias("kit"))

    def signalled(f: Column) -> Column:
        signal = first_match([
            (f["volume"] & f["type"], F.lit("volume+tipo")), (f["kit"] & (f["words"] >= 3), F.lit("kit+desc")),
            (f["type"] & (f["words"] >= 3), F.lit("tipo+contexto"))])
        return F.struct(f.alias("f"), signal.alias("signal"))

    def rated(v: Column) -> Column:
        f, signal = v["f"], v["signal"]
        s, low, words = f["s"], f["low"], f["words"]
        # Penalty conditions, codes and points.
        penalties = [
            (signal.isNull(), "sem_sinal_forte", 30),
            (s.rlike("[" + M.DECORATIVE + "]"), "emoji_decorativo", 40),
            (low.rlike(r"^(crie|descubra|conhe[çc]a|aproveite|garanta|adquira|compre)" + edge), "cta_imperativa", 30),
            (s.rlike(r"^[a-z][a-z\sçãáéíóúâêôõà]+$") & (words >= 2), "tudo_lowercase", 30),
            (low.rlike(r"^(cronograma|rotina|pr[ée]\s*/\s*p[oó]s|pr[ée]\s+p[oó]s)" + edge), "regime_generico", 30),
            (low.rlike(edge_l + r"ou\s+(cacheamento|alisamento|loiro|liso|crespo|ondulado)" + edge), "alternativa_generica", 25),
            (low.rlike(r"^oral\s+care$"), "nao_capilar", 50),
            (s.rlike(r"\?$"), "pergunta", 35),
            (s.rlike(r"^[^!]*!$") & (words <= 6), "exclamacao_curta", 25),
            ((F.length(s) < 15) & ~f["volume"], "muito_curto_sem_volume", 15),
            (F.length(s) >= 80, "muito_longo", 10),
        ]
        hits = F.array_compact(F.array(*[
            F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"))) for cond, code, points in penalties]))
        bonus = F.when(signal == "volume+tipo", 40).when(signal == "kit+desc", 30).when(signal == "tipo+contexto", 20).otherwise(0)
        return F.struct((s == "").alias("empty"), signal.alias("signal"), bonus.alias("bonus"), hits.alias("hits"))

    def scored(r: Column) -> Column:
        lost = F.aggregate(F.transform(r["hits"], lambda h: h["points"]), F.lit(0), lambda a, b: a + b)
        score = F.when(r["empty"], 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.lit(50) + r["bonus"] - lost)))
        return F.struct(
            score.alias("score"), (score >= 60).alias("valid"),
            F.when(r["empty"], F.array(F.lit("name_empty"))).otherwise(F.transform(r["hits"], lambda h: h["code"])).alias("issues"),
            F.when(r["empty"], F.array().cast("array<string>")).otherwise(F.array_compact(F.array(r["signal"]))).alias("signals"))

    return let(let(let(let(T.strip_ws(F.coalesce(_c(name), F.lit(""))), facts), signalled), rated), scored)


def garbage_name(
    name: Column | str, words: list[str] = M.GARBAGE_NAMES, patterns: list[str] = M.GARBAGE_NAME_PATTERNS
) -> Column:
    """Rejection code of a name, or null."""
    low = F.lower(T.strip_ws(_c(name)))
    shaped = "|".join(f"(?:{p})" for p in patterns)
    return first_match([
        (T.contains_any(low, words), F.lit("name_garbage")),
        (low.rlike(shaped), F.lit("name_editorial_or_invalid")),
    ])


# Page texts stored as names (LIKE patterns).
JUNK_LIKE = [
    "Não existem produtos%", "Ops :(", "Identificação%cadastro%", "IdentificaçãoFaça o seu login%", "Politica %",
    "Politíca %", "Política %", "Como Comprar%", "Frete %", "Formas de %", "Duvidas %", "Dúvidas %",
    "Como comprar", "Desculpe%não encontramos%", "Página não encontrada%", "404", "Produtos", "Faciais",
    "Marcas", "Kits",
]
JUNK_UNLESS = [("Carrinho%", "Carrinho auxiliar%")]


def junk_name(name: Column | str, likes: list[str] = JUNK_LIKE, min_len: int = 6, except_likes: list[tuple[str, str]] = JUNK_UNLESS) -> Column:
    """Names that are page furniture, or shorter than six characters. ``except_likes`` are patterns with a pattern that spares a name."""
    n = _c(name)
    cond = F.length(F.trim(n)) < min_len
    for pattern in likes:
        cond = cond | n.like(pattern)
    for pattern, unless in except_likes:
        cond = cond | (n.like(pattern) & ~n.like(unless))
    return cond


def safe_name(name: Column | str, type_words: str = M.NAME_TYPE_WORDS) -> Column:
    """A type word together with a volume: never junk, whatever else the name says."""
    low = F.lower(_c(name))
    return low.rlike("(^|[^0-9a-zà-ÿ_])(" + type_words + ")") & low.rlike(r"\d+\s*(ml|g|kg|l)($|[^0-9a-zà-ÿ_])")


def non_domain_name(name: Column | str, words: list[str] = M.NON_DOMAIN_PATTERNS) -> Column:
    return T.contains_any(F.lower(_c(name)), words)


# Path parts of listing pages.
LISTING_PATHS = [
    "/descubra/", "/conditioners", "/shampoos", "/colecoes-linhas", "/condicionadores-e-mascaras", "/kits-2",
    "/produtos/refil",
]


def listing_page(url: Column | str, parts: list[str] = LISTING_PATHS) -> Column:
    path = F.regexp_replace(F.substring_index(F.regexp_replace(_c(url), "#.*$", ""), "?", 1), "/+$", "")
    return ~F.endswith(path, F.lit(".html")) & T.contains_any(path, parts)


def brand_name_only(name: Column | str, slug: Column | str) -> Column:
    n, b = F.lower(_c(name)), F.lower(_c(slug))
    return (n == b) | (n == F.replace(b, F.lit("-"), F.lit(" ")))


# --- content --------------------------------------------------------------------------------

def tab_noise(content: Column | str, labels: list[str] = M.TAB_LABELS) -> Column:
    """The content is one tab caption, or its first 80 characters hold two of them."""
    def judged(s: Column) -> Column:
        hits = let(F.left(s, F.lit(80)), lambda head: reduce(
            lambda a, b: a + b, [F.contains(head, F.lit(x)).cast("int") for x in labels]))
        return (s != "") & (s.isin(labels) | (hits >= 2))

    return let(T.norm_label(F.coalesce(_c(content), F.lit(""))), judged)


def list_like(text: Column | str, in_section: Column | bool = False, verbs: list[str] = M.REJECTION_VERBS) -> Column:
    s = F.coalesce(_c(text), F.lit(""))
    ctx = F.lit(in_section) if isinstance(in_section, bool) else in_section
    return (F.length(s) >= 30) & s.rlike("[,;●•·]") & (ctx | ~T.contains_any(F.lower(s), verbs))


def anchor_hits(text: Column | str, anchors: list[str] = M.ANCHOR_WORDS) -> Column:
    words = F.transform(F.split(F.lower(_c(text)), r"\s+"), lambda w: F.btrim(w, F.lit(",.;:()")))
    return F.size(F.array_intersect(words, F.array(*[F.lit(a) for a in anchors])))


def list_or_composition(
    field: Column | str, content: Column | str, anchors: list[str] = M.ANCHOR_WORDS,
    verbs: list[str] = M.REJECTION_VERBS,
) -> Column:
    """Promote or demote between ``ingredients_inci`` and ``composition`` by what the text holds."""
    f, strong = _c(field), anchor_hits(content, anchors) >= 3
    return (
        F.when((f == "ingredients_inci") & ~(list_like(content, False, verbs) | strong), F.lit("composition"))
        .when((f == "composition") & strong, F.lit("ingredients_inci"))
        .otherwise(f)
    )


def real_list(text: Column | str, marks: str = M.INGREDIENT_MARKS, openers: str = M.LIST_OPENERS) -> Column:
    """A known ingredient token anywhere, and an opening ingredient followed by a separator near the start."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    edge_l, edge_r = "(^|[^0-9a-zà-ÿ_])", "([^0-9a-zà-ÿ_]|$)"
    marked = low.rlike(edge_l + "(" + marks + ")" + edge_r)
    anchored = F.left(low, F.lit(600)).rlike(edge_l + "(" + openers + r")(|[^0-9a-zà-ÿ_.\n][^.\n]{0,399})[,;|/]")
    return marked & anchored


def inci_audit_class(status: Column, n_items: Column, composition: Column) -> Column:
    has_list = F.coalesce(n_items, F.lit(0)) > 0
    return first_match([
        ((status == "verified_inci") & has_list, F.lit("already_verified")),
        (has_list, F.lit("extracted_rejected")),
        (F.coalesce(composition, F.lit("")) != "", F.lit("extraction_missed")),
    ], F.lit("no_inci_on_page"))


# --- seals ----------------------------------------------------------------------------------

def detect_seals(
    df: DataFrame, key: str, fields: list[str], seals: Rules = M.SEALS, method: str = "text_keyword"
) -> DataFrame:
    """One evidence row per (row, seal): the first field with a hit, and its first word in list order.

    Row-local and one search per field: the words of all seals are one prefix tree, tried at every word's start by look-ahead, so that words may
    overlap. Of the words that start at one place the longest is found; a literal map gives the seals of that word and of those that it begins with.
    """
    plain = [(no, i, M.plain(w)) for no, (_, words) in enumerate(seals) for i, w in enumerate(words)]
    spelled = sorted({w for _, _, w in plain if w})
    if not spelled:
        return df.select(key, *[F.lit("").alias(n) for n in ("seal", "keyword", "field", "extraction_method", "field_name")]).filter(F.lit(False))
    pattern = f"(?<![{T.WORD}])(?=({T.trie_pattern(spelled)})(?:$|[^{T.WORD}]))"
    inner = re.compile(f"[^{T.WORD}]")
    known: dict[str, list[tuple[int, int]]] = {w: [] for w in spelled}
    for no, i, w in plain:
        # A word also stands where a longer one does that begins with it.
        for longer in spelled:
            if w and (longer == w or longer.startswith(w) and inner.match(longer[len(w):])):
                known[longer].append((no, i))
    hit = "array<struct<seal:int,field:int,word:int>>"
    found_by = F.create_map(*[x for w, hits in known.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(no), F.lit(i)) for no, i in sorted(set(hits))]))])

    def in_field(no: int, f: str) -> Column:
        text = T.strip_accents(F.lower(F.coalesce(F.col(f), F.lit(""))))
        words = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        return F.flatten(F.transform(words, lambda w: F.transform(F.element_at(found_by, w), lambda h: F.struct(h["col1"], F.lit(no), h["col2"])))).cast(hit)

    ranked = F.array_sort(F.concat(*[in_field(no, f) for no, f in enumerate(fields)]))
    # The first of each seal: the earliest field, there the earliest word in list order.
    best = let(ranked, lambda r: F.filter(r, lambda h, i: (i == 0) | (F.get(r, i - 1)["seal"] != h["seal"])))
    width = max(len(words) for _, words in seals)
    names, fields_ = T.literal_list([s for s, _ in seals]), T.literal_list(fields)
    words = T.literal_list([M.plain(w) for _, ws in seals for w in [*ws, *[""] * (width - len(ws))]])
    hits = df.select(key, F.explode(best).alias("h"))
    return hits.select(
        key, F.get(names, F.col("h.seal")).alias("seal"), F.get(words, F.col("h.seal") * width + F.col("h.word")).alias("keyword"), F.get(fields_, F.col("h.field")).alias("field")).select(
        key, "seal", "keyword", "field", F.lit(method).alias("extraction_method"), F.concat(F.lit("label:"), "seal").alias("field_name"))


def detect_seals_in_images(
    df: DataFrame, key: str, texts: str, found: DataFrame, seals: Rules = M.SEALS
) -> DataFrame:
    """Seals named in image texts that the page text did not name; ``texts`` is an array column."""
    joined = df.select(key, F.array_join(F.col(texts), " \n ").alias("image_texts"))
    hits = detect_seals(joined, key, ["image_texts"], seals, "html_img_element")
    return hits.join(found.select(key, "seal"), [key, "seal"], "left_anti")


def _any_in(items: Column, words: list[str]) -> Column:
    """Some entry contains some prohibited word: one alternation over the joined list."""
    joined = F.lower(F.array_join(items, "\n"))
    return joined.rlike("|".join(T.escape_regex(w) for w in words))


def infer_seals(
    items: Column | str, sulfates: list[str] = M.SULFATES, silicones: list[str] = M.SILICONES,
    no_poo: list[str] = M.NO_POO_PROHIBITED, parabens: list[str] = M.PARABENS,
    petrolatum: list[str] = M.PETROLATUM, dyes: list[str] = M.DYES,
) -> Column:
    """Seals that hold because nothing prohibited is on the list; null list gives none."""
    arr = _c(items)
    silicone, sulfate = _any_in(arr, silicones), _any_in(arr, sulfates)
    dye = _any_in(arr, dyes) | F.lower(F.array_join(arr, "\n")).rlike(r"(^|[^0-9a-zà-ÿ_])ci\s*\d{4,5}($|[^0-9a-zà-ÿ_])")
    return F.when(
        arr.isNotNull(),
        F.array_compact(F.array(
            F.when(~silicone, F.lit("silicone_free")), F.when(~sulfate, F.lit("sulfate_free")),
            F.when(~_any_in(arr, parabens), F.lit("paraben_free")),
            F.when(~_any_in(arr, petrolatum), F.lit("petrolatum_free")), F.when(~dye, F.lit("dye_free")),
            F.when(~sulfate, F.lit("low_poo")), F.when(~_any_in(arr, no_poo) & ~silicone, F.lit("no_poo")),
        )),
    ).otherwise(F.array().cast("array<string>"))


def seal_confidence(n_detected: Column, n_inferred: Column) -> Column:
    return first_match([
        ((n_detected > 0) & (n_inferred > 0), F.lit(0.9)), (n_detected > 0, F.lit(0.8)), (n_inferred > 0, F.lit(0.5)),
    ], F.lit(0.0))


# --- hair type, age, function ---------------------------------------------------------------

def _vocab_pattern(words: list[str]) -> str:
    return "(^|[^0-9a-z_])(" + "|".join(T.escape_regex(M.plain(w).lower()) for w in words) + ")(s|es)?($|[^0-9a-z_])"


def _name_and_text(name: Column | str, description: Column | str | None) -> Column:
    """``struct<n, both>``: the folded name, and it with the folded text. To be bound by ``let``: each rule reads it."""
    n = F.lower(T.strip_accents(F.coalesce(_c(name), F.lit(""))))
    d = F.lit("") if description is None else F.lower(T.strip_accents(F.coalesce(_c(description), F.lit(""))))
    return F.struct(n.alias("n"), F.btrim(F.concat_ws(" ", F.nullif(n, F.lit("")), F.nullif(d, F.lit("")))).alias("both"))


def hair_types(name: Column | str, description: Column | str | None = None, vocab: Rules = M.HAIR_TYPES) -> Column:
    """``struct<types, confidence>``: every type with a hit; 0.4 for a word of the name, else 0.25.

    Both sides are folded for the name test, so accented words count there as well.
    """
    def parts(v: Column) -> Column:
        n, both, out = v["n"], v["both"], []
        for label, words in vocab:
            folded = [M.plain(w).lower() for w in words]
            word = first_match([(both.rlike(_vocab_pattern([w])), F.lit(w)) for w in folded])
            out.append(F.when(
                both.rlike(_vocab_pattern(folded)),
                F.struct(F.lit(label).alias("label"), F.when(F.contains(n, word), 40).otherwise(25).alias("pts")),
            ))
        return F.array_compact(F.array(*out))

    return let(let(_name_and_text(name, description), parts), _typed)


def _typed(hits: Column) -> Column:
    points = F.aggregate(F.transform(hits, lambda h: h["pts"]), F.lit(0), lambda a, b: a + b)
    return F.struct(
        F.transform(hits, lambda h: h["label"]).alias("types"),
        (F.least(F.lit(100), points) / F.lit(100.0)).alias("confidence"),
    )


def audience_age(name: Column | str, description: Column | str | None = None, vocab: Rules = M.AGE_GROUPS) -> Column:
    """``struct<age, confidence>``: most specific group first; adult at 0.5 without any mark."""
    def grouped(v: Column) -> Column:
        pairs = []
        for label, words in vocab:
            for w in words:
                pat = _vocab_pattern([w])
                pairs.append((v["both"].rlike(pat), F.struct(
                    F.lit(label).alias("age"), F.when(v["n"].rlike(pat), 0.9).otherwise(0.7).alias("confidence"))))
        return first_match(pairs, F.struct(F.lit("adult").alias("age"), F.lit(0.5).alias("confidence")))

    return let(_name_and_text(name, description), grouped)


def function_objective(
    name: Column | str, category_col: Column | str, description: Column | str | None = None,
    vocab: list[tuple[str, list[str], list[str]]] = M.FUNCTIONS,
) -> Column:
    """``struct<function, confidence>``: by category at 0.9, else by word at 0.75 (name) or 0.55; null without any."""
    cat = F.lower(T.strip_accents(F.coalesce(_c(category_col), F.lit(""))))
    by_category = [
        (cat.isin([M.plain(c).lower() for c in cats]),
         F.struct(F.lit(label).alias("function"), F.lit(0.9).alias("confidence")))
        for label, cats, _words in vocab if cats
    ]

    def found(v: Column) -> Column:
        pairs = list(by_category)
        for label, _cats, words in vocab:
            for w in words:
                pat = _vocab_pattern([w])
                pairs.append((v["both"].rlike(pat), F.struct(
                    F.lit(label).alias("function"), F.when(v["n"].rlike(pat), 0.75).otherwise(0.55).alias("confidence"))))
        return first_match(pairs, F.struct(F.lit(None).cast("string").alias("function"), F.lit(0.0).alias("confidence")))

    return let(_name_and_text(name, description), found)


def apply_classification(
    df: DataFrame, name: str, description: str, category_col: str, min_conf: float = 0.6,
    types: Rules = M.HAIR_TYPES, ages: Rules = M.AGE_GROUPS, functions=M.FUNCTIONS,
) -> DataFrame:
    """Write each classified field only at or above the threshold; the old value stays otherwise."""
    ht = hair_types(name, description, types)
    out = df.withColumns({
        "_ht": ht, "_age": audience_age(name, description, ages),
        "_fn": function_objective(name, category_col, description, functions),
    })

    def keep(col: str, cond: Column, value: Column) -> Column:
        old = F.col(col) if col in df.columns else F.lit(None)
        return F.when(cond, value).otherwise(old)

    return out.withColumns({
        "hair_type": keep("hair_type", (F.col("_ht.confidence") >= min_conf) & (F.size("_ht.types") > 0), F.col("_ht.types")),
        "audience_age": keep("audience_age", F.col("_age.confidence") >= min_conf, F.col("_age.age")),
        "function_objective": keep("function_objective", F.col("_fn.confidence") >= min_conf, F.col("_fn.function")),
    }).drop("_ht", "_age", "_fn")


def ingredient_category(df: DataFrame, name: str, rules: Rules = M.INGREDIENT_CATEGORIES) -> DataFrame:
    """Category per row, computed once per distinct name and joined back.

    The distinct step shrinks the regex work to the dictionary's size and absorbs hot names.
    """
    names = df.select(F.col(name).alias("_n")).distinct()
    rated = names.withColumn("ingredient_category", by_pattern(T.fold("_n"), rules))
    return df.join(rated, df[name].eqNullSafe(rated["_n"]), "left").drop("_n")


# --- routine, profile, intent ---------------------------------------------------------------

def allergen_index(classes=M.ALLERGENS) -> dict[str, tuple[str, str]]:
    """Entry -> (class, severity); the first class that names an entry keeps it."""
    index: dict[str, tuple[str, str]] = {}
    for cls, severity, names in classes:
        for n in names:
            index.setdefault(n.strip(" .,;:*"), (cls, severity))
    return index


def allergens(items: Column | str, classes=M.ALLERGENS, severities: list[str] = M.SEVERITIES) -> Column:
    """Array of ``struct<rank, name, allergen_class, severity>``, worst first, then by name.

    The vocabulary is a literal map of bounded size; looking an entry up costs no join. Per entry
    and class only the first spelling of the list is kept.
    """
    index = allergen_index(classes)
    if len(index) > 5000:
        raise ValueError("allergen vocabulary too large for a literal map; join it as a table instead")
    order = {s: i for i, s in enumerate(severities)}
    lookup = F.create_map(*[
        x for n, (cls, sev) in index.items()
        for x in (F.lit(n), F.struct(F.lit(cls).alias("c"), F.lit(sev).alias("s"), F.lit(-order.get(sev, 0)).alias("r")))
    ])
    known = F.transform(_c(items), lambda x: let(T.norm_entry(x), lambda k: F.struct(
        T.strip_ws(x).alias("name"), k.alias("key"), F.try_element_at(lookup, k).alias("m"))))
    hits = first_by(F.filter(known, lambda h: h["m"].isNotNull()), lambda h: h["key"])
    return F.sort_array(F.transform(hits, lambda h: F.struct(
        h["m"]["r"].alias("rank"), F.lower(h["name"]).alias("sort_name"), h["name"].alias("ingredient"),
        h["m"]["c"].alias("allergen_class"), h["m"]["s"].alias("severity"))))


def allergen_summary(found: Column) -> Column:
    """``struct<count, worst, classes>`` of the result of :func:`allergens`."""
    return F.struct(
        F.size(found).alias("count"), F.try_element_at(found, F.lit(1))["severity"].alias("worst"),
        F.sort_array(F.array_distinct(F.transform(found, lambda f: f["allergen_class"]))).alias("classes"),
    )


def routine_role(
    items: Column | str, function: Column | str, sulfates: list[str] = M.SULFATES,
    mild: list[str] = M.MILD_SURFACTANTS, insoluble: list[str] = M.SILICONES_INSOLUBLE,
    drying: list[str] | None = None, steps: dict[str, str] = M.STEP_OF_FUNCTION,
) -> Column:
    """``struct<step, cleansing, insoluble_silicone, drying_alcohol>`` from exact entries of the list."""
    dry = [n for c, _s, names in M.ALLERGENS if c == "drying_alcohol" for n in names] if drying is None else drying
    step = map_values(F.lower(F.coalesce(_c(function), F.lit(""))), steps)

    def role(keys: Column) -> Column:
        def has(words: list[str]) -> Column:
            return F.arrays_overlap(keys, F.array(*[F.lit(w.strip(" .,;:*")) for w in words]))

        return F.struct(
            step.alias("step"), F.when(has(sulfates), F.lit("intensa")).when(has(mild), F.lit("suave")).alias("cleansing"),
            has(insoluble).alias("insoluble_silicone"), has(dry).alias("drying_alcohol"))

    return let(F.transform(F.coalesce(_c(items), F.array().cast("array<string>")), T.norm_entry), role)


def intent(
    text: Column | str, has_product: Column | bool = False, safety: str = M.INTENT_SAFETY,
    product: str = M.INTENT_PRODUCT, product_verb: str = M.INTENT_PRODUCT_VERB,
    recommend: str = M.INTENT_RECOMMEND, routine: str = M.INTENT_ROUTINE,
) -> Column:
    """Question intent; safety first. Patterns match word beginnings on folded text."""
    s = T.fold(F.coalesce(_c(text), F.lit("")))
    ctx = F.lit(has_product) if isinstance(has_product, bool) else has_product

    def starts(p: str) -> Column:
        return s.rlike(r"(?s)(^|[^0-9a-z_])(" + p + ")")

    whole_verb = s.rlike("(^|[^0-9a-z_])(" + product_verb + ")($|[^0-9a-z_])")
    return first_match([
        (s == "", F.lit("geral")), (starts(safety), F.lit("saude_couro")),
        (ctx | (starts(product) & whole_verb), F.lit("analise_produto")),
        (starts(recommend), F.lit("recomendacao")), (starts(routine), F.lit("rotina_cuidado")),
    ], F.lit("geral"))


def profile_to_types(p: dict[str, Column]) -> Column:
    """Profile answers to the ordered, distinct list of scoring types."""
    sub = F.upper(F.coalesce(p["curl_subtype"], F.lit("")))
    family = F.substring(sub, 1, 1)
    curl = F.when(
        (sub != "") & (sub != "NAO_SEI"),
        F.when(family == "1", "liso").when(family == "2", "ondulado").when(family == "3", "cacheado").when(family == "4", "crespo"),
    ).otherwise(F.when(p["curl_type"].isin("liso", "ondulado", "cacheado", "crespo"), p["curl_type"]))
    oil, dry, thick = p["scalp_oiliness"], p["dryness_damage"], p["thickness"]
    chem = F.coalesce(p["chemical_treatments"], F.array().cast("array<string>"))
    bleached, dyed, straight = (F.array_contains(chem, x) for x in ("descoloracao", "coloracao", "alisamento"))
    worn = p["heat_usage"].isin("diariamente", "3_4_semana") | (p["sun_exposure"] == "alta") | (p["water_exposure"] == "frequente")
    return F.array_distinct(F.array_compact(F.array(
        curl,
        F.when(oil == "alta", "oleoso").when(oil == "baixa", "seco").when(oil == "normal", "normal"),
        F.when(dry.isin("bastante", "um_pouco"), "seco"), F.when(dry == "bastante", "danificado"),
        F.when(F.size(chem) > 0, "com_quimica"), F.when(dyed, "tingido"),
        F.when(bleached, "tingido"), F.when(bleached, "danificado"), F.when(bleached, "sensibilizado"),
        F.when(straight, "sensibilizado"),
        F.when(thick == "finos", "fino").when(thick == "grossos", "grosso"),
        F.when(worn, "danificado"),
    )))


# Profile wording.
_CURL = {"liso": "liso", "ondulado": "ondulado", "cacheado": "cacheado", "crespo": "crespo", "transicao": "em transição capilar"}
_OIL = {"baixa": "couro seco", "normal": "couro normal", "alta": "couro oleoso"}
_DRY = {"um_pouco": "leve ressecamento", "bastante": "ressecado/danificado"}
_THICK = {"finos": "fios finos", "medios": "fios médios", "grossos": "fios grossos"}
_CHEM = {"coloracao": "coloração", "descoloracao": "descoloração", "alisamento": "alisamento/progressiva"}


def profile_summary(p: dict[str, Column]) -> Column:
    """One line of text about a profile."""
    sub = F.upper(F.coalesce(p["curl_subtype"], F.lit("")))
    label = F.coalesce(map_values(p["curl_type"], _CURL), p["curl_type"])
    curl = F.when(
        F.coalesce(p["curl_type"], F.lit("")) != "",
        F.concat(label, F.when((sub != "") & (sub != "NAO_SEI"), F.concat(F.lit(" "), sub)).otherwise("")),
    )
    chem = F.array_compact(F.transform(p["chemical_treatments"], lambda t: map_values(t, _CHEM)))
    chem_text = F.when(
        F.coalesce(F.size(chem), F.lit(0)) > 0, F.concat(F.lit("química: "), F.array_join(chem, ", "))
    ).otherwise(F.lit("sem química"))
    return F.concat_ws(
        ", ", curl, map_values(p["thickness"], _THICK), map_values(p["scalp_oiliness"], _OIL),
        map_values(p["dryness_damage"], _DRY), chem_text,
        F.when(p["scalp_issues"], F.lit("sintomas no couro cabeludo")),
    )


def reclassify(df: DataFrame, name: str, url: str, types: Rules = M.PRODUCT_TYPES, colour_words=None, mapping=None,
               garbage: list[str] = M.GARBAGE_NAMES) -> DataFrame:
    """Fresh kit flag, type and category; error pages go to quarantine."""
    ptype = product_type(name, types)
    bad = T.contains_any(F.lower(F.col(name)), garbage)
    return df.withColumns({
        "is_kit": is_kit(F.col(url), F.col(name)), "product_type_normalized": ptype,
        "product_category": category(ptype, F.col(name), colour_words, mapping),
        "verification_status": F.when(bad, F.lit("quarantined")).otherwise(F.col("verification_status")),
    })


def category_by_keyword(name: Column | str, keywords: dict[str, str]) -> Column:
    """Longest keyword first."""
    ordered = sorted(keywords.items(), key=lambda kv: -len(kv[0]))
    return by_substring(F.lower(_c(name)), [(v, [k]) for k, v in ordered])


def any_prefix(col: Column | str, prefixes: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(_c(col), F.lit(p)) for p in prefixes], F.lit(False))
