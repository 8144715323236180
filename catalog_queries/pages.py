"""Page queries: tokens, sections, links and extraction; shop pages are built from the part table."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.functions import text as T
from shelfgrade.functions import udf
from shelfgrade.operators import elements as E
from shelfgrade.operators import pages as D
from shelfgrade.plans import ingest as I

from . import sqlx as X
from .base import query

N = "CAST(count(*) AS BIGINT)"


def _bare(c: str) -> str:
    for tag in ("script", "style", "noscript"):
        c = X.rep(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return X.rep(c, "(?s)<!--.*?-->", " ")


def _decoded(c: str) -> str:
    for e, r in X.ENTITIES:
        c = "replace({}, '{}', '{}')".format(c, e, r.replace("'", "''"))
    return c


_PAT = "<(/?[a-zA-Z][a-zA-Z0-9-]*)([^>]*)>([^<]*)"
_TOK = f"""bare AS (SELECT page_id, {_bare('html')} AS s FROM pages),
lst AS (SELECT page_id, regexp_extract_all(s, '{_PAT}', 1) AS tags, regexp_extract_all(s, '{_PAT}', 3) AS texts FROM bare),
tok AS (SELECT page_id, CAST(i - 1 AS INT) AS pos, lower(tags[i]) AS tag, {X.collapse(_decoded('texts[i]'))} AS txt FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM lst))"""


@query("page_tokens", f"WITH {_TOK} SELECT page_id, pos, tag, md5(txt) AS digest FROM tok")
def page_tokens(t):
    return D.page_tokens(t.pages).select("page_id", "pos", "tag", F.md5("text").alias("digest"))


@query("tag_counts", f"WITH {_TOK} SELECT tag, {N} AS n, CAST(sum(length(txt)) AS BIGINT) AS chars FROM tok GROUP BY tag")
def tag_counts(t):
    return D.page_tokens(t.pages).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_LAB = X.rep("lower(" + X.collapse("strip_accents(txt)") + ")", r"^[^\w]+")
_FIELD = f"CASE WHEN starts_with({_LAB}, 'thea') THEN 'benefits' WHEN starts_with({_LAB}, 'the') THEN 'description' WHEN starts_with({_LAB}, 'en') THEN 'description' WHEN starts_with({_LAB}, 'de') THEN 'benefits' END"
_SEC = f"""{_TOK}, l AS (SELECT *, {_FIELD} AS field FROM tok), h AS (SELECT *, txt <> '' AND (tag = 'h1' OR (tag = 'b' AND field IS NOT NULL)) AS head FROM l),
g AS (SELECT *, max(CASE WHEN head THEN pos END) OVER (PARTITION BY page_id ORDER BY pos) AS grp FROM h),
b AS (SELECT page_id, grp, string_agg(txt, ' ' ORDER BY pos) FILTER (WHERE NOT head AND txt <> '') AS content FROM g WHERE grp IS NOT NULL GROUP BY 1, 2),
sec AS (SELECT b.page_id, grp AS pos, l.field, content FROM b JOIN l ON l.page_id = b.page_id AND l.pos = grp)"""
_LABELS = [("description", ["the", "en"]), ("benefits", ["thea", "de"])]


@query("heading_sections", f"WITH {_SEC} SELECT page_id, pos, field, md5(content) AS digest FROM sec WHERE field IS NOT NULL AND coalesce(content, '') <> ''")
def heading_sections(t):
    s = D.heading_sections(t.pages, _LABELS, headings=["h1", "b"])
    return s.select("page_id", "pos", "field", F.md5("content").alias("digest"))


@query("section_counts", f"WITH {_SEC} SELECT field, {N} AS n FROM sec WHERE field IS NOT NULL AND coalesce(content, '') <> '' GROUP BY field")
def section_counts(t):
    return D.heading_sections(t.pages, _LABELS, headings=["h1", "b"]).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("page_links", f"""WITH b AS (SELECT page_id, url, {_bare('html')} AS s FROM pages),
h AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(s, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM b),
f AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href
 ELSE regexp_replace(split_part(split_part(url,'#',1),'?',1), '[^/]*$', '') || href END AS link FROM h WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(#|mailto:|tel:|javascript:)'))
SELECT DISTINCT page_id, split_part(split_part(link, '#', 1), '?', 1) AS link FROM f""")
def page_links(t):
    return D.page_links(t.pages)


@query("allowed_links", f"""WITH b AS (SELECT page_id, url, {_bare('html')} AS s FROM pages),
h AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(s, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM b),
l AS (SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || split_part(split_part(href, '#', 1), '?', 1) AS link FROM h WHERE starts_with(href, '/'))
SELECT page_id, {N} AS links FROM l WHERE regexp_matches(link, '://([^/]*\\.)?example\\.com(/|$)') GROUP BY 1""")
def allowed_links(t):
    return D.page_links(t.pages, ["example.com"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query("same_site_links", f"""WITH b AS (SELECT page_id, url, {_bare('html')} AS s FROM pages),
h AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(s, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM b),
l AS (SELECT DISTINCT page_id, split_part(split_part(href, '#', 1), '?', 1) AS link FROM h WHERE starts_with(href, '/')) SELECT page_id, {N} AS links FROM l GROUP BY 1""")
def same_site_links(t):
    return D.same_site_links(t.pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


def _hidden(c: str) -> str:
    for tag in ("nav", "header", "footer"):
        c = X.rep(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return c


@query("visible_text", f"WITH v AS (SELECT page_id, {X.collapse(_decoded(X.rep(_hidden(_bare('html')), '<[^>]+>', ' ')))} AS s FROM pages) SELECT page_id, CAST(length(s) AS INT) AS chars, md5(s) AS digest FROM v")
def visible_text(t):
    d = t.pages.select("page_id", D.visible_text("html").alias("s"))
    return d.select("page_id", F.length("s").alias("chars"), F.md5("s").alias("digest"))




@query("page_titles", f"""WITH b AS (SELECT page_id, {_bare('html')} AS s FROM pages) SELECT page_id, {X.collapse(_decoded("regexp_replace(regexp_extract(s, '<h1>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')"))} AS title FROM b""")
def page_titles(t):
    return t.pages.select("page_id", D.select_first("html", ["h1.product-name", "h1", ".product-title"]).alias("title"))


def structured_pages(t):
    """Shop pages built from parts: four ways to place instructions, four to place an ingredient list."""
    kind, name = F.col("p_size") % 4, F.col("p_name")
    use = (F.when(kind == 0, F.concat(F.lit("<h2>Modo de Uso</h2><p>Aplique "), name, F.lit(" nos cabelos.</p><p>x</p>")))
           .when(kind == 1, F.concat(F.lit("<details><summary><div><span>Modo de Uso</span></div></summary><div class='accordion__content'>Aplique "), name, F.lit(" nos cabelos.</div></details>")))
           .when(kind == 2, F.concat(F.lit("<div><b>Modo de Uso</b><div>Aplique <div>"), name, F.lit("</div> nos cabelos.</div></div>")))
           .otherwise(F.concat(F.lit("<div><h3>Modo de Uso</h3>Aplique "), name, F.lit(" nos cabelos.</div>"))))
    items = F.concat(F.lit("Aqua, Glycerin, Parfum, "), "p_brand", F.lit(", "), "p_type")
    lists = (F.when(kind == 0, F.concat(F.lit("<button>Ingredientes</button><ul>Todos "), items, F.lit("</ul>")))
             .when(kind == 1, F.concat(F.lit("<details><summary>Ver ingredientes</summary><em>"), items, F.lit("</em></details>")))
             .when(kind == 2, F.concat(F.lit("<section><span>Ingredientes</span>"), items, F.lit("</section>")))
             .otherwise(F.concat(F.lit("<section class='jump-faq-panel--2'>"), items, F.lit("</section>"))))
    return t.spread("part").select("p_partkey", F.concat(F.lit("<html><body><main>"), use, F.lit("</main>"), lists, F.lit("<div class='box'><div>"), "p_name", F.lit("</div>by<div>"), "p_brand", F.lit("</div></div></body></html>")).alias("html"))


@query("element_sections", "SELECT p_partkey, 'care_usage' AS field, 'Aplique ' || p_name || ' nos cabelos.' AS content FROM part")
def element_sections(t):
    return E.element_sections(structured_pages(t), [("care_usage", ["modo de uso"])], "p_partkey").select("p_partkey", "field", "content")


@query("element_lists", "SELECT p_partkey, 'Aqua, Glycerin, Parfum, ' || p_brand || ', ' || p_type AS content, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 5 END AS phase FROM part")
def element_lists(t):
    return E.element_lists(structured_pages(t), ["ingredientes"], "p_partkey").select("p_partkey", "content", "phase")


@query("element_texts", "SELECT p_partkey, p_name || ' by ' || p_brand AS content FROM part")
def element_texts(t):
    return structured_pages(t).select("p_partkey", E.element_text("html", [".missing", ".box"]).alias("content"))


@query("evidence_rows", """SELECT page_id, url AS source_url, 'page' AS field_name, html AS raw_source_text FROM pages
UNION ALL SELECT page_id, url, 'url', url FROM pages WHERE url LIKE '%.html'""")
def evidence_rows(t):
    d = t.pages.withColumn("u", F.when(F.endswith("url", F.lit(".html")), F.col("url")))
    return D.evidence_rows(d, "page_id", "url", [("html", "page", "body", "html_selector"), ("u", "url", "url", "html_selector")]).select(
        "page_id", "source_url", "field_name", "raw_source_text")


_MK = [("care_usage", "the|und"), ("ingredients_inci", "of|que"), ("benefits", "and|la")]


@query("split_descriptions")
def split_descriptions(t):
    d = t.documents.select("doc_id", F.regexp_replace("text", r"\. ([A-Za-zé]+) ", ". $1: ").alias("text"))
    return udf.split_sections(d, "doc_id", "text", _MK)


@query("split_blobs", """SELECT p_partkey, 'Ótimo ' || p_name || '.' AS lead, 'Aplique ' || p_type AS usage, CASE WHEN p_size > 25 THEN 'Aqua, ' || p_brand ELSE '' END AS list FROM part""")
def split_blobs(t):
    blob = F.concat(F.lit("Ótimo "), "p_name", F.lit(". Modo de uso: Aplique "), "p_type",
                    F.when(F.col("p_size") > 25, F.concat(F.lit(". Composição completa: Aqua, "), "p_brand")).otherwise(""))
    cut = D.split_description(blob)
    d = t.part.select("p_partkey", cut.alias("m"))

    def get(k):
        return F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))

    return d.select("p_partkey", F.concat(get("description"), F.lit(".")).alias("lead"), get("care_usage").alias("usage"), get("ingredients_inci").alias("list"))


@query("inline_list_blocks", f"""WITH d AS (SELECT doc_id, trim(regexp_replace(left(regexp_replace(text, '<[^>]+>', ' ', 'g'), 100000), '\\s+', ' ', 'g'), ' .;,' || chr(10)) AS b, text FROM documents WHERE NOT contains(text, '<') AND length(text) <= 3900 AND NOT regexp_matches(lower(text), '\\b(sac|directions|warnings|validade|benefits)\\b'))
SELECT doc_id, coalesce(CASE WHEN length(b) >= 30 AND regexp_matches(b, '[,;|·•]') THEN md5(trim(trim(b, {X.WS}), ' .;,')) END, '-') AS digest FROM d""")
def inline_list_blocks(t):
    d = t.documents.filter(~F.contains("text", F.lit("<")) & (F.length("text") <= 3900) & ~F.lower("text").rlike(r"\b(sac|directions|warnings|validade|benefits)\b"))
    block = D.inline_list_block(F.concat(F.lit("Novo! Composição (INCI): "), "text"))
    return d.select("doc_id", F.coalesce(F.md5(block), F.lit("-")).alias("digest"))


# --- shop pages built from part -------------------------------------------------------------

def shop_pages(t):
    c, lit = F.col, F.lit
    ident = c("p_partkey").cast("string")
    ld = F.concat(
        lit('<script type="application/ld+json">{"@context":"x","@type":"Product","name":"'), c("p_name"), lit('","description":"<b>Fine</b> &amp; '), c("p_type"),
        lit('","image":["https://ld.example.com/'), ident, lit('.png"],"offers":{"price":"'), c("p_retailprice").cast("string"), lit('","priceCurrency":"USD"}}</script>'))
    state = F.concat(
        lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"productCollection":{"items":[{"productName":"'), c("p_name"),
        lit('","allIngredients":"Aqua, Glycerin, State, Parfum, Citric Acid, '), c("p_brand"), lit('","keyBenefits":["Brilho","Maciez"],"packshot":{"url":"//st.example.com/'), ident, lit('.png"}}]}}}}}</script>'))
    html = F.concat(
        lit('<html><head><meta property="og:image" content="https://og.example.com/'), ident, lit('.jpg"></head><body>'),
        F.when(c("p_type") == "PROMO", ld).when(c("p_type") == "SMALL", state).otherwise(""),
        lit('<script>var productId = "'), ident, lit('";</script><h1 class="product-name">'), c("p_name"), lit(" "), c("p_size").cast("string"), lit("ml</h1>"),
        F.when(c("p_size") > 40, lit("<p>Just a moment...</p>")).otherwise(""),
        lit('<img class="thumb" alt="Selo '), c("p_type"), lit('" src="/i/a-'), ident, lit('_x.png">'),
        lit("<h2>Modo de uso</h2><p>Aplique nos fios com "), c("p_name"), lit(" e enxágue.</p><table><tr><td>Composição</td><td>Aqua, Glycerin, "), c("p_name"),
        lit(', Parfum, Sodium Chloride, Citric Acid</td></tr></table><o-panel headertitle="Benefícios">Brilho; '), c("p_brand"),
        lit('</o-panel><div class="tab-nav"><label>Descrição</label><label>Modo de uso</label></div><div class="tab-panel--0">Uma descrição bem longa do '), c("p_name"),
        lit('</div><div class="faq-header">Ingredientes</div><div class="faq-content">Aqua, Sodium Laureth, Glycerin, '), c("p_type"), lit('</div><span class="price">por R$ 1.234,56</span></body></html>'))
    return t.spread("part").select(c("p_partkey").alias("page_id"), F.concat(lit("https://"), F.lower(F.replace("p_brand", lit("#"), lit(""))), lit(".example.com/p/"), ident).alias("url"), html.alias("html"),
                         "p_name", "p_type", "p_size", "p_brand")


_SHOP_LABELS = [("care_usage", ["modo de uso"]), ("composition", ["composição"]), ("ingredients_inci", ["ingredientes"]), ("benefits", ["benefícios"]), ("description", ["descrição"])]


@query("structured_products", """SELECT p_partkey AS page_id, p_name AS name, 'https://ld.example.com/' || p_partkey || '.png' AS image, 'Fine & ' || p_type AS description, p_retailprice AS price, 'USD' AS currency FROM part WHERE p_type = 'PROMO'""")
def structured_products(t):
    return D.jsonld_products(shop_pages(t))


@query("embedded_state", """SELECT p_partkey AS page_id, p_name AS name, 'Aqua, Glycerin, State, Parfum, Citric Acid, ' || p_brand AS inci_raw, 'Brilho; Maciez' AS benefits, 'https://st.example.com/' || p_partkey || '.png' AS image FROM part WHERE p_type = 'SMALL'""")
def embedded_state(t):
    return D.embedded_state(shop_pages(t)).select("page_id", "name", "inci_raw", "benefits", "image")


@query("shop_heading_sections", "SELECT p_partkey AS page_id, 'care_usage' AS field, 'Aplique nos fios com ' || p_name || ' e enxágue. Composição Aqua, Glycerin, ' || p_name || ', Parfum, Sodium Chloride, Citric Acid Brilho; ' || p_brand AS content FROM part")
def shop_heading_sections(t):
    s = D.heading_sections(shop_pages(t), _SHOP_LABELS, headings=["h2", "label"])
    return s.filter("tag = 'h2'").select("page_id", "field", "content")


@query("table_sections", "SELECT p_partkey AS page_id, 'ingredients_inci' AS field, 'Aqua, Glycerin, ' || p_name || ', Parfum, Sodium Chloride, Citric Acid' AS content FROM part")
def table_sections(t):
    return D.table_sections(shop_pages(t), _SHOP_LABELS).select("page_id", "field", "content")


@query("attribute_panels", "SELECT p_partkey AS page_id, 'benefits' AS field, 'Brilho; ' || p_brand AS content FROM part")
def attribute_panels(t):
    return D.attribute_panels(shop_pages(t), _SHOP_LABELS).select("page_id", "field", "content")


@query("indexed_tabs", "SELECT p_partkey AS page_id, 'description' AS field, 'Uma descrição bem longa do ' || p_name AS content FROM part")
def indexed_tabs(t):
    return D.indexed_tabs(shop_pages(t), _SHOP_LABELS).select("page_id", "field", "content")


@query("faq_pairs", "SELECT p_partkey AS page_id, 'ingredients_inci' AS field, 'Aqua, Sodium Laureth, Glycerin, ' || p_type AS content FROM part")
def faq_pairs(t):
    return D.faq_pairs(shop_pages(t), _SHOP_LABELS).select("page_id", "field", "content")


@query("list_candidates", "SELECT p_partkey AS page_id, 'Aqua, Glycerin, ' || p_name || ', Parfum, Sodium Chloride, Citric Acid' AS content FROM part")
def list_candidates(t):
    return D.list_candidates(shop_pages(t)).select("page_id", "content")


@query("selected_prices", "SELECT p_partkey AS page_id, 1234.56::DOUBLE AS price, '/i/a-' || p_partkey || '_x.png' AS image FROM part")
def selected_prices(t):
    return shop_pages(t).select("page_id", D.select_price("html", [".none", ".price"]).alias("price"), D.select_image("html", ["img.thumb"]).alias("image"))


@query("meta_images", "SELECT p_partkey AS page_id, 'https://og.example.com/' || p_partkey || '.jpg' AS image FROM part")
def meta_images(t):
    return shop_pages(t).select("page_id", D.meta_image("html").alias("image"))


@query("image_texts", "SELECT p_partkey AS page_id, 'Selo ' || p_type || '|a ' || p_partkey || ' x' AS texts FROM part")
def image_texts(t):
    return shop_pages(t).select("page_id", F.array_join(D.image_texts("html"), "|").alias("texts"))


@query("page_product_ids", "SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS product_no FROM part")
def page_product_ids(t):
    return shop_pages(t).select("page_id", D.product_id_from_html("html").alias("product_no"))


@query("spec_values", """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Aqua | ' || p_name WHEN 'SMALL' THEN p_name || ' | Parfum' WHEN 'LARGE' THEN p_brand ELSE '-' END AS value FROM part""")
def spec_values(t):
    c, lit = F.col, F.lit
    text = (
        F.when(c("p_type") == "PROMO", F.concat(lit('{"allSpecifications":["Cor","Composição"],"Cor":["x"],"Composição":["Aqua","'), c("p_name"), lit('"]}')))
        .when(c("p_type") == "SMALL", F.concat(lit('{"properties":[{"name":"INCI","values":["'), c("p_name"), lit('","Parfum"]}]}')))
        .when(c("p_type") == "LARGE", F.concat(lit('{"items":[{"variations":[{"name":"Ingredientes","values":["'), c("p_brand"), lit('"]}]}]}')))
        .otherwise(lit('{"properties":[{"name":"Cor","values":["x"]}]}')))
    return t.part.select("p_partkey", F.coalesce(D.spec_value(text), lit("-")).alias("value"))


def assembled(t):
    return I.assemble_product(shop_pages(t), _SHOP_LABELS, price_selectors=[".price"])


_LIST = "CASE WHEN p_type = 'SMALL' THEN 'Aqua, Glycerin, State, Parfum, Citric Acid, ' || p_brand ELSE 'Aqua, Sodium Laureth, Glycerin, ' || p_type END"


@query("assembled_products", f"""SELECT p_partkey AS page_id, CASE WHEN p_size > 40 THEN 'waf_challenge' ELSE '-' END AS blocked, CASE WHEN p_size > 40 THEN '-' WHEN p_type IN ('PROMO','SMALL') THEN p_name ELSE p_name || ' ' || p_size || 'ml' END AS product_name,
 CASE WHEN p_size > 40 THEN '-' WHEN p_type = 'PROMO' THEN 'https://ld.example.com/' || p_partkey || '.png' WHEN p_type = 'SMALL' THEN 'https://st.example.com/' || p_partkey || '.png' ELSE 'https://og.example.com/' || p_partkey || '.jpg' END AS image,
 CASE WHEN p_size > 40 THEN '-' WHEN p_type = 'SMALL' THEN 'Aqua, Glycerin, State, Parfum, Citric Acid, ' || p_brand ELSE 'Aqua, Glycerin, ' || p_name || ', Parfum, Sodium Chloride, Citric Acid' END AS inci_raw,
 CASE WHEN p_size > 40 THEN -1 WHEN p_type = 'PROMO' THEN p_retailprice ELSE 1234.56 END::DOUBLE AS price FROM part""")
def assembled_products(t):
    def dash(c):
        return F.coalesce(F.col(c), F.lit("-"))

    return assembled(t).select(
        "page_id", dash("blocked_reason").alias("blocked"), dash("product_name").alias("product_name"), dash("image_url_main").alias("image"),
        dash("inci_raw").alias("inci_raw"), F.coalesce("price", F.lit(-1.0)).alias("price"))


@query("page_extractions", """SELECT 'https://' || lower(replace(p_brand, '#', '')) || '.example.com/p/' || p_partkey AS product_url,
 CASE WHEN p_size > 40 THEN '[bloqueado] ' || p_partkey WHEN p_type IN ('PROMO','SMALL') THEN p_name ELSE p_name || ' ' || p_size || 'ml' END AS product_name,
 CAST(CASE WHEN p_size > 40 THEN -1 ELSE 6 END AS INT) AS items, CASE WHEN p_size > 40 THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence,
 CASE WHEN p_size > 40 THEN 'quarantined' ELSE 'quarantined' END AS status FROM part""")
def page_extractions(t):
    rows = I.gate(I.to_extraction(assembled(t), "demo"), ["example.com"])
    return rows.select("product_url", "product_name", F.coalesce(F.when(F.col("inci_ingredients").isNotNull(), F.size("inci_ingredients")), F.lit(-1)).alias("items"), "confidence",
                       F.col("verification_status").alias("status"))


@query("external_products", """SELECT 'https://' || lower(replace(p_brand, '#', '')) || '.example.com/p/' || p_partkey AS source_url, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'ones' ELSE 'twos' END AS brand_slug,
 CAST(CASE WHEN p_size > 40 THEN -1 ELSE 6 END AS INT) AS items FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%'""")
def external_products(t):
    rows = I.external_products(assembled(t), [("brand1", "ones"), ("brand2", "twos")], "shop")
    return rows.select("source_url", "brand_slug", F.coalesce(F.when(F.col("inci_ingredients").isNotNull(), F.size("inci_ingredients")), F.lit(-1)).alias("items"))




# --- structure: the expected result is stated directly -------------------------------------------------

@query("inline_sections", """SELECT p_partkey AS page_id, 'care_usage' AS field, 'Aplique nos ' || p_name || ' umidos e massageie. Depois enxágue bem 2 vezes' AS content FROM part
UNION ALL SELECT p_partkey, 'benefits', 'Brilho e ' || p_brand || ' sem peso para todos os fios' FROM part""")
def inline_sections(t):
    """Words in bold and spans are text; a labelled one starts the next section."""
    html = ("'<h3>Modo de uso</h3><p>Aplique nos <strong>' || p_name || '</strong> umidos e massageie.</p><div><span>Depois</span> enx&aacute;gue <b>bem</b> 2 vezes</div>"
            "<p><strong>Benefícios:</strong> Brilho e <span>' || p_brand || '</span> sem <b>peso</b> para todos os fios</p><h4>Outros</h4><p>nada</p>'")
    pages = t.spread("part").selectExpr("p_partkey AS page_id", f"{html} AS html")
    return D.heading_sections(pages, [("care_usage", ["modo de uso"]), ("benefits", ["benefícios"])]).select("page_id", "field", "content")


_HREFS = [("https://shop.example.com", "produto", "https://shop.example.com/produto"), ("https://shop.example.com/a/b.html", "?cor=2", "https://shop.example.com/a/b.html?cor=2"),
          ("https://shop.example.com/a/b.html", "../c", "https://shop.example.com/c"), ("https://shop.example.com/a/b/c", "./d/../e", "https://shop.example.com/a/b/e"),
          ("https://shop.example.com/a", "/x/./y/..", "https://shop.example.com/x/"), ("https://shop.example.com/a/", "../../../g", "https://shop.example.com/g"),
          ("https://shop.example.com/a?q=1#f", "//cdn.example.com/z", "https://cdn.example.com/z"), ("https://shop.example.com/a", "http://o.example.org/..a/b..", "http://o.example.org/..a/b..")]


@query("resolved_links", " UNION ALL ".join(f"SELECT p_partkey * 100 + {i} AS page_id, replace('{link}', 'shop', 'shop' || p_size) AS link FROM part" for i, (_, _, link) in enumerate(_HREFS)))
def resolved_links(t):
    """Links resolved by RFC 3986."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("base"), F.lit(h).alias("href")) for i, (b, h, _) in enumerate(_HREFS)]))
    pages = t.spread("part").select("p_partkey", "p_size", rows.alias("x")).selectExpr(
        "p_partkey * 100 + x.i AS page_id", "replace(x.base, 'shop', 'shop' || p_size) AS url", "'<a href=\"' || x.href || '\">x</a>' AS html")
    return D.page_links(pages)


@query("decoded_entities", """SELECT p_partkey AS page_id, p_name || ' €ñü®''é€ &lt; &bogus; &AMP 😀 ' || chr(65533) || '≪' AS text FROM part""")
def decoded_entities(t):
    """Named and numeric entities, each decoded once."""
    coded = F.concat("p_name", F.lit(" &euro;&ntilde;&uuml;&reg;&#x27;&#233;&#8364; &amp;lt; &bogus; &AMP &#x1F600; &#99999999;&Lt;"))
    return t.part.select(F.col("p_partkey").alias("page_id"), T.decode_entities(coded).alias("text"))
