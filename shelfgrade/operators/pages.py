"""Pages to rows. Input is a table of pages (page_id, url, html).

A page is cut once into tokens (tag, attributes, text that follows); everything else is expressions
over those tokens. The tokens of a page stay one array on the page's row wherever the work is inside
a page, so extraction needs no shuffle; only :func:`page_tokens` explodes them.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.lists import dedupe_ci, first_by
from ..functions.text import _c, let
from ..functions.urls import canonical_url, host_allowed, resolve_url, url_host
from ..vocab import market as M
from . import classify as C

_TAG = r"<(/?[a-zA-Z][a-zA-Z0-9-]*)([^>]*)>([^<]*)"
HEADINGS = ["h2", "h3", "h4", "button", "strong", "b", "span", "label"]

#: Headings that are also used inside running text.
INLINE = ["button", "strong", "b", "span", "label"]

LabelMap = list[tuple[str, list[str]]]


def without_scripts(html: Column | str) -> Column:
    """The page without script and style bodies and comments (one alternative per element)."""
    s = _c(html)
    for tag in ("script", "style", "noscript"):
        s = F.regexp_replace(s, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return F.regexp_replace(s, "(?s)<!--.*?-->", " ")


def token_array(html: Column | str) -> Column:
    """``array<struct<pos, tag, attrs, text>>`` in document order; closing tags keep their slash."""
    whole = F.regexp_extract_all(without_scripts(html), F.lit(_TAG), F.lit(0))
    return F.transform(whole, lambda t, i: F.struct(
        i.alias("pos"), F.lower(F.regexp_extract(t, _TAG, 1)).alias("tag"), F.regexp_extract(t, _TAG, 2).alias("attrs"),
        T.collapse_ws(T.decode_entities(F.regexp_extract(t, _TAG, 3))).alias("text")))


def page_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, F.explode(token_array(html)).alias("t")).select(key, "t.*")


def attr(attrs: Column, name: str) -> Column:
    """Value of an attribute in double, single or no quotes; empty when absent."""
    pat = rf"""(?i)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.concat(*[F.coalesce(F.regexp_extract(attrs, pat, g), F.lit("")) for g in (1, 2, 3)])


def _script_bodies(html: Column, kind: str) -> Column:
    pat = rf"""(?is)<script[^>]*{kind}[^>]*>(.*?)</script>"""
    return F.regexp_extract_all(html, F.lit(pat), F.lit(1))


def jsonld_product(html: Column | str) -> Column:
    """``struct<name, image, description, price, currency>`` of the first Product block; null without one."""
    none = F.array().cast("array<variant>")

    def items(body: Column) -> Column:
        return let(F.try_parse_json(body), lambda v: F.when(
            F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.array(v)).otherwise(
            F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)))

    def get(item: Column, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(item, path, kind)

    def row(item: Column) -> Column:
        image = F.coalesce(*[get(item, p) for p in (
            "$.image[0].url", "$.image[0].contentUrl", "$.image[0].src", "$.image[0]", "$.image.url", "$.image.contentUrl", "$.image.src", "$.image")])
        price = F.coalesce(*[F.nullif(get(item, p), F.lit("0")) for p in ("$.offers.price", "$.offers.lowPrice", "$.offers.offers[0].price")])
        return F.struct(
            get(item, "$.name").alias("name"), F.when(~F.startswith(image, F.lit("{")), image).alias("image"),
            T.clean_text(get(item, "$.description")).alias("description"), price.try_cast("double").alias("price"),
            F.when(price.isNotNull(), F.coalesce(get(item, "$.offers.priceCurrency"), F.lit("BRL"))).alias("currency"))

    blocks = F.flatten(F.transform(_script_bodies(_c(html), r"application/ld\+json"), items))
    products = F.filter(blocks, lambda i: F.coalesce(get(i, "$['@type']") == "Product", F.lit(False)))
    return F.try_element_at(F.transform(F.slice(products, 1, 1), row), F.lit(1))


def jsonld_products(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, jsonld_product(html).alias("p")).filter(F.col("p").isNotNull()).select(key, "p.*")


# Benefit keys of framework state, and marks of placeholder images.
BENEFIT_KEYS = ["productBenefits", "benefits", "keyBenefits", "whyChooseUs", "features", "productFeatures", "highlights", "results"]
PLACEHOLDERS = ["thumbnail", "_icon.", "/icon.", "placeholder", "default.svg"]


def page_state(html: Column | str) -> Column:
    """``struct<name, inci_raw, description, benefits, image>`` from the framework state; null without one."""
    body = F.try_element_at(_script_bodies(_c(html), "__NEXT_DATA__"), F.lit(1))
    a, b = "$.props.pageProps.data.productCollection.items[0]", "$.props.pageProps.content.product"

    def row(v: Column) -> Column:
        def get(*paths: str) -> Column:
            return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])

        def joined(path: str) -> Column:
            return F.nullif(F.array_join(F.try_variant_get(v, path, "array<string>"), "; "), F.lit(""))

        paths = [f"{a}.{k}" for k in BENEFIT_KEYS] + [f"{b}.{k}" for k in ("benefits", "productBenefits", "features", "highlights")]
        benefits = F.coalesce(*[x for p in paths for x in (joined(p), get(p))])
        raw = get(f"{a}.packshot.url", f"{a}.packshot", f"{b}.image.fields.file.url", f"{b}.image")
        image = F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).otherwise(raw)
        return F.when(v.isNotNull(), F.struct(
            get(f"{a}.productName", f"{b}.name").alias("name"), get(f"{a}.allIngredients", f"{b}.ingredients").alias("inci_raw"),
            T.clean_text(get(f"{a}.productDescription")).alias("description"), T.clean_text(benefits).alias("benefits"),
            F.when(~T.contains_any(F.lower(image), PLACEHOLDERS), image).alias("image")))

    return let(F.try_parse_json(body), row)


def embedded_state(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, page_state(html).alias("p")).filter(F.col("p").isNotNull()).select(key, "p.*")


def _ordered_labels(labels: LabelMap) -> list[tuple[str, str]]:
    """(label key, field): longest label first, then field priority."""
    rank = {f: i for i, f in enumerate(M.FIELD_PRIORITY)}
    flat = [(" ".join(M.plain(x).lower().split()), f) for f, words in labels for x in words]
    return sorted(flat, key=lambda lf: (-len(lf[0]), rank.get(lf[1], 99)))


def label_of(heading: Column, labels: LabelMap) -> Column:
    """Field of the first label that starts the heading."""
    key = T.norm_label(heading)
    return C.first_match([(F.startswith(key, F.lit(lab)), F.lit(f)) for lab, f in _ordered_labels(labels)])


def _found(pos: Column, tag: Column, label: Column, content: Column, labels: LabelMap) -> Column:
    return F.struct(pos.alias("pos"), tag.alias("tag"), label_of(label, labels).alias("field"),
                    F.coalesce(content, F.lit("")).alias("content"), label.alias("source_label"))


def _kept(found: Column) -> Column:
    """Shared last step: drop unlabelled and noisy sections, decide list or composition."""
    ok = F.filter(found, lambda s: s["field"].isNotNull() & (s["content"] != "") & ~C.tab_noise(s["content"]) & ~(
        s["tag"].isin("button", "label") & (F.length(s["content"]) < 30)))
    return F.transform(ok, lambda s: F.struct(
        s["pos"].alias("pos"), s["tag"].alias("tag"), C.list_or_composition(s["field"], s["content"]).alias("field"),
        s["content"].alias("content"), s["source_label"].alias("source_label")))


def heading_section_array(toks: Column, labels: LabelMap, headings: list[str] = HEADINGS) -> Column:
    """Labelled sections of a token array.

    A section runs from a labelled heading to the next heading of block kind or the next labelled one of any kind. Other
    inline elements, such as words in bold, are part of the text.
    """
    def cut(heads: Column) -> Column:
        marked = F.transform(heads, lambda h, i: F.struct(
            h["pos"].alias("pos"), h["tag"].alias("tag"), h["text"].alias("label"),
            F.coalesce(F.get(heads, i + 1)["pos"], F.size(toks)).alias("stop"), label_of(h["text"], labels).alias("field")))

        def text(m: Column) -> Column:
            body = F.slice(toks, m["pos"] + 2, F.greatest(m["stop"] - m["pos"] - 1, F.lit(0)))
            return T.collapse_ws(F.array_join(F.filter(F.transform(body, lambda t: t["text"]), lambda x: x != ""), " "))

        return F.transform(F.filter(marked, lambda m: m["field"].isNotNull()), lambda m: F.struct(
            m["pos"].alias("pos"), m["tag"].alias("tag"), m["field"].alias("field"), text(m).alias("content"), m["label"].alias("source_label")))

    block = [h for h in headings if h not in INLINE]
    heads = F.filter(toks, lambda t: t["tag"].isin(headings) & (t["text"] != "") & (t["tag"].isin(block) | label_of(t["text"], labels).isNotNull()))
    return _kept(let(heads, cut))


def table_section_array(html: Column | str, labels: LabelMap) -> Column:
    """Label and content from table rows: first cell and last cell."""
    rows = F.regexp_extract_all(without_scripts(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), T.clean_text))
    wide = F.filter(F.transform(cells, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda r: F.size(r["c"]) >= 2)
    return _kept(F.transform(wide, lambda r: _found(r["i"], F.lit("td"), F.element_at(r["c"], 1), F.element_at(r["c"], -1), labels)))


def panel_section_array(html: Column | str, labels: LabelMap, attribute: str = "headertitle") -> Column:
    """Panels that carry their title in an attribute."""
    pat = rf"""(?is)<([a-z][a-z0-9-]*)\b[^>]*\b{attribute}\s*=\s*"([^"]*)"[^>]*>(.*?)</\1\s*>"""
    whole = F.regexp_extract_all(without_scripts(html), F.lit(pat), F.lit(0))
    return _kept(F.transform(whole, lambda p, i: _found(
        i, F.regexp_extract(p, pat, 1), F.regexp_extract(p, pat, 2), T.clean_text(F.regexp_extract(p, pat, 3)), labels)))


def tab_section_array(html: Column | str, labels: LabelMap) -> Column:
    """The i-th tab label belongs to the first panel numbered i."""
    panel = r"""(?is)<(\w+)[^>]*class\s*=\s*"[^"]*(?:tab|faq)[_-](?:tab[_-])?panel[_-]{1,2}(\d+)[^"]*"[^>]*>(.*?)</\1>"""

    def paired(s: Column) -> Column:
        nav = F.regexp_extract(s, r"""(?is)class\s*=\s*"[^"]*(?:tab.?nav|faq.?nav)[^"]*"[^>]*>(.*?)</(?:div|nav|ul)>""", 1)
        tabs = F.transform(F.regexp_extract_all(nav, F.lit(r"(?is)<label\b[^>]*>(.*?)</label>"), F.lit(1)), T.clean_text)
        panels = F.transform(F.regexp_extract_all(s, F.lit(panel), F.lit(0)), lambda p: F.struct(
            F.regexp_extract(p, panel, 2).try_cast("int").alias("no"), F.coalesce(T.clean_text(F.regexp_extract(p, panel, 3)), F.lit("")).alias("text")))
        return let(panels, lambda ps: F.filter(F.transform(tabs, lambda tab, i: _found(
            i, F.lit("div"), tab, F.try_element_at(F.filter(ps, lambda p: p["no"] == i), F.lit(1))["text"], labels)),
            lambda f: F.length(f["content"]) >= 30))

    return _kept(let(without_scripts(html), paired))


def faq_section_array(html: Column | str, labels: LabelMap) -> Column:
    """Header and content blocks told apart by their class names; a header takes the next content block."""
    part = r"""(?is)<div[^>]*class\s*=\s*"([^"]*)"[^>]*>(.*?)(?=<div|</div|$)"""
    head, body = "(question|faq|accordion).*(header|title|label)", "(question|faq|accordion).*(text|content|body|answer|panel)"
    blocks = F.transform(F.regexp_extract_all(without_scripts(html), F.lit(part), F.lit(0)), lambda b, i: F.struct(
        i.alias("pos"), F.lower(F.regexp_extract(b, part, 1)).alias("cls"), F.coalesce(T.clean_text(F.regexp_extract(b, part, 2)), F.lit("")).alias("text")))

    def paired(bs: Column) -> Column:
        heads = F.filter(bs, lambda x: x["cls"].rlike(head) & F.length(x["text"]).between(1, 80))
        return F.transform(heads, lambda h: _found(h["pos"], F.lit("div"), h["text"], F.try_element_at(
            F.filter(bs, lambda x: (x["pos"] > h["pos"]) & x["cls"].rlike(body) & (x["text"] != "")), F.lit(1))["text"], labels))

    return _kept(let(blocks, paired))


def all_sections(toks: Column, html: Column | str, labels: LabelMap, headings: list[str] = HEADINGS) -> Column:
    """Sections of all five kinds in order of preference: headings, tables, panels, tabs, question pairs."""
    return F.concat(heading_section_array(toks, labels, headings), table_section_array(html, labels), panel_section_array(html, labels),
                    tab_section_array(html, labels), faq_section_array(html, labels))


def _exploded(pages: DataFrame, key: str, sections: Column) -> DataFrame:
    return pages.select(key, F.explode(sections).alias("s")).select(key, "s.*")


def heading_sections(
    pages: DataFrame, labels: LabelMap, key: str = "page_id", html: str = "html", headings: list[str] = HEADINGS
) -> DataFrame:
    """Labelled sections of every page, one per row; computed inside the page's row, without a shuffle."""
    return _exploded(pages.select(key, token_array(html).alias("toks")), key, heading_section_array(F.col("toks"), labels, headings))


def table_sections(pages: DataFrame, labels: LabelMap, key: str = "page_id", html: str = "html") -> DataFrame:
    return _exploded(pages, key, table_section_array(html, labels))


def attribute_panels(pages: DataFrame, labels: LabelMap, key: str = "page_id", html: str = "html") -> DataFrame:
    return _exploded(pages, key, panel_section_array(html, labels))


def indexed_tabs(pages: DataFrame, labels: LabelMap, key: str = "page_id", html: str = "html") -> DataFrame:
    return _exploded(pages, key, tab_section_array(html, labels))


def faq_pairs(pages: DataFrame, labels: LabelMap, key: str = "page_id", html: str = "html") -> DataFrame:
    return _exploded(pages, key, faq_section_array(html, labels))


def best_list_candidate(toks: Column, html: Column | str, labels: list[str] = M.LIST_LABELS) -> Column:
    """``struct<rank, strategy, at, content>`` of the best ingredient list: most specific label, then strategy, then place."""
    def labelled(t: Column, i: Column) -> Column:
        low = F.lower(t["text"])
        hit = C.first_match([(F.startswith(low, F.lit(lab)), F.struct(F.lit(r).alias("rank"), F.lit(len(lab)).alias("len"))) for r, lab in enumerate(labels)])
        return F.struct(i.alias("at"), t["text"].alias("text"), hit.alias("hit"))

    def tries(m: Column) -> Column:
        inline = F.btrim(F.substring(m["text"], m["hit"]["len"] + 1, F.length(m["text"])), F.lit(" :-"))
        options = [inline] + [F.coalesce(F.get(toks, m["at"] + k)["text"], F.lit("")) for k in (1, 2, 3)]
        return F.array(*[F.struct(m["hit"]["rank"].alias("rank"), F.lit(i).alias("strategy"), m["at"].alias("at"), c.alias("content")) for i, c in enumerate(options)])

    near = F.flatten(F.transform(F.filter(F.transform(toks, labelled), lambda m: m["hit"].isNotNull()), tries))
    panel = r"""(?is)class\s*=\s*"[^"]*(?:tab-panel|faq-panel|accordion-panel|accordion-content|collapse__content|tab-content|tab-pane)[^"]*"[^>]*>(.*?)</div>"""
    blind = F.transform(F.regexp_extract_all(without_scripts(html), F.lit(panel), F.lit(1)), lambda p, i: F.struct(
        F.lit(len(labels) + 1).alias("rank"), F.lit(9).alias("strategy"), i.alias("at"), F.coalesce(T.clean_text(p), F.lit("")).alias("content")))
    return F.array_min(F.filter(F.concat(near, blind), lambda c: C.list_like(c["content"], True)))


def list_candidates(pages: DataFrame, labels: list[str] = M.LIST_LABELS, key: str = "page_id", html: str = "html") -> DataFrame:
    d = T.once(pages, [key, html], "toks", token_array(html))
    return T.once(d, [key], "b", best_list_candidate(F.col("toks"), html, labels)).select(key, "b.content", "b.strategy", "b.rank")


def _matches(t: Column, selector: str) -> Column:
    """tag, .class, #id, tag.class and [attr='value'] selectors on one token."""
    m = re.fullmatch(r"([a-z0-9]*)?(?:\.([\w-]+))?(?:#([\w-]+))?(?:\[([\w-]+)='([^']*)'\])?", selector)
    if not m:
        raise ValueError(f"unsupported selector: {selector}")
    tag, cls, ident, name, value = m.groups()
    cond = ~F.startswith(t["tag"], F.lit("/"))
    if tag:
        cond = cond & (t["tag"] == tag)
    if cls:
        cond = cond & F.concat(F.lit(" "), attr(t["attrs"], "class"), F.lit(" ")).contains(f" {cls} ")
    if ident:
        cond = cond & (attr(t["attrs"], "id") == ident)
    if name:
        cond = cond & (attr(t["attrs"], name) == value)
    return cond


def select_first(html: Column | str, selectors: list[str], min_len: int = 1, toks: Column | None = None) -> Column:
    """Text of the first selector, in order, with a non-empty element.

    The text of an element is its own text and that of the following tokens up to a tag of its kind.
    """
    def found(toks: Column) -> Column:
        def body(h: Column) -> Column:
            tail = F.filter(toks, lambda t: t["pos"] > h["pos"])
            ends = F.filter(tail, lambda t: t["tag"].isin(F.concat(F.lit("/"), h["tag"]), h["tag"]))
            stop = F.coalesce(F.try_element_at(ends, F.lit(1))["pos"], F.size(toks))
            own = F.slice(toks, h["pos"] + 1, stop - h["pos"])
            return T.collapse_ws(F.array_join(F.transform(own, lambda t: t["text"]), " "))

        def text_of(sel: str) -> Column:
            texts = F.transform(F.filter(toks, lambda t: _matches(t, sel)), body)
            return F.try_element_at(F.filter(texts, lambda x: F.length(x) >= min_len), F.lit(1))

        return F.coalesce(*[text_of(s) for s in selectors])

    return found(toks) if toks is not None else let(token_array(html), found)


def _first_value(toks: Column, selector: str, value) -> Column:
    hits = F.filter(toks, lambda t: _matches(t, selector))
    return F.try_element_at(F.filter(F.transform(hits, value), lambda x: x.isNotNull()), F.lit(1))


def select_price(html: Column | str, selectors: list[str], toks: Column | None = None) -> Column:
    """First price in an element of the first selector that holds one."""
    def found(ts: Column) -> Column:
        return F.coalesce(*[_first_value(ts, s, lambda t: T.parse_brl(t["text"])) for s in selectors])

    return found(toks) if toks is not None else let(token_array(html), found)


def select_image(html: Column | str, selectors: list[str], toks: Column | None = None) -> Column:
    """Image address of the first selector: lazy source before plain source, never a data URI."""
    def src(t: Column) -> Column:
        lazy, plain = F.nullif(attr(t["attrs"], "data-src"), F.lit("")), F.nullif(attr(t["attrs"], "src"), F.lit(""))
        return F.coalesce(lazy, F.when(~F.startswith(plain, F.lit("data:")), plain))

    def found(ts: Column) -> Column:
        return F.coalesce(*[_first_value(ts, s, src) for s in selectors])

    return found(toks) if toks is not None else let(token_array(html), found)


def meta_image(html: Column | str) -> Column:
    tag = F.regexp_extract(_c(html), r"""(?is)<meta\b[^>]*property\s*=\s*["']og:image["'][^>]*>""", 0)
    return F.nullif(attr(tag, "content"), F.lit(""))


def image_texts(html: Column | str) -> Column:
    """Alt text, title and cleaned file name of the images, below 200 characters, distinct without case."""
    imgs = F.regexp_extract_all(_c(html), F.lit(r"(?is)<img\b([^>]*)>"), F.lit(1))

    def parts(a: Column) -> Column:
        src = F.coalesce(F.nullif(attr(a, "src"), F.lit("")), attr(a, "data-src"))
        file = F.regexp_replace(F.substring_index(src, "/", -1), r"\.[^.]*$", "")
        return F.array(T.strip_ws(attr(a, "alt")), T.strip_ws(attr(a, "title")), T.strip_ws(F.translate(F.when(F.contains(src, F.lit("/")), file).otherwise(src), "-_", "  ")))

    texts = F.filter(F.flatten(F.transform(imgs, parts)), lambda x: (x != "") & (F.length(x) < 200))
    return dedupe_ci(texts)


def page_links(pages: DataFrame, domains: list[str] | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, link): resolved, canonical, distinct links; with ``domains``, only those hosts."""
    raw = F.regexp_extract_all(without_scripts(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    d = pages.select(key, url, F.explode(F.array_distinct(raw)).alias("href")).filter(
        (F.col("href") != "") & ~F.col("href").rlike(r"(?i)^(#|mailto:|tel:|javascript:)"))
    links = T.once(d, [key], "link", let(resolve_url(F.col(url), F.col("href")), canonical_url))
    if domains is not None:
        links = links.filter(host_allowed("link", domains))
    return links.distinct()


def same_site_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Links that stay on the page's own host."""
    links = page_links(pages, None, key, url, html).join(pages.select(key, url_host(url).alias("_h")), key)
    return links.filter(url_host("link") == F.col("_h")).drop("_h")


def visible_text(html: Column | str, limit: int | None = None) -> Column:
    """Page text without scripts, styles, navigation, header and footer."""
    s = without_scripts(html)
    for tag in ("nav", "header", "footer"):
        s = F.regexp_replace(s, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    s = T.collapse_ws(T.decode_entities(F.regexp_replace(s, "<[^>]+>", " ")))
    return s if limit is None else F.left(s, F.lit(limit))


def split_description(text: Column | str, markers: list[tuple[str, str]] = M.BLOB_MARKERS) -> Column:
    """``map<field, segment>`` of a text with inline section headers; empty map without any.

    A header counts when it is anchored (start, sentence end, bullet, line break) and followed by a
    separator. The text is split at the headers, so segment i belongs to header i.
    """
    s = _c(text)
    names = "|".join(p for _f, p in markers)
    head = r"(?:^|[\n\r.;•·)\]])\s*(" + names + r")\s*[:\-–—]\s*"
    ci = "(?i)" + head
    titles = F.transform(F.regexp_extract_all(s, F.lit(ci), F.lit(1)), F.lower)
    parts = F.transform(F.split(F.regexp_replace(s, ci, "\x1e"), "\x1e"), lambda p: F.btrim(p, F.lit(" \n\r\t:-–—•·")))

    def field(title: Column) -> Column:
        return C.first_match([(title.rlike(f"^(?:{p})$"), F.lit(f)) for f, p in markers])

    fields = F.transform(titles, field)
    rows = F.zip_with(fields, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda f, p: F.struct(f.alias("f"), p.alias("p")))
    filled = F.filter(rows, lambda r: r["p"] != "")
    firsts = first_by(filled, lambda r: r["f"])
    lead = F.element_at(parts, 1)
    first = F.when(lead != "", F.array(F.struct(F.lit("description").alias("f"), lead.alias("p"))))
    both = F.concat(F.coalesce(first, F.array().cast("array<struct<f:string,p:string>>")), firsts)
    none = F.create_map().cast("map<string,string>")
    return F.when(F.coalesce(F.size(titles), F.lit(0)) > 0, F.map_from_entries(both)).otherwise(none)


_FOOTER = (
    r"<(?:/?p|/?h[1-6]|br|div)\b|\b(?:modo\s+de\s+uso|como\s+usar|how\s+to\s+use|directions|benef[ií]cios|benefits|"
    r"advert[eê]ncia|warnings|validade|reg\.\s*ms|sac|cnpj|fabricante)\b")


def inline_list_block(text: Column | str, limit: int | None = None) -> Column:
    """The ingredient block behind an inline header, up to the next heading; null when implausible.

    A ``limit`` cuts blocks that no heading ends.
    """
    s = F.coalesce(_c(text), F.lit(""))
    head = r"(?is)(?:^|[^a-zA-ZÀ-ÿ])(?:composi[cç][aã]o(?:\s*\(inci\))?|ingredientes|ingredients|inci)\s*[:\-]\s*"
    tail = F.regexp_extract(s, head + "(.*)$", 1)
    block = F.regexp_extract(tail, rf"(?is)^(.*?)(?:{_FOOTER}|$)", 1)
    ended = F.lower(tail).rlike(f"(?is){_FOOTER}")
    kept = F.when(ended, block).otherwise(T.head(block, limit))
    neat = F.btrim(T.collapse_ws(F.regexp_replace(kept, "<[^>]+>", " ")), F.lit(" .;,"))
    return F.when((F.length(s) >= 30) & (F.length(neat) >= 30) & neat.rlike("[,;|·•]"), neat)


def spec_value(json_text: Column | str, keys: list[str] = M.LIST_SPEC_KEYS) -> Column:
    """Value of the first listed specification key in a product's JSON: flat, as a property, or on the first item."""
    v = F.try_parse_json(_c(json_text))
    wanted = F.array(*[F.lit(k) for k in keys])

    def known(name: Column) -> Column:
        return F.array_contains(wanted, F.lower(F.trim(name)))

    names = F.filter(F.coalesce(F.try_variant_get(v, "$.allSpecifications", "array<string>"), F.array().cast("array<string>")), known)
    flat_map = F.try_variant_get(v, "$", "map<string,variant>")

    def flat(n: Column) -> Column:
        value = F.try_element_at(flat_map, n)
        return F.coalesce(
            F.nullif(F.array_join(F.try_variant_get(value, "$", "array<string>"), " | "), F.lit("")),
            F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))

    def from_list(path: str) -> Column:
        props = F.try_variant_get(v, path, "array<struct<name:string,values:array<string>>>")
        hits = F.filter(F.coalesce(props, F.array().cast("array<struct<name:string,values:array<string>>>")), lambda p: known(p["name"]) & (F.size(p["values"]) > 0))
        return F.nullif(F.array_join(F.try_element_at(hits, F.lit(1))["values"], " | "), F.lit(""))

    first_flat = F.try_element_at(F.filter(F.transform(names, flat), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(first_flat, from_list("$.properties"), from_list("$.items[0].variations"))


def product_id_from_html(html: Column | str) -> Column:
    """Shop product number embedded in a page; four spellings in order."""
    pats = [
        r'"productId"\s*:\s*"?(\d+)"?', r'"product_id"\s*:\s*"?(\d+)"?', r"productId\s*=\s*['\"]?(\d+)['\"]?", r'data-product-id\s*=\s*"(\d+)"']
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(html), p, 1), F.lit("")) for p in pats])


def evidence_rows(df: DataFrame, key: str, url: str, sources: list[tuple[str, str, str, str]], limit: int | None = None) -> DataFrame:
    """One row per filled source column, with its whole text or the first ``limit`` characters. ``sources``: (column, field, locator, method)."""
    entries = F.array(*[
        F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(
            F.lit(f).alias("field_name"), F.lit(loc).alias("evidence_locator"),
            T.head(F.col(c).cast("string"), limit).alias("raw_source_text"), F.lit(m).alias("extraction_method")))
        for c, f, loc, m in sources])
    return df.select(key, F.col(url).alias("source_url"), F.explode(F.array_compact(entries)).alias("e")).select(key, "source_url", "e.*")
