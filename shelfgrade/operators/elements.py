"""Pages as trees: parent and end of every element, from one fold with a stack over the page's tokens.

An element is ``struct<at, tag, attrs, parent, end>``: the place of its start tag among the tokens, the place of its parent among the elements
(-1 at the top) and the place of the first token after it. Everything stays on the page's row.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.text import let
from ..vocab import market as M
from . import pages as P

# Elements without content, and which open elements a start tag ends.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BLOCKS = ["address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main",
          "nav", "ol", "p", "pre", "section", "table", "ul"]
ENDED_BY: list[tuple[list[str], list[str]]] = [
    (["p"], BLOCKS), (["p", "li"], ["li"]), (["p", "dt", "dd"], ["dt", "dd"]), (["p", "td", "th"], ["td", "th"]), (["p", "td", "th", "tr"], ["tr"]), (["option"], ["option"]),
]
# Marks of accordions and panels.
ACCORDION_BODY = "accordion.*(content|body|panel)"
PADDED = "accordion.*padding|container.*padding"
TAB_FILTERS = "filter[-_]?topic|faq[-_]?topic|tab[-_]?filter"
NOISE_PREFIXES = ["todos", "all", "ver todos", "mostrar todos", "ver mais"]
BODY_CLASSES = ["collapse__content", "tab-content", "tab-pane", "accordion-content"]
DATA_ATTRIBUTES = ["data-tab", "data-content", "data-accordion", "data-panel"]
PANEL_CLASSES = ["tab-panel", "faq-panel", "accordion-panel", "accordion-content"]
LABEL_TAGS = ["button", "h2", "h3", "h4", "a", "span", "div", "strong", "p", "b"]
BOLD = ["strong", "b"]


def element_array(toks: Column) -> Column:
    """All elements of a token array in document order. An end tag without a start tag is ignored; what is left open ends with the page."""
    stack, found, ends = "array<struct<tag:string,no:int>>", "array<struct<at:int,tag:string,attrs:string,parent:int>>", "array<struct<no:int,end:int>>"
    none = F.struct(*[F.array().cast(kind).alias(n) for n, kind in (("open", stack), ("found", found), ("ends", ends))])

    def last(xs: Column, cond) -> Column:
        return F.array_max(F.transform(xs, lambda x, i: F.when(cond(x), i)))

    def step(s: Column, t: Column) -> Column:
        closing, size = F.startswith(t["tag"], F.lit("/")), F.size(s["open"])

        def implied(x: Column) -> Column:
            hit = F.lit(False)
            for inner, by in ENDED_BY:
                hit = hit | (x["tag"].isin(inner) & t["tag"].isin(by))
            return hit

        keep = F.when(closing, F.coalesce(last(s["open"], lambda x: x["tag"] == F.substr(t["tag"], F.lit(2))), size)).otherwise(
            F.coalesce(last(s["open"], lambda x: ~implied(x)), F.lit(-1)) + 1)
        empty = t["tag"].isin(VOID) | F.endswith(t["attrs"], F.lit("/"))

        def grown(k: Column) -> Column:
            left = F.slice(s["open"], F.lit(1), k)
            gone = F.transform(F.slice(s["open"], k + 1, size), lambda x: F.struct(x["no"].alias("no"), t["pos"].alias("end")))
            no = F.size(s["found"])
            new = F.struct(t["pos"].alias("at"), t["tag"].alias("tag"), t["attrs"].alias("attrs"), F.coalesce(F.get(left, k - 1)["no"], F.lit(-1)).alias("parent"))
            return F.struct(
                F.when(closing | empty, left).otherwise(F.concat(left, F.array(F.struct(t["tag"].alias("tag"), no.alias("no"))))).alias("open"),
                F.when(closing, s["found"]).otherwise(F.concat(s["found"], F.array(new))).alias("found"),
                F.when(~closing & empty, F.concat(s["ends"], gone, F.array(F.struct(no.alias("no"), t["pos"].alias("end"))))).otherwise(F.concat(s["ends"], gone)).alias("ends"))

        return let(keep, grown)

    def finish(s: Column) -> Column:
        left = F.transform(s["open"], lambda x: F.struct(x["no"].alias("no"), F.size(toks).alias("end")))
        return let(F.sort_array(F.concat(s["ends"], left)), lambda e: F.transform(s["found"], lambda x, i: F.struct(
            x["at"].alias("at"), x["tag"].alias("tag"), x["attrs"].alias("attrs"), x["parent"].alias("parent"), F.get(e, i)["end"].alias("end"))))

    return F.aggregate(toks, none, step, finish)


class Page:
    """Questions to one page's tokens and elements; answers are columns."""

    def __init__(self, toks: Column, els: Column):
        self.toks, self.els = toks, els

    def text(self, e: Column) -> Column:
        """All text inside an element, pieces joined by blanks; null for no element."""
        own = F.transform(F.slice(self.toks, e["at"] + 1, e["end"] - e["at"]), lambda t: t["text"])
        return T.collapse_ws(F.array_join(F.filter(own, lambda x: x != ""), " "))

    def numbered(self) -> Column:
        return F.transform(self.els, lambda e, i: F.struct(i.alias("no"), *[e[n].alias(n) for n in ("at", "tag", "attrs", "parent", "end")]))

    def first(self, cond) -> Column:
        """First element, in document order, that meets a condition; null without one."""
        return F.try_element_at(F.filter(self.els, cond), F.lit(1))

    def inside(self, outer: Column, cond) -> Column:
        """First element inside another one."""
        return self.first(lambda x: (x["at"] > outer["at"]) & (x["at"] < outer["end"]) & cond(x))

    def next_sibling(self, e: Column) -> Column:
        return self.first(lambda x: (x["parent"] == e["parent"]) & (x["at"] > e["at"]))

    def next_paragraph(self, e: Column) -> Column:
        return self.first(lambda x: (x["tag"] == "p") & (x["at"] > e["at"]))

    def parent(self, e: Column) -> Column:
        return F.get(self.els, e["parent"])

    def ancestors(self, e: Column, most: int) -> Column:
        up = F.aggregate(F.sequence(F.lit(2), F.lit(most)), F.array(e["parent"]), lambda acc, _: F.concat(
            acc, F.array(F.get(self.els, F.element_at(acc, -1))["parent"])))
        return F.filter(F.transform(up, lambda no: F.get(self.els, no)), lambda x: x.isNotNull())

    def after_label(self, e: Column, label: Column) -> Column:
        """The parent's text after the label's first place in it."""
        return let(self.text(self.parent(e)), lambda whole: F.when(
            F.contains(whole, label), F.btrim(F.substring(whole, F.instr(whole, label) + F.length(label), F.length(whole)))))


def _class(e: Column) -> Column:
    return P.attr(e["attrs"], "class")


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def content_after(page: Page, h: Column, label: Column) -> Column:
    """What a heading announces: the body of its accordion, the rest of its line, its next sibling, the next paragraph, the rest of its
    parent, or a paragraph of the padded box around it; the first that is not empty."""
    bold = h["tag"].isin(BOLD)
    summary = F.try_element_at(F.filter(page.ancestors(h, 4), lambda x: x["tag"] == "summary"), F.lit(1))

    def body(s: Column) -> Column:
        return let(page.parent(s), lambda d: F.when(
            d["tag"] == "details", _none_if_empty(let(page.inside(d, lambda x: (x["tag"] == "div") & _class(x).rlike(ACCORDION_BODY)), page.text))))

    box = F.try_element_at(F.filter(page.ancestors(h, 5), lambda x: _class(x).rlike(PADDED + "|accordion-pdp")), F.lit(1))

    def paragraph(b: Column) -> Column:
        texts = F.transform(F.filter(page.els, lambda x: (x["tag"] == "p") & (x["at"] > b["at"]) & (x["at"] < b["end"])), page.text)
        return F.try_element_at(F.filter(texts, lambda x: (F.length(x) > 20) & (x != label)), F.lit(1))

    rest = _none_if_empty(page.after_label(h, label))
    return F.coalesce(
        let(summary, body), F.when(bold, rest), _none_if_empty(let(page.next_sibling(h), page.text)),
        F.when(bold, _none_if_empty(let(page.next_paragraph(h), page.text))).otherwise(rest), let(box, paragraph))


def element_section_array(toks: Column, labels: P.LabelMap, headings: list[str] = P.HEADINGS) -> Column:
    """Labelled sections by the page's structure: every labelled heading with what it announces."""
    def sections(page: Page) -> Column:
        heads = F.filter(F.transform(F.filter(page.numbered(), lambda e: e["tag"].isin(headings)), lambda e: F.struct(e.alias("e"), page.text(e).alias("label"))), lambda h: h["label"] != "")
        named = F.filter(F.transform(heads, lambda h: F.struct(h["e"].alias("e"), h["label"].alias("label"), P.label_of(h["label"], labels).alias("field"))), lambda h: h["field"].isNotNull())
        return F.transform(named, lambda h: F.struct(
            h["e"]["at"].alias("pos"), h["e"]["tag"].alias("tag"), h["field"].alias("field"),
            F.coalesce(content_after(page, h["e"], h["label"]), F.lit("")).alias("content"), h["label"].alias("source_label")))

    return P._kept(let(toks, lambda ts: let(element_array(ts), lambda els: sections(Page(ts, els)))))


def element_sections(pages: DataFrame, labels: P.LabelMap, key: str = "page_id", html: str = "html", headings: list[str] = P.HEADINGS) -> DataFrame:
    """Labelled sections of every page by its structure, one per row; computed inside the page's row, without a shuffle."""
    toks = pages.select(key, P.token_array(html).alias("toks"))
    return toks.select(key, F.explode(element_section_array(F.col("toks"), labels, headings)).alias("s")).select(key, "s.*")


# --- ingredient lists -------------------------------------------------------------------------------

def looks_like_list(c: Column) -> Column:
    return F.coalesce((F.length(c) >= 30) & c.rlike("[,;●•·]"), F.lit(False))


def without_noise(c: Column) -> Column:
    """Without button texts in front, one after another in the order of the list."""
    def cut(c: Column, prefix: str) -> Column:
        return let(c, lambda x: F.when(F.startswith(F.lower(x), F.lit(prefix)), F.ltrim(F.substring(x, len(prefix) + 1, F.length(x)))).otherwise(x))

    return reduce(cut, NOISE_PREFIXES, c)


def list_tries(page: Page, labels: list[str]) -> Column:
    """``array<struct<rank, phase, at, step, content>>``: all places that may hold an ingredient list, in order of preference."""
    kind = "array<struct<rank:int,phase:int,at:int,step:int,content:string>>"

    def hit(cond) -> Column:
        """(rank, label length) of the first label that meets a condition; null without one."""
        return F.coalesce(*[F.when(cond(lab), F.struct(F.lit(r).alias("rank"), F.lit(len(lab)).alias("size"), F.lit(lab).alias("label"))) for r, lab in enumerate(labels)])

    def entry(h: Column, phase: int, at: Column, step: int, content: Column) -> Column:
        return F.struct(h["rank"].cast("int").alias("rank"), F.lit(phase).alias("phase"), at.cast("int").alias("at"), F.lit(step).alias("step"), content.alias("content"))

    def starting(text: Column) -> Column:
        return let(F.lower(text), lambda low: hit(lambda lab: F.startswith(low, F.lit(lab))))

    def all_of(cond, value) -> Column:
        return F.transform(F.filter(page.els, cond), value)

    def texts_inside(e: Column, tags: list[str]) -> Column:
        return F.transform(F.filter(page.els, lambda x: x["tag"].isin(tags) & (x["at"] > e["at"]) & (x["at"] < e["end"])), page.text)

    def first_list(texts: Column) -> Column:
        return F.try_element_at(F.filter(texts, looks_like_list), F.lit(1))

    def padded(e: Column) -> Column:
        heading = let(page.inside(e, lambda x: x["tag"].isin("h2", "h3", "h4")), page.text)
        region = let(page.inside(e, lambda x: (x["tag"] == "div") & P.attr(x["attrs"], "id").rlike("region|content")), page.text)
        return let(starting(heading), lambda h: F.array(
            entry(h, 0, e["at"], 0, F.when(h.isNotNull(), first_list(texts_inside(e, ["p", "li"])))),
            entry(h, 0, e["at"], 1, F.when(h.isNotNull(), region))))

    def labelled(e: Column) -> Column:
        def tries(text: Column, h: Column) -> Column:
            inline = without_noise(F.btrim(F.substring(text, h["size"] + 1, F.length(text))))
            clean = F.when((F.length(text) > h["size"] + 30) & looks_like_list(inline), F.coalesce(first_list(texts_inside(e, ["p"])), inline))
            sibling = let(page.next_sibling(e), lambda s: without_noise(page.text(s)))
            paragraph = F.when(e["tag"].isin("h2", "h3", "h4", *BOLD), let(page.next_paragraph(e), page.text))
            whole = let(page.text(page.parent(e)), lambda w: F.when(F.contains(F.lower(w), h["label"]), without_noise(
                F.btrim(F.substring(w, F.instr(F.lower(w), h["label"]) + h["size"], F.length(w))))))
            aunt = let(page.next_sibling(page.parent(e)), lambda s: without_noise(page.text(s)))
            options = [clean, sibling, paragraph, whole, aunt]

            def counted(i: int, c: Column) -> Column:
                return let(c, lambda x: F.when(looks_like_list(x), entry(h, 1, e["at"], i, x)))

            # The first that holds a list counts.
            best = F.coalesce(*[counted(i, c) for i, c in enumerate(options)])
            return F.when(h.isNotNull(), F.array(best))

        return let(page.text(e), lambda text: let(starting(text), lambda h: tries(text, h)))

    def bodies() -> list[Column]:
        def by_class(i: int, name: str) -> Column:
            def one(e: Column) -> Column:
                before = F.element_at(F.filter(page.els, lambda x: (x["parent"] == e["parent"]) & (x["at"] < e["at"])), -1)
                previous = F.when(F.exists(page.els, lambda x: (x["parent"] == e["parent"]) & (x["at"] < e["at"])), before)
                word = let(F.lower(let(previous, page.text)), lambda low: hit(lambda lab: F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}_()]+", " "), F.lit(" ")).contains(f" {lab} ")))
                return let(word, lambda h: F.array(entry(h, 2, e["at"], i, F.when(h.isNotNull(), without_noise(page.text(e))))))
            return F.flatten(all_of(lambda e: F.concat(F.lit(" "), _class(e), F.lit(" ")).contains(f" {name} "), one))

        return [by_class(i, name) for i, name in enumerate(BODY_CLASSES)]

    def details(e: Column) -> Column:
        def of(s: Column) -> Column:
            rest = F.concat(F.slice(page.toks, e["at"] + 1, s["at"] - e["at"]), F.slice(page.toks, s["end"] + 1, e["end"] - s["end"]))
            text = T.collapse_ws(F.array_join(F.filter(F.transform(rest, lambda t: t["text"]), lambda x: x != ""), " "))
            return let(F.lower(page.text(s)), lambda low: let(hit(lambda lab: F.contains(low, F.lit(lab))), lambda h: F.array(entry(h, 3, e["at"], 0, F.when(F.length(text) >= 30, text)))))

        return let(page.inside(e, lambda x: x["tag"] == "summary"), of)

    def by_attribute(i: int, name: str) -> Column:
        def one(e: Column) -> Column:
            return let(F.lower(P.attr(e["attrs"], name)), lambda low: let(hit(lambda lab: F.contains(low, F.lit(lab))), lambda h: let(
                F.when(h.isNotNull(), page.text(e)), lambda x: F.array(entry(h, 4, e["at"], i, F.when(F.length(x) >= 30, x))))))

        return F.flatten(all_of(lambda e: P.attr(e["attrs"], name) != "", one))

    def panel(i: int, name: str) -> Column:
        blind = F.struct(F.lit(len(labels) + 1).alias("rank"))
        return all_of(lambda e: F.contains(_class(e), F.lit(name)), lambda e: entry(blind, 5, e["at"], i, page.text(e)))

    parts = [
        F.flatten(all_of(lambda e: (e["tag"] == "div") & _class(e).rlike(PADDED), padded)),
        F.flatten(F.filter(all_of(lambda e: e["tag"].isin(LABEL_TAGS) & ~_class(e).rlike(TAB_FILTERS), labelled), lambda x: x.isNotNull())),
        *bodies(), F.flatten(all_of(lambda e: e["tag"] == "details", details)),
        *[by_attribute(i, n) for i, n in enumerate(DATA_ATTRIBUTES)], *[panel(i, n) for i, n in enumerate(PANEL_CLASSES)],
    ]
    every = F.concat(*[F.coalesce(p, F.array()).cast(kind) for p in parts])
    return F.filter(every, lambda c: c["rank"].isNotNull() & F.when(c["phase"].isin(3, 4), c["content"].isNotNull()).otherwise(looks_like_list(c["content"])))


def best_list(toks: Column, labels: list[str] = M.LIST_LABELS) -> Column:
    """``struct<rank, phase, at, step, content>`` of the best ingredient list by structure: most specific label, then strategy, then place."""
    return let(toks, lambda ts: let(element_array(ts), lambda els: F.array_min(F.transform(
        list_tries(Page(ts, els), labels), lambda c: F.struct(c["rank"].alias("rank"), c["phase"].alias("phase"), F.when(c["phase"].isin(2, 4, 5), c["step"]).otherwise(0).alias("order"),
                                                             c["at"].alias("at"), c["step"].alias("step"), c["content"].alias("content"))))))


def element_lists(pages: DataFrame, labels: list[str] = M.LIST_LABELS, key: str = "page_id", html: str = "html") -> DataFrame:
    """The best ingredient list of every page that has one."""
    return T.once(pages, [key], "b", best_list(P.token_array(html), labels)).select(key, "b.content", "b.phase", "b.step", "b.rank")


def element_text(html: Column | str, selectors: list[str], min_len: int = 1, toks: Column | None = None) -> Column:
    """Whole text, nested elements of the same kind included, of the first selector with a non-empty element."""
    def found(ts: Column) -> Column:
        def of(els: Column) -> Column:
            page = Page(ts, els)

            def of_selector(selector: str) -> Column:
                texts = F.transform(F.filter(els, lambda e: P._matches(e, selector)), page.text)
                return F.try_element_at(F.filter(texts, lambda x: F.length(x) >= min_len), F.lit(1))

            return F.coalesce(*[of_selector(s) for s in selectors])

        return let(element_array(ts), of)

    return let(toks if toks is not None else P.token_array(html), found)
