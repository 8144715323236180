"""Sections, lists and texts by a page's structure."""
from pyspark.sql import functions as F

from shelfgrade.operators import elements as E
from shelfgrade.operators import pages as P

LABELS = [("description", ["descrição", "sobre o produto"]), ("care_usage", ["modo de uso", "como usar"]), ("ingredients_inci", ["ingredientes", "composição"]),
          ("composition", ["princípios ativos"]), ("benefits", ["benefícios"])]
INCI = "Aqua, Sodium Laureth Sulfate, Cocamidopropyl Betaine, Glycerin, Parfum, Citric Acid"
USE = "Aplique nos cabelos molhados, massageie e enxague bem."


def tree(one, html):
    v = one({"h": html}, E.element_array(P.token_array("h")))
    tags = [e["tag"] for e in v]
    return [(e["tag"], tags[e["parent"]] if e["parent"] >= 0 else None, e["end"] - e["at"]) for e in v]


def test_tree(one):
    assert tree(one, "<div><p>a<b>x</b> c<p>d<br>e</div><i/>f") == [("div", None, 6), ("p", "div", 3), ("b", "p", 1), ("p", "div", 2), ("br", "p", 0), ("i", None, 0)]
    assert tree(one, "<ul><li>a<li>b</ul></span><div>open") == [("ul", None, 3), ("li", "ul", 1), ("li", "ul", 1), ("div", None, 1)]
    assert tree(one, "<table><tr><td>a<td>b<tr><td>c</table>") == [("table", None, 6), ("tr", "table", 3), ("td", "tr", 1), ("td", "tr", 1), ("tr", "table", 2), ("td", "tr", 1)]
    assert tree(one, "no tags") == [] and one({"h": None}, E.element_array(P.token_array("h")), "h string") is None


SECTIONS = [
    # Next sibling.
    (f"<h2>Modo de Uso</h2><p>{USE}</p><p>other</p>", [("care_usage", USE)]),
    # The rest of the line after words in bold, with nested elements.
    (f"<p><strong>Ingredientes:</strong> {INCI[:20]}<i>{INCI[20:]}</i></p>", [("ingredients_inci", f"{INCI[:20].strip()} {INCI[20:].strip()}")]),
    (f"<div><b>Modo de Uso</b><p>{USE}</p></div>", [("care_usage", USE)]),
    # A paragraph further on, where the bold label stands alone in its box.
    (f"<div><div><b>Modo de Uso</b></div><section><p>{USE}</p></section></div>", [("care_usage", USE)]),
    # The rest of the parent, where nothing follows the heading as an element.
    (f"<div><h3>Modo de Uso</h3>{USE}</div>", [("care_usage", USE)]),
    # details/summary.
    (f"<details><summary><div><span>Ingredientes</span></div></summary><div class='accordion__content'>{INCI}</div></details>", [("ingredients_inci", INCI)]),
    # Padded accordion around a deeply nested heading.
    (f"<div class='accordion-pdp'><div><label><h3>Modo de Uso</h3></label></div><p>short</p><p>{USE}</p></div>", [("care_usage", USE)] * 2),
    # Tabs do not take each other.
    ("<div><label>Composição</label><label>Modo de uso</label><label>Sobre o produto</label></div>", []),
    (f"<div><button>Como usar</button><button>Ingredientes</button></div><div><h2>Ingredientes</h2><p>{INCI}</p></div>", [("ingredients_inci", INCI)]),
    # Not a list: composition. No known label, no heading, no content.
    ("<h2>Ingredientes</h2><p>Queratina e óleo de argan</p>", [("composition", "Queratina e óleo de argan")]),
    ("<h2>Avaliações</h2><p>5 estrelas</p>", []), ("<p>text only</p>", []), ("<h2>Modo de Uso</h2>", []),
]


def answers(spark, cases, expr):
    """All cases in one plan."""
    df = spark.createDataFrame([(i, f"<html><body>{h}</body></html>") for i, (h, _) in enumerate(cases)], "i int, h string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_sections(spark):
    got = answers(spark, SECTIONS, E.element_section_array(P.token_array("h"), LABELS))
    assert [[(s.field, s.content) for s in v] for v in got] == [w for _, w in SECTIONS]


LISTS = [
    (f"<div class='accordion-padding'><h3>Ingredientes</h3><div><ul><li>no</li><li>{INCI}</li></ul></div></div>", (0, 0, INCI)),
    (f"<div class='accordion-padding'><h3>Ingredientes</h3><div id='region-1'><span>{INCI}</span></div></div>", (0, 1, INCI)),
    (f"<div>Ingredientes: x y z <p>{INCI}</p></div>", (1, 0, INCI)),
    (f"<button>Ingredientes</button><div>Todos {INCI}</div>", (1, 1, INCI)),
    (f"<section><h2>Ingredientes</h2></section><section><em><p>{INCI}</p></em></section>", (1, 2, INCI)),
    (f"<section><span>Ingredientes</span>{INCI}</section>", (1, 3, INCI)),
    (f"<section><section><a>Ingredientes</a></section><ul>{INCI}</ul></section>", (1, 4, INCI)),
    (f"<section><em>Nossa Composição</em><section class='tab-pane x'>{INCI}</section></section>", (2, 2, INCI)),
    (f"<details><summary>Ver Ingredientes</summary><em>{INCI}</em> fim</details>", (3, 0, f"{INCI} fim")),
    (f"<section data-tab='tab-inci'>{INCI}</section>", (4, 0, INCI)),
    (f"<section class='jump-faq-panel--2'>{INCI}</section>", (5, 1, INCI)),
    ("<h2>Ingredientes</h2><p>curta</p>", None), ("<p>nothing</p>", None),
    # The more specific label wins, wherever it stands.
    (f"<button>Ingredientes</button><ul>a, b, c, d, e, f, g, h, i, j, k, l</ul><button>Composição completa</button><ul>{INCI}</ul>", (1, 1, INCI)),
]


def test_lists(spark):
    got = answers(spark, LISTS, E.best_list(P.token_array("h")))
    assert [v and (v.phase, v.step, v.content) for v in got] == [w for _, w in LISTS]


def test_text_of_nested_elements(one):
    html = "<div class='a'><div>x</div>y<div>z</div></div><div id='b'></div><p>w</p>"
    assert one({"h": html}, E.element_text("h", [".a"])) == "x y z"
    assert one({"h": html}, E.element_text("h", ["#b", "p"])) == "w"
    assert one({"h": html}, E.element_text("h", ["h1"])) is None


def test_long_pages_and_empty_tables(spark):
    html = "<div>" * 40 + "".join(f"<h3>Modo de Uso {i}</h3><p>{USE}</p>" for i in range(150)) + "</div>" * 40
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string").withColumn("toks", F.lit("x"))
    got = E.element_sections(df, LABELS).collect()
    assert len(got) == 150 and {r.content for r in got} == {USE} and {r.page_id for r in got} == {1}
    assert E.element_sections(df.limit(0), LABELS).collect() == [] and E.element_lists(df).filter("page_id > 1").collect() == []
