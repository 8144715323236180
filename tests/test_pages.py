"""A hand-written product page through the page operators."""

from shelfgrade.operators import pages as D
from shelfgrade.plans import ingest as I
from shelfgrade.sources import readers as A

PAGE = """<html><head><meta property="og:image" content="https://cdn.a.com/og.jpg"><script>var x = "<h2>Modo de uso</h2>";</script></head>
<body><nav><a href="/menu">Menu</a></nav><h1>Shampoo Hidratante 300ml</h1>
<img class="product-img" src="data:x" data-src="https://cdn.a.com/p.jpg" alt="Selo Vegano" title="">
<h2>Ingredientes</h2><p>Aqua, Sodium Laureth Sulfate, Glycerin, Parfum, Citric Acid, Sodium Chloride</p>
<h2>Modo de uso</h2><p>Aplique nos cabelos <i>úmidos</i> e enxágue bem.</p>
<button>Benefícios</button><span class="price">R$ 1.059,90</span><a href="p/2?utm_source=x#t">outro</a></body></html>"""
LABELS = [("care_usage", ["modo de uso", "como usar"]), ("ingredients_inci", ["ingredientes"]), ("benefits", ["benefícios"])]


def frame(spark, html=PAGE, url="https://www.a.com/shop/p/1"):
    return spark.createDataFrame([(1, url, html)], "page_id BIGINT, url STRING, html STRING")


def test_heading_sections(spark):
    got = {r["field"]: r["content"] for r in D.heading_sections(frame(spark), LABELS).collect()}
    assert got["ingredients_inci"].startswith("Aqua, Sodium Laureth Sulfate") and got["care_usage"] == "Aplique nos cabelos úmidos e enxágue bem."
    assert "benefits" not in got  # too short behind a button


def test_whole_page(spark):
    a = I.assemble_product(frame(spark), LABELS, price_selectors=[".price"]).first()
    assert (a["product_name"], a["image_url_main"], a["price"], a["currency"]) == ("Shampoo Hidratante 300ml", "https://cdn.a.com/p.jpg", 1059.9, "BRL")
    row = I.gate(I.to_extraction(I.assemble_product(frame(spark), LABELS), "a"), ["a.com"]).first()
    assert row["verification_status"] == "verified_inci" and row["gate"]["failed"] == [] and len(row["inci_ingredients"]) == 6
    assert row["usage_instructions"].startswith("Aplique") and row["product_category"] == "shampoo"


def test_blocked_page(spark):
    html = "<html><title>Just a moment...</title></html>"
    row = I.gate(I.to_extraction(I.assemble_product(frame(spark, html), LABELS), "a"), ["a.com"]).first()
    assert row["product_name"] == "[bloqueado] 1" and row["gate"]["failed"] == ["waf_challenge"]


def test_structured_data_shapes(spark):
    shapes = {
        '{"@type":"Product","name":"A","image":{"url":"u"},"offers":{"lowPrice":"5.5"}}': ("A", "u", 5.5),
        '[{"@type":"Thing"},{"@type":"Product","name":"B","image":"v","offers":{"offers":[{"price":3}]}}]': ("B", "v", 3.0),
        '{"@type":"Product","name":"C","image":["w"]}': ("C", "w", None)}
    for body, want in shapes.items():
        r = D.jsonld_products(frame(spark, f'<script type="application/ld+json">{{broken</script><script type="application/ld+json">{body}</script>')).first()
        assert (r["name"], r["image"], r["price"]) == want


def test_links_texts_images(spark):
    assert [r["link"] for r in D.page_links(frame(spark), ["a.com"]).orderBy("link").collect()] == ["https://www.a.com/menu", "https://www.a.com/shop/p/p/2"]
    row = frame(spark).select(D.image_texts("html").alias("t"), D.visible_text("html").alias("v"), D.meta_image("html").alias("m")).first()
    assert row["t"] == ["Selo Vegano", "data:x"]
    assert "Menu" not in row["v"] and "Shampoo" in row["v"] and row["m"] == "https://cdn.a.com/og.jpg"


def test_split_description(one):
    text = "Limpa os fios. Modo de uso: Aplique e enxágue. Composição: Queratina"
    assert one({"x": text}, D.split_description("x")) == {"description": "Limpa os fios", "care_usage": "Aplique e enxágue", "composition": "Queratina"}
    assert one({"x": "aprenda como usar o produto"}, D.split_description("x")) == {}


def test_inline_list_block(one):
    text = "Novo <p>Composição: Aqua, Glycerin, Parfum, Citric Acid</p> Modo de uso: aplique"
    assert one({"x": text}, D.inline_list_block("x")) == "Aqua, Glycerin, Parfum, Citric Acid"
    assert one({"x": "sem cabeçalho, mas com vírgulas, e bem comprido"}, D.inline_list_block("x")) is None


def test_sitemap_index(spark):
    docs = spark.createDataFrame([
        ("i", "<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc>https://x/1</loc></url><url><loc>https://x/2</loc></url></urlset>"),
        ("bad", "<urlset><url><loc>")], "url STRING, xml STRING")
    got = {tuple(r) for r in A.sitemap_to_urls(docs).collect()}
    assert got == {("a", "https://x/1"), ("a", "https://x/2"), ("i", "https://x/1"), ("i", "https://x/2")}


def test_files(spark, tmp_path):
    (tmp_path / "brands.json").write_text('[{"brand_slug":"b","priority":2},{"brand_slug":"a","priority":1},{"brand_slug":"c"}]')
    assert [r["brand_slug"] for r in A.load_brands(spark, str(tmp_path / "brands.json"), first=2).collect()] == ["a", "b"]
    (tmp_path / "urls.txt").write_text("# list\nhttps://x/1\n\n https://x/2 \n")
    assert [r["url"] for r in A.read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://x/1", "https://x/2"]
    (tmp_path / "vocab.yaml").write_text("seals:\n  vegan:\n    keywords: [Vegano, vegan]\n  bio:\n    keywords: [bio]\n")
    assert A.load_vocab(tmp_path / "vocab.yaml") == [("vegan", ["vegano", "vegan"]), ("bio", ["bio"])]
    recipes = tmp_path / "recipes"
    recipes.mkdir()
    (recipes / "a.yaml").write_text("brand_slug: a\nallowed_domains: [a.com]\ndiscovery: {product_url_pattern: /p/}\nextraction: {section_label_map: {care_usage: {labels: [modo de uso]}}}\n")
    r = A.load_recipes(spark, recipes).first()
    assert (r["brand_slug"], r["discovery"]["product_url_pattern"], r["extraction"]["section_label_map"]) == ("a", "/p/", {"care_usage": ["modo de uso"]})
    kb = tmp_path / "kb"
    kb.mkdir()
    (kb / "one.md").write_text("a\r\n\n\n\nb")
    (kb / "_skip.md").write_text("x")
    got = A.read_documents(spark, str(kb / "*.md")).collect()
    assert [(x["source"], x["content"]) for x in got] == [("one", "a\n\nb")]
