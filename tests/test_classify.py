"""Goldens of the classifiers on the default market vocabulary."""
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfgrade.functions import text as T
from shelfgrade.operators import classify as C


@pytest.mark.parametrize("name, want", [
    ("Água Oxigenada 20 vol", "oxidante"), ("Shampoo Reconstrutor", "reconstructor"), ("Creme de Pentear Cachos", "cream"),
    ("Máscara Hidratante", "mask"), ("Óleo Capilar", "oil_serum"), ("Escova", None)])
def test_product_type(one, name, want):
    assert one({"x": name}, C.product_type("x")) == want


def test_category(one):
    assert one({"x": "Shampoo Matizador"}, C.category(F.lit("shampoo"), F.col("x"))) == "coloracao"
    assert one({"x": "Shampoo"}, C.category(F.lit("shampoo"), F.col("x"))) == "shampoo"
    assert one({"x": "Algo"}, C.category(F.lit(None).cast("string"), F.col("x"))) is None


@pytest.mark.parametrize("name, url, desc, relevant, reason", [
    ("Batom Matte", "https://a.com/x", "cabelo", False, "non_hair:batom"),
    ("Shampoo Suave", "https://a.com/corpo/x", "", True, "hair_keyword:shampoo"),
    ("Creme para Pentear", "https://a.com/x", "", True, "hair_keyword:creme para pentear"),
    ("Produto X", "https://a.com/x", "para o corpo", False, "non_hair_url:corpo"),
    ("Produto X", "https://a.com/cabelos/x", "", True, "hair_keyword_url:cabelo"),
    ("Produto X", "https://a.com/x", "", False, "no_hair_keyword")])
def test_domain_relevance(one, name, url, desc, relevant, reason):
    v = one({"n": name, "u": url, "d": desc}, C.domain_relevance("n", "u", "d"))
    assert (v["relevant"], v["reason"]) == (relevant, reason)


@pytest.mark.parametrize("url, pattern, want", [
    ("https://a.com/kit-cachos", None, "kit"), ("https://a.com/corpo/x", None, "non_hair"), ("https://a.com/blog/dicas", None, "other"),
    ("https://a.com/products/shampoo-bom", None, "product"), ("https://a.com/products/", None, "category"),
    ("https://a.com/busca?cgid=1", None, "category"), ("https://a.com/linha/x-300ml", None, "product"),
    ("https://a.com/linha/x-300ml", r"/produto/", "other"), ("https://a.com/produto/x", r"/produto/", "product"),
    ("https://a.com/x", None, "other")])
def test_url_type(one, url, pattern, want):
    p = None if pattern is None else F.lit(pattern)
    assert one({"x": url}, C.url_type("x", p)) == want


@pytest.mark.parametrize("name, score, valid", [
    ("Shampoo Hidratante 300ml", 90, True), ("Kit Cachos Perfeitos", 80, True), ("Máscara Nutritiva Intensa", 70, True),
    ("oral care", 0, False), ("Descubra a linha", 0, False), ("", 0, False), ("Shampoo ou liso?", 5, False)])
def test_name_quality(one, name, score, valid):
    v = one({"x": name}, C.name_quality("x"))
    assert v["valid"] is valid
    if name not in ("Shampoo ou liso?", "Descubra a linha", "oral care"):
        assert v["score"] == score


@pytest.mark.parametrize("name, want", [
    ("404", "name_garbage"), ("Página não encontrada", "name_garbage"), ("#Antiqueda", "name_editorial_or_invalid"),
    ("6 dicas para cachos", "name_editorial_or_invalid"), ("Shampoos Hidratantes", "name_editorial_or_invalid"), ("Shampoo Hidratante", None)])
def test_garbage_name(one, name, want):
    assert one({"x": name}, C.garbage_name("x")) == want


def test_tab_noise(one):
    assert one({"x": "MAIS INFORMAÇÕES"}, C.tab_noise("x")) is True
    assert one({"x": "Detalhes Como usar Composição"}, C.tab_noise("x")) is True
    assert one({"x": "Aplique nos fios"}, C.tab_noise("x")) is False


def test_list_or_composition(one):
    real = "Aqua, Sodium Laureth Sulfate, Glycerin, Parfum"
    prose = "Queratina hidrolisada, óleo de argan, pantenol"
    assert one({"x": real}, C.list_or_composition(F.lit("composition"), "x")) == "ingredients_inci"
    assert one({"x": prose}, C.list_or_composition(F.lit("composition"), "x")) == "composition"
    assert one({"x": "curto"}, C.list_or_composition(F.lit("ingredients_inci"), "x")) == "composition"


def test_infer_seals(one):
    assert one({"x": ["Aqua", "Decyl Glucoside"]}, C.infer_seals("x")) == [
        "silicone_free", "sulfate_free", "paraben_free", "petrolatum_free", "dye_free", "low_poo"]
    assert one({"x": ["Dimethicone", "CI 19140"]}, C.infer_seals("x")) == ["sulfate_free", "paraben_free", "petrolatum_free", "low_poo"]


def test_detect_seals(spark):
    df = spark.createDataFrame([(1, "Fórmula vegana e sem sulfatos", "Shampoo"), (2, "nada", "Shampoo Vegano"), (3, "veganoso", "x")], "id INT, description STRING, name STRING")
    got = {(r["id"], r["seal"], r["keyword"], r["field"]) for r in C.detect_seals(df, "id", ["description", "name"]).collect()}
    assert got == {(1, "sulfate_free", "sem sulfatos", "description"), (1, "vegan", "vegana", "description"), (2, "vegan", "vegano", "name")}


def test_allergens(one):
    a = one({"x": ["Linalool", "Alcohol Denat.", "Cetyl Alcohol", "LINALOOL", "DMDM Hydantoin"]}, C.allergens("x"))
    assert [(h["ingredient"], h["severity"]) for h in a] == [("DMDM Hydantoin", "high"), ("Alcohol Denat.", "caution"), ("Linalool", "info")]


def test_routine_role(one):
    r = one({"x": ["Sodium Laureth Sulfate", "Dimethicone"]}, C.routine_role("x", F.lit("limpar")))
    assert (r["step"], r["cleansing"], r["insoluble_silicone"], r["drying_alcohol"]) == ("lavar", "intensa", True, False)


@pytest.mark.parametrize("text, ctx, want", [
    ("Estou com queda e coceira", False, "saude_couro"), ("Esse produto serve?", False, "analise_produto"), ("oi", True, "analise_produto"),
    ("Me indica um shampoo", False, "recomendacao"), ("Qual cronograma seguir", False, "rotina_cuidado"), ("", False, "geral"), ("bom dia", False, "geral")])
def test_intent(one, text, ctx, want):
    assert one({"x": text}, C.intent("x", ctx)) == want


def test_hair_types_and_age(one):
    v = one({"n": "Shampoo para cachos", "d": "cabelos danificados"}, C.hair_types("n", "d"))
    assert v["types"] == ["cacheado", "danificado"] and v["confidence"] == pytest.approx(0.65)
    assert one({"n": "Shampoo Kids", "d": ""}, C.audience_age("n", "d"))["age"] == "kids"
    assert one({"n": "Estilo", "d": ""}, C.hair_types("n", "d"))["types"] == []
    f = one({"n": "Gel", "d": ""}, C.function_objective("n", F.lit("condicionador"), "d"))
    assert (f["function"], f["confidence"]) == ("condicionar", 0.9)


def test_ingredient_category(spark):
    df = spark.createDataFrame([("Aqua",), ("Parfum",), ("CI 77891",), ("Dimethicone",), ("Xyz",)], "n STRING")
    got = {r["n"]: r["ingredient_category"] for r in C.ingredient_category(df, "n").collect()}
    assert got == {"Aqua": "solvent", "Parfum": "fragrance", "CI 77891": "colorant", "Dimethicone": "silicone_insoluble", "Xyz": None}


def test_brand_tier_order(spark):
    rows = [("blocked", True, 200, 5000, False, "vtex", True, "yes"), ("active", False, None, None, False, None, False, "yes"),
            ("active", True, 403, 5000, True, "vtex", True, "yes"), ("active", True, 200, 5000, False, "vtex", True, "no"),
            ("active", True, 200, 5000, False, "vtex", True, "yes"), ("active", True, 200, 5000, False, "own", True, "yes")]
    df = spark.createDataFrame(rows, "s STRING, site BOOLEAN, code INT, len INT, b BOOLEAN, p STRING, m BOOLEAN, f STRING")
    c = F.col
    got = [r["t"] for r in df.select(C.brand_tier(c("s"), c("site"), c("code"), c("len"), c("b"), c("p"), c("m"), c("f")).alias("t")).collect()]
    assert got == ["tier_skip", "tier_4_no_site", "tier_5_waf", "tier_2_check", "tier_1_easy", "tier_3_custom"]


def test_full_vocabularies(spark):
    """Entries that a shortened list would miss."""
    names = {"linalool": "fragrance_allergen", "Silica": "absorbent", "Behentrimonium Methosulfate": "surfactant_cationic", "isopropyl myristate": "emollient_synthetic",
             "Ácido Salicílico": "exfoliant", "parabenol": None, "caprylic/capric triglyceride": "emulsifier"}
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["ingredient_category"] for r in C.ingredient_category(rows, "name").collect()}
    assert got == names
    foreign = spark.createDataFrame([("Ice Mist fios",), ("Quem disse, berenice cabelo",), ("Shampoo para cabelo",)], "name string")
    v = C.domain_relevance("name", F.lit(None).cast("string"), None)
    assert [r["ok"] for r in foreign.select(v["relevant"].alias("ok")).collect()] == [False, False, True]


def test_all_seal_words_at_once_equal_word_by_word_search(spark):
    """Overlapping words, words that begin with others, and accents."""
    seals = [("a", ["sem sal", "sal"]), ("b", ["sem sal adicionado", "adicionado zero"]), ("c", ["vegano", "cruelty-free"]), ("d", ["free", "zero %"])]
    texts = ["Shampoo sem sal adicionado zero.", "SEM SAL", "salgado", "100% vegano, cruelty-free", "veganos free", "zero %", "", None, "sem sal sem sal adicionado", "açúcar zero % free"]
    df = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, texts[::-1]))], "id INT, x STRING, y STRING")
    got = {(r.id, r.seal): (r.keyword, r.field) for r in C.detect_seals(df, "id", ["x", "y"], seals).collect()}
    want = {}
    for i, pair in enumerate(zip(texts, texts[::-1])):
        for seal, words in seals:
            for f, t in zip("xy", pair):
                low = "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if unicodedata.category(c) != "Mn")
                for w in words:
                    if re.search(rf"(?<![0-9a-z_]){re.escape(w)}(?![0-9a-z_])", low):
                        want.setdefault((i, seal), (w, f))
    assert got == want
    assert C.detect_seals(df.limit(0), "id", ["x"], seals).collect() == [] and C.detect_seals(df, "id", ["x"], [("e", [])]).collect() == []


def test_trie_pattern_matches_what_its_words_match():
    words = ["a", "ab", "abc", "b.c", "x y", "(q)", "abd", "zz"]
    pattern = re.compile(T.trie_pattern(words))
    for s in ["abc", "abd", "ab", "a", "b.c", "bxc", "x y", "(q)", "z", "zz", "q"]:
        assert bool(pattern.fullmatch(s)) == (s in words), s
        assert bool(pattern.search("_" + s + "_")) == any(w in s for w in words)


def test_junk_exceptions_are_an_argument(spark):
    d = spark.createDataFrame([("Carrinho de compras",), ("Carrinho auxiliar preto",)], "n STRING")
    assert [r[0] for r in d.select(C.junk_name("n")).collect()] == [True, False]
    assert [r[0] for r in d.select(C.junk_name("n", list(C.JUNK_LIKE))).collect()] == [True, False]
    assert [r[0] for r in d.select(C.junk_name("n", except_likes=[])).collect()] == [False, False]


def test_only_listed_spellings_place_a_product(one):
    def relevant(name):
        return one({"x": name}, C.domain_relevance("x", F.lit(""), None)["relevant"])

    assert [relevant(n) for n in ("reparação intensa", "reparacao intensa", "mascara capilar", "tônico capilar", "umectacao")] == [True, False, True, True, True]
    assert one({"x": "po descolorante"}, C.product_type("x")) == "descolorante" and one({"x": "Fluido leve"}, C.product_type("x")) == "finisher"
