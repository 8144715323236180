"""Goldens of the scalar and list functions, worked out by hand from the rules."""
import pytest
from pyspark.sql import functions as F

from shelfgrade.functions import lists as L
from shelfgrade.functions import text as T
from shelfgrade.functions import udf
from shelfgrade.functions import urls as U
from shelfgrade.plans.scoring import interpret, position_weight


@pytest.mark.parametrize("raw, want", [
    ("  Água Oxigenada ", "agua oxigenada"), ("CORAÇÃO", "coracao"), ("plain", "plain"), ("é", "e")])
def test_fold(one, raw, want):
    assert one({"x": raw}, T.fold("x")) == want
    assert one({"x": raw}, udf.fold_nfd("x")) == want


@pytest.mark.parametrize("raw, brand, want", [
    ("Shampoo BIO EXTRATUS Queratina 250ml", "bio-extratus", "shampoo queratina"),
    ("Máscara BioExtratus 1,5 L", "bio-extratus", "mascara"),
    ("Kit com 3 Ampolas - un", None, "kit ampolas"), ("Gel a+b 100 g", "a+b", "gel")])
def test_norm_name(one, raw, brand, want):
    expr = T.norm_name("x") if brand is None else T.norm_name("x", F.lit(brand))
    assert one({"x": raw}, expr) == want


@pytest.mark.parametrize("raw, want", [("300ml", 300.0), ("1,5 L", 1500.0), ("2 oz", 60.0), ("0.5kg x 2", 500.0), ("nada", None)])
def test_volume_units(one, raw, want):
    assert one({"x": raw}, T.volume_units("x")) == want


@pytest.mark.parametrize("raw, want", [("por R$ 1.234,56", 1234.56), ("R$100,00", 100.0), ("R$ 10", None)])
def test_parse_brl(one, raw, want):
    assert one({"x": raw}, T.parse_brl("x")) == want


@pytest.mark.parametrize("raw, want", [
    ("https://a.com/p?utm_source=x&color=red&page=2#f", "https://a.com/p?color=red"), ("https://a.com/p?x=", "https://a.com/p"),
    ("/p/1", None), ("http://a.com", "http://a.com")])
def test_canonical_url(one, raw, want):
    assert one({"x": raw}, U.canonical_url("x")) == want


def test_host_allowed(one):
    assert one({"x": "https://shop.a.com:80/x"}, U.host_allowed("x", ["a.com"])) is True
    assert one({"x": "https://evila.com/x"}, U.host_allowed("x", ["a.com"])) is False


@pytest.mark.parametrize("raw, want", [
    ("Aqua, Glycerin\nAlcohol, aqua", ["Aqua", "Glycerin Alcohol"]), ("A; B; C, D", ["A", "B", "C, D"]),
    ("A●B•C", ["A", "B", "C"]), ("a/b/c/d/e/f/g", ["a", "b", "c", "d", "e", "f", "g"]), ("a/b", ["a/b"]), ("x\ny", ["x", "y"])])
def test_split_list(one, raw, want):
    assert one({"x": raw}, L.split_list("x")) == want


@pytest.mark.parametrize("raw, want", [
    ("Aqua (água purificada), X", "Aqua, X"), ("Dye (CI 77891 red)", "Dye (CI 77891 red)"), ("A (and) B", "A (and) B"),
    ("T (vitamin e acetate)", "T (vitamin e acetate)")])
def test_strip_translations(one, raw, want):
    assert one({"x": raw}, L.strip_translations("x")) == want


def test_cut_markers(one):
    assert one({"x": "Aqua, Parfum. Modo de Uso: aplique. SAC: 1"}, L.cut_markers("x")) == "Aqua, Parfum."
    assert one({"x": "Aqua ver mais, Parfum"}, L.cut_markers("x")) == "Aqua , Parfum"


LIST = ["Aqua", "Glycerin", "Parfum", "Citric Acid", "Sodium Chloride"]


@pytest.mark.parametrize("items, context, valid, cleaned, reason", [
    (LIST, False, True, LIST, ""), (LIST + ["aqua"], False, False, [], "concat_detected"),
    (LIST[:4], False, False, LIST[:4], "min_ingredients: only 4 valid terms"), (LIST[:3], True, True, LIST[:3], ""),
    (LIST[1:4] * 2, False, False, [], "repetition_detected"), (["shampoo: x"] + LIST, False, False, [], "concat_detected"),
    (LIST + ["aplique nos fios", "http://x.y", "a"], False, True, LIST, ""), (LIST + ["GLYCERIN"], False, True, LIST, "")])
def test_validate_list(one, items, context, valid, cleaned, reason):
    v = one({"x": items}, L.validate_list("x", context))
    assert (v["valid"], v["cleaned"], v["reason"]) == (valid, cleaned, reason)


def test_removed_entries_in_order(one):
    v = one({"x": LIST + ["PARFUM", "aplique nos fios"]}, L.validate_list("x"))
    assert v["removed"] == ["PARFUM", "aplique nos fios"]


def test_extract_and_validate(one):
    v = one({"x": "Aqua (água pura), Glycerin, Parfum, Citric Acid, Sodium Chloride. Modo de uso: aplique"}, L.extract_and_validate("x"))
    assert v["valid"] and v["cleaned"][0] == "Aqua" and len(v["cleaned"]) == 5
    assert one({"x": "  "}, L.extract_and_validate("x"))["reason"] == "no_inci_text"
    assert one({"x": "Modo de uso: x"}, L.extract_and_validate("x"))["reason"] == "empty_after_cleaning"


def test_split_bullets(one):
    assert one({"x": "Brilho intenso; curto; Maciez duradoura"}, L.split_bullets("x")) == ["Brilho intenso", "Maciez duradoura"]
    assert one({"x": "curto"}, L.split_bullets("x")) == ["curto"]


def test_json_and_dates(one):
    assert one({"x": 'ok ```{"a": 1}```'}, T.json_from_text("x")) == '{"a": 1}'
    assert one({"x": "no {broken"}, T.json_from_text("x")) is None
    assert one({"x": '["a","b"]'}, T.decode_json_list("x")) == ["a", "b"]
    assert one({"x": "[broken"}, T.decode_json_list("x")) == []
    assert one({"x": '{"a":1}'}, T.decode_json_list("x")) == []
    assert one({"x": "not a date"}, T.parse_iso("x")) is None
    assert one({"x": "&ccedil;a &amp;lt; <b>x</b>"}, T.clean_text("x")) == "ça &lt; x"


@pytest.mark.parametrize("score, start", [(0.6, "Altamente"), (0.2, "Compatível"), (-0.2, "Neutro"), (-0.6, "Cuidado"), (-0.61, "Não")])
def test_interpret_edges(one, score, start):
    assert one({"x": score}, interpret(F.col("x"))).startswith(start)


def test_position_weight(one):
    assert one({"x": 0.0}, position_weight(F.lit(0), F.lit(10))) == 1.0
    assert one({"x": 0.0}, position_weight(F.lit(10), F.lit(10))) == pytest.approx(0.2)
