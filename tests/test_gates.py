"""One row per outcome of the two gates."""
import pytest
from pyspark.sql import functions as F

from shelfgrade.operators import validate as V

LIST = ["Aqua", "Cetearyl Alcohol", "Glycerin", "Parfum", "Citric Acid", "Sodium Chloride"]
USE = "Aplique nos cabelos úmidos e enxágue bem."
DESC = "Shampoo para cabelos secos que limpa com suavidade todos os dias."
OK = dict(name="Shampoo Hidratante 300ml", items=LIST, description=DESC, usage=USE, image="https://a.com/x.jpg", category="shampoo",
          status="verified_inci", hidden=False, reason="hair_keyword:shampoo", kit=False, ratio=0.9, grounded=True)
SCHEMA = ("name STRING, items ARRAY<STRING>, description STRING, usage STRING, image STRING, category STRING, status STRING, "
          "hidden BOOLEAN, reason STRING, kit BOOLEAN, ratio DOUBLE, grounded BOOLEAN")


def gold(spark, **change):
    row = {**OK, **change}
    c = F.col
    g = V.gold_gate(c("name"), c("items"), c("description"), c("usage"), c("image"), c("category"), c("status"), c("hidden"), c("reason"),
                    c("kit"), c("ratio"), c("grounded"))
    v = spark.createDataFrame([tuple(row.values())], SCHEMA).select(g.alias("v")).first()["v"]
    return v["gold_status"], [b["code"] for b in v["blockers"]]


@pytest.mark.parametrize("change, status, codes", [
    ({}, "gold", []), ({"usage": None}, "catalog", ["usage_missing"]), ({"usage": "Como usar"}, "catalog", ["usage_not_instructions"]),
    ({"reason": "non_hair:batom"}, "raw", ["non_hair"]), ({"status": "quarantined"}, "raw", ["quarantined"]), ({"hidden": True}, "raw", ["hidden"]),
    ({"grounded": False}, "gold_candidate", ["inci_llm_only"]), ({"ratio": 0.5}, "gold_candidate", ["inci_low_known_ratio"]),
    ({"ratio": 0.6}, "gold", []), ({"ratio": 0.3}, "gold_candidate", ["inci_low_known_ratio"]), ({"ratio": 0.29}, "catalog", ["inci_garbage"]),
    ({"items": ["Sem amônia", "Efeito natural", "Brilho intenso", "Maciez total", "Cor vibrante"]}, "catalog", ["inci_is_marketing"]),
    ({"items": LIST + ["902xdeR$29", "90sem jurosTotalR$43", "Pix5% de desconto"]}, "catalog", ["inci_pricing_garbage"]),
    ({"items": LIST[:3]}, "catalog", ["inci_invalid:min_ingredients: only 3 valid terms"]), ({"items": []}, "catalog", ["inci_missing"]),
    ({"category": "other"}, "catalog", ["category_invalid"]), ({"description": "curta"}, "catalog", ["desc_missing"]),
    ({"kit": True}, "catalog", ["is_kit"]), ({"image": "x.jpg"}, "catalog", ["image_missing"]), ({"name": "oral care"}, "raw", ["name_low_quality"])])
def test_gold_gate(spark, change, status, codes):
    assert gold(spark, **change) == (status, codes)


QA = "name STRING, url STRING, image STRING, reason STRING, items ARRAY<STRING>, composition STRING, confidence DOUBLE"
QROW = ("Shampoo Hidratante 300ml", "https://shop.a.com/x", "i.jpg", "hair_keyword:shampoo", LIST, None, 0.9)


@pytest.mark.parametrize("pos, value, status, failed", [
    (0, QROW[0], "verified_inci", []), (3, "blocked:waf_challenge", "quarantined", ["waf_challenge"]), (0, "Página não encontrada", "quarantined", ["name_garbage"]),
    (1, "https://b.com/x", "quarantined", ["domain_unofficial"]), (2, None, "quarantined", ["no_image"]), (3, "no_hair_keyword", "quarantined", ["no_hair_keyword"]),
    (3, "non_hair:corpo", "quarantined", ["non_hair:corpo"]), (3, None, "quarantined", ["no_hair_relevance"]), (4, None, "catalog_only", []),
    (4, LIST[:2], "quarantined", ["inci_invalid:min_ingredients: only 2 valid terms"]), (6, 0.79, "quarantined", ["low_confidence"])])
def test_qa_gate(spark, pos, value, status, failed):
    row = list(QROW)
    row[pos] = value
    c = F.col
    g = V.qa_gate(c("name"), c("url"), c("image"), c("reason"), c("items"), c("composition"), c("confidence"), ["a.com"])
    v = spark.createDataFrame([tuple(row)], QA).select(g.alias("v")).first()["v"]
    assert (v["status"], v["failed"]) == (status, failed)


def test_human_rejection_stays(spark):
    df = spark.createDataFrame([("gold_rejected",), ("raw",)], "gold_status STRING")
    ev = F.struct(F.lit("gold").alias("gold_status"), F.array(F.lit("x")).alias("blockers"))
    assert [r["gold_status"] for r in V.apply_gold(df, ev).collect()] == ["gold_rejected", "gold"]


def test_confidence_score(spark):
    v = spark.range(1).select(V.confidence_score([F.lit(True)] * 3 + [F.lit(False)] * 3, F.lit(True), F.lit(1), F.lit(2), F.lit("aprovado")).alias("v")).first()["v"]
    assert v["score"] == 62.5
