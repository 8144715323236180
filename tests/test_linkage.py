"""The candidate keys lose no pair: brute force over small fixtures."""
import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from shelfgrade.functions import similarity as S
from shelfgrade.functions import text as T
from shelfgrade.functions.similarity import sequence_ratio
from shelfgrade.operators import linkage as K

WORDS = ["shampoo", "mascara", "gel", "oil", "hidra", "nutri", "cachos", "kit", "a", "be", "sos", "liss", "reparador", "intenso", "bio"]


def ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    s = SequenceMatcher(None, a, b).ratio()
    return max(s, SequenceMatcher(None, " ".join(sorted(a.split())), " ".join(sorted(b.split()))).ratio())


def brute(left, right, threshold):
    return {(a, b) for a in left for b in right if ratio(a, b) >= threshold}


def found(spark, left, right, threshold):
    def frame(names):
        d = spark.createDataFrame([("x", n) for n in names], "block STRING, name STRING")
        return d.select("block", F.xxhash64("name").alias("ident"), K.name_forms(F.col("name"), None).alias("forms"), "name")

    lf, rf = frame(left), frame(right)
    hits = K.similar_names(lf.drop("name"), rf.drop("name"), "block", threshold)
    named = hits.join(lf.select(F.col("ident").alias("left_id"), F.col("name").alias("a")), "left_id").join(
        rf.select(F.col("ident").alias("right_id"), F.col("name").alias("b")), "right_id")
    return {(r["a"], r["b"]) for r in named.select("a", "b").collect()}


@pytest.mark.parametrize("seed, threshold", [(1, 0.75), (2, 0.75), (3, 0.9), (4, 0.8)])
def test_same_pairs_as_brute_force(spark, seed, threshold):
    rng = random.Random(seed)

    def name():
        base = " ".join(rng.sample(WORDS, rng.randint(1, 4)))
        return "".join(c for c in base if rng.random() > 0.06).strip() or "x"

    left, right = sorted({name() for _ in range(150)}), sorted({name() for _ in range(150)})
    want = brute([" ".join(x.split()) for x in left], [" ".join(x.split()) for x in right], threshold)
    got = {(" ".join(a.split()), " ".join(b.split())) for a, b in found(spark, left, right, threshold)}
    assert want and got == want


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abc ", min_size=1, max_size=30), st.text("abc ", min_size=1, max_size=30))
def test_bigram_bound(a, b):
    """Shared bigrams are at least 3M - S - 1, the fact the keys rest on."""
    m = sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks())
    ga, gb = ([s[i:i + 2] for i in range(len(s) - 1)] for s in (a, b))
    shared = sum(min(ga.count(g), gb.count(g)) for g in set(ga))
    assert shared >= 3 * m - (len(a) + len(b)) - 1


def test_low_thresholds_are_refused(spark):
    d = spark.createDataFrame([("x", 1, ["a"])], "block STRING, ident BIGINT, forms ARRAY<STRING>")
    with pytest.raises(ValueError):
        K.similar_names(d, d, "block", 0.7)


def test_sequence_ratio(spark):
    d = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a STRING, b STRING").select(sequence_ratio("a", "b").alias("r"))
    assert [r["r"] for r in d.collect()] == [0.75, None]


@pytest.mark.parametrize("threshold", [0.75, 0.8, 0.9])
def test_pieces_find_what_brute_force_finds(spark, threshold, monkeypatch):
    """Without keys: short, long and wide alphabets, repeated words, names of no characters, blocks of several pieces, and blocks apart."""
    monkeypatch.setattr(K, "PIECE", 16)
    rng = random.Random(8)

    def name(k):
        base = " ".join(rng.choices(WORDS if k % 3 else WORDS[:4], k=rng.choice([1, 3, 6, 14])))
        if k % 7 == 0:
            base = "".join(chr(0x4E00 + rng.randrange(700)) for _ in range(rng.choice([3, 50, 90])))
        return "".join(rng.choice("xyzé") if rng.random() < 0.03 else c for c in base if rng.random() > 0.05) or "x"

    base = [name(k) for k in range(60)]
    names = sorted({*base, *["".join(c for c in x if rng.random() > 0.08) for x in base], *[" ".join(reversed(x.split())) for x in base[:20]], ""})
    left, right = [(b, i, x) for i, x in enumerate(names[::2]) for b in ("p", "q")], [("p", 1000 + i, x) for i, x in enumerate(names[1::2] + names[:60:6])]
    frame = lambda rows: spark.createDataFrame([(b, i, [x, " ".join(sorted(x.split()))] * 2) for b, i, x in rows] + [(None, 5, ["x", "x"] * 2)], "brand STRING, ident INT, forms ARRAY<STRING>")
    hits = K.similar_names(frame(left), frame(right), "brand", threshold, keyed=False)
    assert hits.columns == ["brand", "left_id", "right_id", "ratio"]
    got = [(r["brand"], r["left_id"], r["right_id"], round(r["ratio"], 9)) for r in hits.collect()]
    want = {("p", i, j, round(ratio(a, b), 9)) for b_, i, a in left if b_ == "p" for _, j, b in right if ratio(a, b) >= threshold}
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_openings_need_no_keys(spark):
    """Names of 40 characters have hundreds of keys; the query meets them in pieces, with the same pairs."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["similar_documents_by_title"](spark, sf)
    assert "sort_array(collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("source AS block", "lower(left(regexp_replace(text, '\\\\s+', ' '), 40)) AS s").filter("s is not null").distinct()
    rows = [(r["block"], r["ident"], r["s"]) for r in d.withColumn("ident", F.xxhash64("s")).collect()]
    want = {(b, i, j) for b, i, x in rows for c, j, y in rows if b == c and i < j and ratio(x, y) >= 0.8}
    assert {(r["block"], r["left_id"], r["right_id"]) for r in got.collect()} == want


def test_names_among_themselves_meet_once(spark, monkeypatch):
    """without a second table each two pieces meet once; the ratio is the one with the smaller ident on the left, which differs from the other way round."""
    monkeypatch.setattr(K, "PIECE", 8)
    rng = random.Random(2)
    base = [" ".join("".join(rng.choice("abcd") for _ in range(rng.choice([2, 5]))) for _ in range(rng.choice([2, 6]))) for _ in range(40)]
    names = sorted({*base, *["".join(c for c in x if rng.random() > 0.12) for x in base * 2], "x" * 70, "x" * 69 + "y", "", " "})
    keys = rng.sample(range(-500, 500), len(names))
    rows = [(b, k, [x, " ".join(sorted(x.split()))] * 2) for k, x in zip(keys, names) for b in ("p", "q")] + [(None, 5, ["x", "x"] * 2), ("p", None, ["x", "x"] * 2)]
    d = spark.createDataFrame(rows, "brand STRING, ident BIGINT, forms ARRAY<STRING>")
    both = list(zip(keys, names))
    want = {(b, i, j, ratio(x, y)) for i, x in both for j, y in both if i < j and ratio(x, y) >= 0.75 for b in ("p", "q")}
    assert any(ratio(x, y) != ratio(y, x) for x in names for y in names)
    for keyed in (False, True):
        hits = K.similar_names(d, None, "brand", 0.75, keyed=keyed)
        assert hits.columns == ["brand", "left_id", "right_id", "ratio"]
        got = [tuple(r) for r in hits.collect()]
        assert len(got) > 40 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "".join(chr(0x4E00 + k) for k in range(600))])
def test_short_texts_are_compared_many_at_once(letters, monkeypatch):
    """same ratios as the library's, bit for bit; only texts of more than 64 characters still go through it."""
    rng = random.Random(6)
    left = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 13, 40, 63, 64, 65, 230]))) for _ in range(60)]
    right = ["".join(c for c in x if rng.random() > 0.1) or "a" for x in left] + left[:9]
    want = {(i, j): SequenceMatcher(None, a, b).ratio() for i, a in enumerate(left) for j, b in enumerate(right)}
    longer = []

    def spied(junk, a, b):
        longer.append(max(len(a), len(b)))
        return SequenceMatcher(junk, a, b)

    monkeypatch.setattr(S, "SequenceMatcher", spied)
    sides = [S.Spellings.of([[[x] for x in xs], [[] for _ in xs]]) for xs in (left, right)]
    got = {(i, j): r for rows in S.similar_rows(*sides, 0.75) for i, j, r in zip(*(x.tolist() for x in rows))}
    assert got == {pair: r for pair, r in want.items() if r >= 0.75} and len(got) > 60
    assert not longer or min(longer) > 64


def test_match_rules(spark):
    p = spark.createDataFrame([(1, "b", "Shampoo Hidra Bio 300ml"), (2, "b", "Mascara Hidra Bio 1L"), (3, "b", "Oleo Raro")], "product_id INT, brand_slug STRING, product_name STRING")
    e = spark.createDataFrame([
        (10, "b", "Hidra Bio Shampoo 300 ml", "two"), (11, "b", "shampoo hidra bio", "one"), (12, "b", "Mascara Hidra Bio 500ml", "one")],
        "external_id INT, brand_slug STRING, product_name STRING, source STRING")
    got = {r["product_id"]: (r["external_id"], round(r["score"], 2), r["action"]) for r in K.match_names(p, e, preferred="one").collect()}
    assert got == {1: (11, 1.0, "auto_apply"), 2: (12, 0.89, "review")}


def test_identify(spark):
    q = spark.createDataFrame([
        (1, "b", "789-1", "nada", None), (2, "b", None, "Shampoo Hidra Bio", "300ml"), (3, "b", None, "Shampoo Hidra Bio", "1l"), (4, "b", None, "Zzzz", None),
        (5, None, None, "Hidra Bio Shampoo", None)], "query_id INT, brand_slug STRING, ean STRING, product_name_text STRING, volume_text STRING")
    p = spark.createDataFrame([(100, "b", "Oleo", "7891", None), (101, "b", "Shampoo Hidra Bio", None, "300ml"), (102, "c", "Hidra Bio Shampoo", None, None)],
                              "product_id INT, brand_slug STRING, product_name STRING, ean STRING, size_volume STRING")
    got = {(r["query_id"], r["rank"]): (r["product_id"], r["method"], r["outcome"]) for r in K.identify(q, p).collect()}
    assert got[(1, 1)] == (100, "ean", "match") and got[(2, 1)] == (101, "name_fuzzy", "match")
    assert got[(3, 1)] == (101, "name_fuzzy", "candidates") and got[(4, 1)] == (None, "none", "not_in_base")
    assert {got[(5, 1)][0], got[(5, 2)][0]} == {101, 102}


def realistic(n, seed=3):
    """Names of one brand: kinds of product, lines and care words, as shops combine them."""
    rng = random.Random(seed)
    kinds = ["Shampoo", "Condicionador", "Máscara", "Leave-in", "Óleo Capilar", "Creme de Pentear", "Sérum", "Spray", "Ampola", "Gelatina", "Finalizador", "Tônico"]
    lines = ["Cachos Intensos", "Liso Absoluto", "Força Vital", "Brilho Extremo", "Nutrição Profunda", "Reconstrução Total", "Hidratação Diária", "Cor Protegida", "Loiro Platinado", "Crescimento Saudável",
             "Antiqueda", "Restauração Noturna", "Detox Purificante", "Volume Leve", "Anticaspa", "Pós Química", "Verão Protetor", "Infantil Suave", "Vegano Natural", "Carvão Ativado"]
    extras = ["Argan", "Coco", "Karité", "Abacate", "Queratina", "Colágeno", "Biotina", "Macadâmia", "Rícino", "Babosa", "Chá Verde", "Pantenol", "Mel", "Manga", "Açaí", "Tutano", "Ojon", "Linhaça"]
    out = set()
    while len(out) < n:
        out.add(f"{rng.choice(kinds)} {rng.choice(lines)} {rng.choice(extras)} {rng.choice([*extras, ''])}".strip() + rng.choice(["", " 300ml", " 1L", " 500 g"]))
    return sorted(out)


def test_few_candidates_among_many_alike_names(spark):
    """Names of one brand: what reaches Python is a small share of the pairs (of 2 000 names 0.1 % at 0.90 and 3.4 % at 0.75)."""
    names = realistic(400)
    d = spark.createDataFrame([("x", n) for n in names], "block STRING, name STRING").select("block", K.name_forms(F.col("name"), None).alias("forms"))
    d = d.withColumn("ident", K.name_key(F.col("forms"))).distinct().cache()
    n = d.count()
    shares = {t: K.candidate_names(d, d, "block", t).count() / n**2 for t in (0.90, 0.75)}
    assert shares[0.90] < 0.01 and shares[0.75] < 0.1


def test_tiers_settle_what_brute_force_finds(spark):
    ours, theirs = realistic(60, 1), realistic(60, 2)[:40] + [" ".join(reversed(x.split())) for x in realistic(60, 1)[:15]]
    p = spark.createDataFrame([(i, "b", x) for i, x in enumerate(ours)], "product_id INT, brand_slug STRING, product_name STRING")
    e = spark.createDataFrame([(100 + i, "b", x, "two" if i % 3 else "one") for i, x in enumerate(theirs)], "external_id INT, brand_slug STRING, product_name STRING, source STRING")
    got = {r["product_id"]: (r["external_id"], round(r["score"], 6)) for r in K.match_names(p, e, preferred="one").collect()}
    plain = {x: r["n"] for x, r in zip(ours + theirs, spark.createDataFrame([(i, x) for i, x in enumerate(ours + theirs)], "i INT, x STRING").select("i", T.norm_name("x").alias("n")).orderBy("i").collect())}
    volume = lambda x: next((float(a.replace(",", ".")) * (1000 if u == "L" else 1) for a, u in re.findall(r"(\d+) ?(ml|L|g)\b", x)), 0.0)
    want = {}
    for i, a in enumerate(ours):
        options = []
        for j, b in enumerate(theirs):
            r = ratio(plain[a], plain[b])
            if volume(a) and volume(b) and volume(a) != volume(b):
                r = min(r, 0.89)
            if r >= 0.75:
                options.append((-r, bool(j % 3), 100 + j))
        if options:
            best = min(options)
            want[i] = (best[2], round(-best[0], 6))
    assert len(want) > 15 and got == want


def test_matches_leave_evidence(spark):
    p = spark.createDataFrame([(1, "b", "Shampoo Hidra Bio"), (2, "b", "Mascara Hidra Bio 1L")], "product_id INT, brand_slug STRING, product_name STRING")
    e = spark.createDataFrame([(10, "b", "shampoo hidra bio", "one", "https://o/10", ["Aqua", "Mel"]), (12, "b", "Mascara Hidra Bio 500ml", "one", None, ["Aqua"])],
                              "external_id INT, brand_slug STRING, product_name STRING, source STRING, source_url STRING, inci_ingredients ARRAY<STRING>")
    rows = p.selectExpr("product_id", "CAST(NULL AS ARRAY<STRING>) AS inci_ingredients", "'catalog_only' AS verification_status", "0.1D AS confidence", "'jsonld' AS extraction_method")
    updated, queue, evidence = K.apply_matches(rows, K.match_names(p, e), e, "product_id", "external_id", "inci_ingredients")
    assert {tuple(map(str, r)) for r in updated.collect()} == {("1", "['Aqua', 'Mel']", "verified_inci", "0.85", "external_enrichment"), ("2", "None", "catalog_only", "0.1", "jsonld")}
    assert [tuple(r) for r in evidence.collect()] == [(1, "inci_ingredients", "https://o/10", "external_enrichment:one", "['Aqua', 'Mel']", "external_enrichment")]
    q = queue.collect()
    assert len(q) == 1 and (q[0].product_id, q[0].external_id, round(q[0].score, 2), q[0].match_details.type_match, q[0].match_details.cand_name) == (2, 12, 0.89, True, "Mascara Hidra Bio 500ml")


def test_containment_join(spark):
    t = spark.createDataFrame([("the natura shop",), ("na",), ("zz",)], "t STRING")
    k = spark.createDataFrame([("natura",), ("na",), ("z",), ("shop x",)], "w STRING")
    got = {(r["t"], r["w"]) for r in K.contained_pairs(t, k, "t", "w").collect()}
    assert got == {(a, b) for a in ("the natura shop", "na", "zz") for b in ("natura", "na", "z", "shop x") if b in a}


def test_candidate_pool_lists_every_pair_once(spark):
    q = spark.createDataFrame([(1, None, "78-9", "o gear"), (2, "a", None, "the gear"), (3, "a", "789", "gel")], "query_id INT, brand_slug STRING, ean STRING, product_name_text STRING")
    p = spark.createDataFrame([(1, "a", "789", "Red Gear"), (2, "b", "789", "Gel"), (3, "b", None, "old gear 2"), (4, "c", "5", None)], "product_id INT, brand_slug STRING, ean STRING, product_name STRING")
    got = sorted(map(tuple, K.candidate_pool(q, p, "query_id", "product_id").collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2)]


def test_candidate_pairs_are_dealt_over_tasks(spark, monkeypatch):
    """pairs of one word are queries times products; pieces of them go to many tasks, however few tasks read the tables."""
    monkeypatch.setattr(K, "PIECE", 16)
    brand = "CASE id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN '' END AS brand_slug"
    q = spark.range(0, 300, 1, 1).selectExpr("nullif(id, 7) AS query_id", brand, "CASE WHEN id % 9 = 0 THEN CAST(id AS STRING) END AS ean", "CASE id % 4 WHEN 0 THEN 'gel' WHEN 1 THEN 'Zzzz x' ELSE 'the Gear' END AS product_name_text")
    p = spark.range(0, 400, 1, 1).selectExpr("nullif(id, 12) AS product_id", brand, "CAST(id % 50 AS STRING) AS ean", "CASE WHEN id % 4 > 0 THEN 'Old GEAR ' || id % 3 END AS product_name")
    tasks = K.candidate_pool(q, p, "query_id", "product_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 0.5 * sum(r["count"] for r in tasks)
    got = [tuple(r) for r in K.candidate_pool(q, p, "query_id", "product_id").collect()]
    want = [(a["query_id"], b["product_id"]) for a in q.collect() for b in p.collect() if a["ean"] and a["ean"] == b["ean"] or "Gear" in a["product_name_text"] and b["product_name"] and a["brand_slug"] in (None, b["brand_slug"])]
    assert len(want) > 20_000 and sorted(got, key=repr) == sorted(want, key=repr)
    assert K.candidate_pool(q.filter("product_name_text = 'gel' AND ean IS NULL"), p, "query_id", "product_id").isEmpty()
