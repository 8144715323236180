"""Merge properties and window operators under a hot key."""
import datetime as dt
import random

from pyspark.sql import functions as F

from shelfgrade.operators import merges as J
from shelfgrade.operators import resolve as E
from shelfgrade.operators import windows as W
from shelfgrade.plans import scoring as Q

SNAP = "product_url STRING, product_id STRING, product_name STRING, description STRING, inci_ingredients ARRAY<STRING>, verification_status STRING, price DOUBLE"


def test_never_downgrade(spark):
    old = spark.createDataFrame([
        ("u1", "1", "A", "uma boa descrição", ["x"], "verified_inci", 1.0), ("u2", "2", "B", "Como usar", ["x"], "catalog_only", None),
        ("u4", "4", "D", "antiga", None, "catalog_only", 5.0)], SNAP)
    new = spark.createDataFrame([
        ("u1", "9", "", "detalhes", None, "quarantined", None), ("u2", "8", "B2", None, None, "catalog_only", 0.0), ("u3", "3", "C", "nova", ["y"], "verified_inci", 2.0)], SNAP)
    lists = ["inci_ingredients", "verification_status"]
    got = {r["product_url"]: tuple(r)[1:] for r in J.merge_never_downgrade(old, new, lists=lists).collect()}
    assert got["u1"] == ("1", "A", "uma boa descrição", ["x"], "verified_inci", 1.0)
    assert got["u2"] == ("2", "B2", None, None, "catalog_only", 0.0)
    assert got["u3"] == ("3", "C", "nova", ["y"], "verified_inci", 2.0) and got["u4"][3] is None
    again = J.merge_never_downgrade(J.merge_never_downgrade(old, new, lists=lists), new, lists=lists)
    assert {r["product_url"]: tuple(r)[1:] for r in again.collect()} == got


def test_insert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    b = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k INT, v STRING")
    once = J.insert_if_absent(t, b, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c")] == sorted(map(tuple, J.insert_if_absent(once, b, ["k"]).collect()))


def test_merge_ingredients_is_idempotent(spark):
    e = spark.createDataFrame([("1", "Água", 1), ("2", "Aqua", 5), ("3", "Glicerina", 9), ("4", "Xis", 0), ("5", "XIS", 2)], "ingredient_id STRING, canonical_name STRING, usage INT")
    b = spark.createDataFrame([(1, "1", 1), (1, "2", 2), (1, "5", 3)], "product_id INT, ingredient_id STRING, position INT")
    mapping, moved, aliases = J.merge_ingredients(e, b, "usage")
    assert dict(map(tuple, mapping.collect())) == {"1": "2", "2": "2", "3": "3", "4": "5", "5": "5"}
    assert sorted(map(tuple, moved.collect())) == [(1, "2", 1), (1, "5", 3)] and aliases.count() == 2


def test_hot_key_ranks_and_sums(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(1, 5)}", i, rng.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k STRING, i INT, v INT").repartition(4)
    want, total, n = {}, {}, {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        want[i] = (n.get(k, 0), total[k])
        n[k] = n.get(k, 0) + 1
    ranks = {r["i"]: r["idx"] for r in W.numbered(df, "k", [F.col("i")], F.floor(F.col("i") / 100)).collect()}
    sums = {r["i"]: r["s"] for r in W.running_sum(df, ["k"], [F.col("i")], F.floor(F.col("i") / 100), F.col("v"), "s").collect()}
    assert ranks == {i: w[0] for i, w in want.items()} and sums == {i: w[1] for i, w in want.items()}


def test_trailing_count_is_closed_on_both_sides(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 59, 60, 61, 120, 500)]
    df = spark.createDataFrame(rows, "u STRING, ts TIMESTAMP")
    got = [r["in_window"] for r in W.trailing_count(df, ["u"], "ts", 60).orderBy("ts").collect()]
    assert got == [1, 2, 3, 3, 3, 1]


def test_stop_the_line_cuts_after_the_tripping_row(spark):
    flags = [True, True, False, True, True, False, True]
    df = spark.createDataFrame([("b", i + 1, f) for i, f in enumerate(flags)] + [("c", i + 1, False) for i in range(7)], "b STRING, n INT, f BOOLEAN")
    out = W.stop_the_line(df, "b", "n", F.col("f"), chunk_rows=2)
    assert sorted(r["n"] for r in out.filter("b = 'b'").collect()) == [1, 2, 3, 4, 5] and out.filter("b = 'c'").count() == 7


def test_brand_sheets(spark):
    nat = spark.createDataFrame([("Alfa", "https://alfa.com", "sim")], "brand_name STRING, site STRING, has_list STRING")
    intl = spark.createDataFrame([("Alfa", "FR", "x"), ("Beta", "FR", "https://beta.fr")], "brand_name STRING, country STRING, site STRING")
    main = spark.createDataFrame([(1, "Gama", "https://gama.com", None, "n"), (2, None, None, "https://gama.com/a", None), (3, "Alfa", None, "http://alfa.com/b", None)],
                                 "row_no INT, brand_name STRING, site STRING, entry STRING, notes STRING")
    brands, entries = E.merge_brand_sheets(nat, intl, main, chunk_rows=1)
    got = {r["brand_slug"]: (r["country"], r["priority"], r["official_url_root"], r["notes"]) for r in brands.collect()}
    assert got == {"alfa": ("Brasil", 2, "https://alfa.com", "inci_on_site=sim"), "beta": ("FR", None, "https://beta.fr", None), "gama": (None, 1, "https://gama.com", "n")}
    assert sorted(map(tuple, entries.collect())) == [("alfa", "http://alfa.com/b"), ("gama", "https://gama.com"), ("gama", "https://gama.com/a")]


def test_scoring_by_hand(spark):
    e = spark.createDataFrame([("p", 0, 2, "A", "good"), ("p", 1, 2, "B", "bad")], "product_id STRING, idx INT, n BIGINT, name STRING, category STRING")
    o = spark.createDataFrame([("p", "u", ["t"])], "product_id STRING, profile_id STRING, hair_types ARRAY<STRING>")
    r = spark.createDataFrame([("good", "t", 1), ("bad", "t", -1)], "category STRING, hair_type STRING, score INT")
    s = Q.score_lists(e, o, r).first()
    assert abs(s["overall"] - (1.0 - 0.6) / 1.6) < 1e-6 and (s["alerts"], s["benefits"], s["coverage_pct"]) == (1, 1, 100.0)


def test_fill_down_across_chunks(spark):
    df = spark.createDataFrame([(i, "h" if i == 1 else None) for i in range(10)], "n INT, v STRING")
    got = {r["n"]: r["v"] for r in W.fill_down(df, "n", "v", F.floor(F.col("n") / 3)).collect()}
    assert got[0] is None and all(got[i] == "h" for i in range(1, 10))
