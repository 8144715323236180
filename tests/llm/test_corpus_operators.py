"""Near-dedup, mixing, top-k, media, URLs, token counts, the pipeline: edge cases and brute force."""
import io
import math
import os
import re
import wave
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from shelfgrade.llm import knn, media, mixing, near_dedup as nd, sentencepiece_codec as sp, token_counts as tc, url_filter as uf
from shelfgrade.llm.common import components, n_words
from shelfgrade.llm.queries import PIECES, QUERIES, RANKS, RULES

SF = "/root/testdata/sf0.001"


# --- connected components --------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(60)] + [(1, 1), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- near-dedup --------------------------------------------------------------------------------------

def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_rows():
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, at = [], 0
    for length in (40, 60, 90, 150, 300):
        base = list(rng.choice(vocabulary, length))
        for _ in range(24):
            own = list(base)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(0, length))] = str(rng.choice(vocabulary))
            rows.append((at, " ".join(own)))
            at += 1
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, rows[3][1].upper()), (1007, rows[3][1]), (1007, rows[3][1]), (1008, "É x y z"), (1009, "é x y z")]
    rows += [(1100 + i, "the very same text " * 30) for i in range(50)]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("n,num", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, num):
    rows = near_rows()
    sets = [shingle_set(t, n) for _, t in rows]
    label = {d: d for d, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * len(sets[i] | sets[j]):
                x, y = root(rows[i][0]), root(rows[j][0])
                label[max(x, y)] = min(x, y)
    want = sorted((d, len(s), root(d), root(d) == d) for (d, _), s in zip(rows, sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("n", F.lit(0))
    got = nd.near_duplicates(docs, n=n, num=num, den=100).collect()
    assert sorted((r.doc, r.n_shingles, r.component, r.kept) for r in got) == want


def test_blocks_and_rounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    test_near_duplicates_equal_brute_force(spark, 3, 85)


def test_same_id_and_no_id(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "u v w x y z"), (None, None), (None, "q r s")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=3).collect()
    assert sorted(((r.doc, r.component, r.kept) for r in got), key=str) == sorted(
        [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, False), (None, None, True), (None, None, False)], key=str)
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = x[:2000], x[500:]
    ra, rb = nd.registers(a), nd.registers(b)
    assert np.array_equal(np.maximum(ra, rb), nd.registers(np.concatenate([a, b])))
    e = nd.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2500.0]))[0]
    assert abs(e - 0.5) < 4 * math.sqrt(0.25 / nd.M)
    same = nd.estimate(ra[None], ra[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert same > 0.999


# --- mixing -----------------------------------------------------------------------------------------------

def shared_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), sum(sizes.values())
    while True:
        share = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / share > most * sizes[s]]
        if not over:
            return target | {s: left * w[s] / share for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" for _ in range(int(rng.integers(0, 60)))), None if i % 9 == 0 else f"s{i % 5}") for i in range(900)]
    rows += [(2000 + i, "same size here", "big") for i in range(700)] + [(3000, None, "s1"), (3001, "w", "tiny"), (3001, "w", "tiny"), (None, "w w", "s2"), (3002, "w " * 4000, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(-1)).withColumn("mix_size", F.lit("old"))
    got = mixing.mix(docs).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = shared_targets(size)
    taken = {s: 0 for s in size}
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r.mix_size * r.mix_copies
        assert r.mix_source_size == size[r.source] and r.mix_target == pytest.approx(want[r.source]) and 0 <= r.mix_copies <= 3
    assert sum(want.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - want[s]) <= 2 for s in ("s0", "s1", "s2", "s3", "s4", None, "big")), taken
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.taken_rows(mixing.mix(docs)).count() == sum(r.mix_copies for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r.mix_size, r.mix_target, r.mix_copies) for r in blank] == [(0, 0.0, 0)] * 2


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 3)), min_size=1, max_size=7, unique_by=lambda x: x[0]), st.floats(0, 1))
@settings(max_examples=150, deadline=None)
def test_budget_fit_is_close_and_feasible(groups, share):
    lengths, counts = np.array([g[0] for g in groups]), np.array([g[1] for g in groups])
    budget = share * float((lengths * counts).sum())
    got = mixing.fit_counts(lengths, counts, budget)
    assert (got >= 0).all() and (got <= counts).all()
    off = abs(int((got * lengths).sum()) - budget)
    # The proportional start is fixed; on top of it the fit is the best there is.
    start = np.floor(counts * (budget / (lengths * counts).sum())).astype(int)
    sums = {int((start * lengths).sum())}
    for n, k in zip(lengths, counts - start):
        sums = {s + int(n) * j for s in sums for j in range(k + 1)}
    assert off <= min(abs(s - budget) for s in sums) + 1


# --- top-k -----------------------------------------------------------------------------------------------------

def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "PER_CELL", 4)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    monkeypatch.setattr(knn, "SLICE", 50)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8) + 4 * (i % 6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 400)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (None, [1.0] * 8), (450, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", knn.whole_vector(F.col("e")).alias("v"), F.lit(1).alias("cell"))
    got = sorted(tuple(r) for r in knn.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect())
    use = {i: [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (8 - len(v)) for i, v in rows if i is not None and i not in (400, 401, 402, 403)}
    want = []
    for q in use:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(use[q], v)), i) for i, v in use.items() if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("apart", [False, True])
def test_top_k_with_repeated_rows_of_a_query_id(spark, monkeypatch, apart):
    """Many rows of one query id, in a cell of their own or dealt over all cells, stand in for no other row."""
    monkeypatch.setattr(knn, "PER_CELL", 1)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-50, 50, 4)]) for i in range(60)]
    rows += [(900, [float(x) for x in rng.integers(90, 100, 4)] if apart else [900.0, 0.0, 0.0, 0.0]) for _ in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = sorted(tuple(r) for r in knn.top_k(df, df.filter("vec_id % 10 = 0"), 5).select("query_id", "vec_id", "score").distinct().collect() if r.query_id != 900 or not apart)
    want = set()
    for q, v in rows:
        # One id with several vectors shares its places among them; here only what others find is compared.
        if q % 10 == 0 and (q != 900 or not apart):
            best = sorted((-sum(int(a * b) for a, b in zip(v, w)), i) for i, w in rows if i != q)[:5]
            want |= {(q, i, -s) for s, i in best}
    assert got == sorted(want)


def test_top_k_few_rows(spark):
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, v array<double>")
    assert knn.top_k(one, one).collect() == []
    assert knn.top_k(one.limit(0), one.limit(0)).collect() == []
    two = spark.createDataFrame([(50, [1.0]), (1, [2.0])], "vec_id long, v array<double>")
    assert [tuple(r) for r in knn.top_k(two, two.filter("vec_id = 50")).collect()] == [(50, 1, 1, 2)]


def test_huge_components_stay_exact():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**62, 0.0]])
    assert knn.exact_scores(q, x).tolist() == [[2**60 + 3, 2**63 - 1]]


# --- media -----------------------------------------------------------------------------------------------------------

@given(st.binary(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_wav_is_lossless(raw):
    payload = media.padded(raw)
    assert len(payload) % 576 == 0 and len(payload) and payload.startswith(raw) and set(payload[len(raw):]) <= {255} and len(payload) - len(raw) < 577
    file = media.wav_bytes(payload)
    assert media.wav_samples(file) == payload and len(file) == len(payload) + 44
    with wave.open(io.BytesIO(file)) as w:
        assert (w.getnchannels(), w.getsampwidth()) == (1, 1)


def test_fingerprints_follow_the_sound(monkeypatch):
    t = np.arange(576 * 40)
    tone = lambda f: (128 + 100 * np.sin(2 * np.pi * f * t / 576) * (1 + (t // 2880) % 2)).astype(np.uint8).tobytes()
    a, b = media.peak_pairs(tone(60)), media.peak_pairs(tone(90))
    assert len(a[0]) == len(a[1]) > 0 and (np.diff(a[0]) >= 0).all()
    assert {60} & set((a[1] >> 18).tolist()) and not set((b[1] >> 18).tolist()) & {60}
    monkeypatch.setattr(media, "BLOCK", 7)
    again = media.peak_pairs(tone(60))
    assert np.array_equal(a[0], again[0]) and np.array_equal(a[1], again[1])


def test_media_query(spark):
    got = {r.doc_id: r for r in QUERIES["op3_media"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs[:40]:
        raw, r = (d.text or "").encode(), got[d.doc_id]
        payload = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        t, c = media.peak_pairs(payload)
        assert r.feature.startswith(f"{len(t)}:")


def test_media_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 5000), (3, "é" * 5000)], "doc_id long, text string")
    out = df.withColumn("media", media.to_wav(F.col("text"))).withColumn("x", media.read_wav(F.col("media"))).collect()
    assert [len(r.x.payload) for r in out] == [576, 576, 10368, 10368] and out[0].x == out[1].x and out[2].x == out[3].x
    none = df.select(media.read_wav(F.lit(None).cast("binary")).alias("x")).first().x
    assert none.payload is None and none.times is None
    assert df.limit(0).select(media.to_wav(F.col("text"))).collect() == []


# --- URLs ---------------------------------------------------------------------------------------------------------------

URLS = [("http://Ab.Example.COM/en/1?x=/y#z", "ab.example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://a.www.example.com/en/q", "a.www.example.com", "/en/q", "www.example.com/en/", "allow"), ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("a.net/es/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://a.net/es/5", "a.net", "/es/5", "net/es/", "block"), ("http://a.net/esx", "a.net", "/esx", None, None),
        ("http://a.com", "a.com", "", None, None), ("http://a.com?u=http://b.net/es/", "a.com", "", None, None), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("h://x\ny.com/é\n?", "x\ny.com", "/é\n", "com/", "allow"),
        ("http://ÀB.com/#", "Àb.com", "/", "com/", "allow")]


def test_rules(spark):
    df = spark.createDataFrame([(u,) for u, *_ in URLS], "url string").withColumn("parts", F.lit("clash"))
    got = uf.filter_urls(df, RULES).collect()
    by = {r.url: r.url_verdict for r in got}
    for url, host, path, rule, verdict in URLS:
        v = by[url]
        assert (v.host, v.path, v.rule) == (host, path, rule)
        assert v.verdict == verdict if verdict else v.verdict in ("allow", "block")
    assert uf.filter_urls(df.limit(0), RULES).collect() == []


def test_models_tell_languages_apart(spark):
    rng = np.random.default_rng(2)
    make = lambda kind, i: f"http://{'shop' if kind else 'casino'}{rng.integers(0, 99)}.org/{'books' if kind else 'win'}/{i}"
    rows = [(make(i % 2, i), bool(i % 2)) for i in range(2000)]
    models = uf.train(spark.createDataFrame(rows, "url string, accepted boolean"))
    fresh = [(make(i % 2, i + 5000), bool(i % 2)) for i in range(200)]
    assert np.mean([models.allows(models.score(u)) == ok for u, ok in fresh]) > 0.98
    # The counts of all rows outside the calibration fold, and no others.
    assert models.symbols[0].sum() % (uf.ORDER + 1) == 0
    assert models.score("x" * 300_000) == models.score("x" * 300_000)


def test_models_equal_plain_counts():
    """Cells against dictionaries of contexts, without hashing."""
    urls = ["http://a.com/x", "http://a.com/y", "http://b.org/xx"]
    it = uf._count(iter([__import__("pandas").DataFrame({"url": urls, "accepted": [True, True, False]})]))
    got = next(it)
    symbols, contexts = np.zeros((2, uf.CELLS)), np.zeros((2, uf.CELLS))
    for side in (0, 1):
        symbols[side][got["cell"]], contexts[side][got["cell"]] = got[f"s{side}"], got[f"c{side}"]
    models = uf.Models(symbols, contexts)

    def plain(url, own):
        seen, ctx = {}, {}
        for u in own:
            s = [None] * uf.ORDER + [*u.encode()] + ["end"]
            for i in range(uf.ORDER, len(s)):
                for k in range(uf.ORDER + 1):
                    c = tuple(s[i - k: i])
                    seen[c, s[i]] = seen.get((c, s[i]), 0) + 1
                    ctx[c] = ctx.get(c, 0) + 1
        s, total = [None] * uf.ORDER + [*url.encode()] + ["end"], 0.0
        for i in range(uf.ORDER, len(s)):
            p = uf.FLAT
            for k in range(uf.ORDER + 1):
                c = tuple(s[i - k: i])
                p = (seen.get((c, s[i]), 0) + p) / (ctx.get(c, 0) + 1)
            total += math.log(p)
        return total / (len(s) - uf.ORDER)

    for url in ["http://a.com/x", "http://c.net", ""]:
        assert models.score(url) == pytest.approx(plain(url, urls[:2]) - plain(url, urls[2:]), abs=1e-5)


def test_filter_scores_equal_plain_counts_of_many_contexts(spark, monkeypatch):
    """More distinct contexts and symbols than fit 2**19 hashed cells without sharing; several chunks."""
    monkeypatch.setattr(uf, "URLS", 300)
    rng = np.random.default_rng(6)
    urls = [f"http://{h}.{end}/{''.join(rng.choice(list('0123456789abcdefghijklmnopqrstuv'), 40))}" for h in ("a", "b") for end in ("com", "net", "org") for _ in range(400)]
    rows = [*urls, urls[0], urls[0], None, ""]
    rules = [("allow", "com", "/"), ("block", "net", "/")]
    got = uf.filter_urls(spark.createDataFrame([(u,) for u in rows], "url string"), rules)
    aside = {r.url for r in got.filter(F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(5)) == 0).select("url").collect()}
    got = [(r.url, r.url_verdict) for r in got.collect()]
    assert sorted(str(u) for u, _ in got) == sorted(map(str, rows))
    seen, ctx = [{}, {}], [{}, {}]
    symbols = lambda u: [None] * uf.ORDER + [*(u or "").encode()] + ["end"]
    for u, v in got:
        if v.rule and u not in aside:
            side, s = int(v.verdict == "block"), symbols(u)
            for i in range(uf.ORDER, len(s)):
                for k in range(uf.ORDER + 1):
                    c = tuple(s[i - k: i])
                    seen[side][c, s[i]] = seen[side].get((c, s[i]), 0) + 1
                    ctx[side][c] = ctx[side].get(c, 0) + 1

    def plain(u):
        s, total = symbols(u), 0.0
        for i in range(uf.ORDER, len(s)):
            p = [uf.FLAT, uf.FLAT]
            for k in range(uf.ORDER + 1):
                c = tuple(s[i - k: i])
                p = [(seen[x].get((c, s[i]), 0) + p[x]) / (ctx[x].get(c, 0) + 1) for x in (0, 1)]
            total += math.log(p[0]) - math.log(p[1])
        return total / (len(s) - uf.ORDER)

    assert max(abs(v.score - plain(u)) for u, v in got) < 1e-9


# --- token counts --------------------------------------------------------------------------------------------------------

def test_rollups(spark, tmp_path):
    rows = [(1, "s", "en", "a b c"), (2, "s", None, None), (3, None, "en", "x"), (3, None, "en", "x"), (4, "t", "de", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    words = {"w1": n_words(F.col("text"))}
    folder, total = str(tmp_path / "r"), lambda p: sorted((tuple(r) for r in tc.totals(spark, p).collect()), key=str)
    tc.commit(folder, "1", tc.signed(tc.counted(docs, words), 1))
    first = total(folder)
    assert first == sorted([("s", "en", "w1", 1, 3), ("s", None, "w1", 1, 0), (None, "en", "w1", 2, 2), ("t", "de", "w1", 1, 0)], key=str)
    tc.commit(folder, "1", tc.signed(tc.counted(docs, words), 1))
    assert total(folder) == first
    gone = tc.signed(tc.counted(docs.filter("doc_id = 4"), words), -1)
    for _ in range(3):
        tc.commit(folder, "2", gone)
    longer = docs.filter("doc_id = 1").withColumn("text", F.lit("a b c d e")).withColumn("lang", F.lit("fr"))
    tc.commit(folder, "3", tc.revised(tc.counted(docs.filter("doc_id = 1"), words), tc.counted(longer, words)))
    want = sorted([("s", "fr", "w1", 1, 5), ("s", None, "w1", 1, 0), (None, "en", "w1", 2, 2)], key=str)
    assert total(folder) == want
    tc.commit(folder, "4", tc.signed(tc.counted(docs.limit(0), words), 1))
    other = str(tmp_path / "c")
    tc.compact(spark, folder, other)
    assert total(folder) == want == total(other)
    # A retry of a folded batch changes nothing, in the new folder and after folding in place; folding again does no harm.
    assert not tc.commit(other, "1", tc.signed(tc.counted(docs, words), 1))
    tc.compact(spark, folder, other)
    tc.compact(spark, folder)
    assert not tc.commit(folder, "2", gone) and total(folder) == want == total(other)
    assert tc.commit(folder, "5", tc.signed(tc.counted(docs.filter("doc_id = 2"), words), -1))
    tc.compact(spark, folder)
    assert total(folder) == [w for w in want if w[1] is not None]
    with pytest.raises(ValueError):
        tc.compact(spark, other, folder, "more")
    # What no manifest names can go.
    assert tc.sweep(spark, folder) > 0 == tc.sweep(spark, folder)
    assert total(folder) == [w for w in want if w[1] is not None]


def test_commits_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    folder, total = str(tmp_path / "r"), lambda: [tuple(r) for r in tc.totals(spark, str(tmp_path / "r")).collect()]
    rows = spark.createDataFrame([("s", "en", "w", 1, 3)], "source string, lang string, tokenizer string, docs long, tokens long")
    assert total() == [] and tc.sweep(spark, folder) == 0
    tc.commit(folder, "1", rows)
    publish, seen = tc._publish, []

    def crash(*args):
        seen.append(total())
        raise RuntimeError("lost driver")

    # A reader between writing and publishing, and everybody after a crash there, sees the old state of a batch that is being replaced.
    monkeypatch.setattr(tc, "_publish", crash)
    with pytest.raises(RuntimeError):
        tc.commit(folder, "1", rows.withColumn("tokens", F.lit(5).cast("long")))
    monkeypatch.setattr(tc, "_publish", publish)
    assert seen == [[("s", "en", "w", 1, 3)]] and total() == seen[0]

    def late(spark, folder, number, content):
        # Another writer puts the same manifest in place first.
        monkeypatch.setattr(tc, "_publish", publish)
        tc.commit(folder, "2", rows)
        assert not publish(spark, folder, number, content)
        return False

    monkeypatch.setattr(tc, "_publish", late)
    tc.commit(folder, "3", rows)
    assert total() == [("s", "en", "w", 3, 9)]


def test_token_counts_of_odd_rows(spark, tmp_path):
    rows = [(1, "s", "en", "a " * 200_000), (None, None, None, None), (1, "s", "en", "a " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    # Extra columns with the names of the operator's own.
    docs = docs.withColumns({"tokenizer": F.lit("x"), "tokens": F.lit(7), "docs": F.lit("y"), "batch": F.lit(1)})
    folder = str(tmp_path / "r")
    tc.commit(folder, "b", tc.signed(tc.counted(docs, {"w": n_words(F.col("text")), "p": tc.bpe_count(F.col("text"), RANKS)}), 1))
    got = {(r.source, r.tokenizer): (r.docs, r.tokens) for r in tc.totals(spark, folder).collect()}
    assert got[("s", "w")] == (2, 400_000) and got[(None, "w")] == (1, 0) == got[(None, "p")] and got[("s", "p")][1] == 2 * tc.count_tokens("a " * 200_000, RANKS)


@given(st.text(max_size=80))
@settings(max_examples=100, deadline=None)
def test_counts_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert tc.count_tokens(text, RANKS) == len(tc._encoding(RANKS)[0].encode_ordinary(text))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_token_query_equals_direct_counts(spark):
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        t, q = labels.get(r.doc_id, (0, 1))
        labels[r.doc_id] = (max(t, r.toxic), min(q, r.quality))
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        toxic, quality = labels.get(r.doc_id, (0, 1))
        if not toxic:
            text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text) if quality == 0 else r.text
            for kind, n in (("words-1", len(text.split(" ")) - (text[:1] == " ") - (text[-1:] == " ") if quality == 0 else len(text.encode().split())), ("byte_bpe_50k-1", tc.count_tokens(text, RANKS))):
                d, k = want.get((r.source, r.lang, kind), (0, 0))
                want[r.source, r.lang, kind] = (d + 1, k + n)
    assert got == want


# --- the pipeline ------------------------------------------------------------------------------------------------------------

@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
    for name in ("language_id", "line_dedup", "near_dedup", "mixing"):
        assert list(seen[name].columns) == corpus_pipeline.COLUMNS
    assert len(seen["language_id"]) >= 0.99 * len(seen["documents"])
    assert list(seen["line_dedup"]["doc_id"].sort_values()) == list(seen["language_id"]["doc_id"].sort_values())
    assert (seen["line_dedup"]["n_chars"] == seen["line_dedup"]["text"].str.len()).all()
    kept = seen["near_dedup"].set_index("doc_id")["text"]
    sets = {d: shingle_set(t, 5) for d, t in seen["line_dedup"].set_index("doc_id")["text"].items()}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    assert sorted(kept.index) == [d for d in ids if root(d) == d]
    mixed = seen["mixing"]
    assert mixed.groupby("doc_id").size().max() <= 3 and set(mixed["doc_id"]) <= set(kept.index)
    size = lambda x: x["text"].map(lambda t: len(t.split())).groupby(x["source"]).sum()
    before, after = size(seen["near_dedup"]), size(mixed)
    want, own = shared_targets(before.to_dict()), seen["near_dedup"]
    for s in want:
        # Whole repeats, and then the subset of the source's documents that fits best.
        budget, reach = want[s] - int(want[s] / before[s]) * before[s], 1
        for t in own.loc[own["source"] == s, "text"]:
            reach |= reach << len(t.split())
        best = min((abs(k - budget) for k in range(reach.bit_length()) if reach >> k & 1), default=0)
        assert abs(after.get(s, 0) - want[s]) <= best + 5
    last = seen["sentencepiece"]
    assert len(last) == len(mixed) and last["round_trip"].all() and (last["n_tokens"] == last["ids"].map(len)).all()
    pieces, text = sp.load(PIECES), mixed.set_index("doc_id")["text"]
    for d, ids in list(zip(last["doc_id"], last["ids"]))[:30]:
        t = text.loc[d]
        assert sp.decode_ids(list(ids), pieces) == (t if isinstance(t, str) else t.iloc[0])


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "no id of its own here at all", "en", "s", 5), (2, "", "en", None, 0), (3, "the house and the river with that thing", "en", "s", 5), (3, "the house and the river with that thing", "en", "s", 5)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_near_copies_keep_one_row_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(None, "a unique text that only lacks its id", "en", "s", 5), (None, base + " x", "en", "s", 5), (None, base + " y", "de", "s", 5), (7, "the same row twice over and over", "en", "s", 5), (7, "the same row twice over and over", "en", "s", 5),
            (8, "one text of a repeated id here", "en", "s", 5), (8, "quite another text of that repeated id", "en", "s", 5), (9, "one text of a repeated id here", "en", "s", 5), (None, "one text of a repeated id here", "en", "s", 5), (10, None, None, None, 0), (None, None, None, None, 0), (11, "", "en", "s", 0)]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    texts = sorted((str(r.doc_id), str(r.text)) for r in got if r.text != base + " x" and r.text != base + " y")
    assert texts == sorted([("None", rows[0][1]), ("7", rows[3][1]), ("8", rows[5][1]), ("8", rows[6][1]), ("10", "None"), ("None", "None"), ("11", "")])
    assert len(got) == len(texts) + 1
