"""Line dedup, substring dedup, language ID, pieces: edge cases, brute force, round trips."""
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfgrade.llm import langid, line_dedup, sentencepiece_codec as sp, substring_dedup as sub
from shelfgrade.llm.common import word_hashes
from shelfgrade.llm.queries import PIECES

DOC = "doc_id long, text string"


# --- line dedup ---------------------------------------------------------------------------------

def kept_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first, docs = {}, {}
    order = lambda d: (d is None, d)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                docs.setdefault(key(x), set()).add(d)
                if key(x) not in first or order(d) < order(first[key(x)]):
                    first[key(x)] = d
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or len(docs[key(x)]) < 2 or first[key(x)] == d)) for d, t in rows]


LINES = [(1, "a repeated line\nshort\nown line number one"), (2, "  A REPEATED LINE\t\nshort\n\n"), (3, None), (4, ""), (4, "a repeated line"), (5, "É repeated line\né repeated line"),
         (6, "é REPEATED line"), (None, "a repeated line\nno id at all"), (None, "no id at all"), (7, "\n".join(f"line {i % 90} of a long text" for i in range(400))), (8, "line 7 of a long text\nline 70 of a long text"), (2, "  A REPEATED LINE\t\nshort\n\n")]


def test_lines_equal_brute_force(spark):
    docs = spark.createDataFrame(LINES, DOC).withColumn("words", F.lit("x")).withColumn("row", F.lit(1)).withColumn("n_lines", F.lit("old"))
    out = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs))
    assert out.columns == ["doc_id", "text", "words", "row", "n_lines", "n_dropped", "kept_text"]
    got = sorted(((r.doc_id, r.kept_text) for r in out.collect()), key=str)
    assert got == sorted(kept_lines(LINES), key=str)
    r = out.filter("doc_id = 8").first()
    assert (r.n_lines, r.n_dropped, r.kept_text) == (2, 2, "")


def test_lines_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs)).collect() == []


def test_lines_native(spark):
    docs = spark.createDataFrame(LINES, DOC)
    plan = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan.replace("LogicalRDD", ""))


# --- substring dedup ------------------------------------------------------------------------------

def removed_words(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            count[tuple(w[i: i + window])] = count.get(tuple(w[i: i + window]), 0) + 1
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i: i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def passages(seed: int):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    a, b = word(30), word(9)
    rows = [(i, " ".join(word(int(rng.integers(0, 25))) + a[int(rng.integers(0, 12)): int(rng.integers(14, 30))] + word(5) + b)) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "x y " * 60), (43, "z " * 45), (44, rows[3][1]), (44, rows[5][1]), (None, rows[7][1]), (45, "\t".join(a) + "\n" + " ".join(a)), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("seed,window", [(1, 9), (2, 6), (3, 35)])
def test_repeats_equal_brute_force(spark, seed, window):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, DOC).withColumn("anchor", F.lit(0)).withColumn("own", F.lit("x"))
    out = sub.remove_repeats(docs, window=window).collect()
    assert sorted(((r.doc, r.n_words, r.n_removed, r.kept_text) for r in out), key=str) == removed_words(rows, window)
    text = {d: (t or "").split() for d, t in rows if d not in (3, 44, None)}
    for r in out:
        for f in r.factors:
            assert f.length >= window
            if f.ref_doc in text and r.doc in text:
                at, ref = text[r.doc], text[f.ref_doc]
                assert at[f.start: f.start + f.length] == ref[f.ref_start: f.ref_start + f.length]


def test_repeats_empty_table(spark):
    assert sub.remove_repeats(spark.createDataFrame([], DOC)).collect() == []


def test_factor_grows_along_one_source():
    assert sub.parse([(0, 3, None, 9, 5), (3, 2, None, 9, 8), (5, 1, None, 8, 8), (6, 4, 0b1101, None, None)], 10) == [
        (0, 14, 9, 5), (5, 10, 8, 8), (6, 10, None, None), (8, 11, None, None)]


@given(st.text(alphabet=" \t\n\x0b\x0c\rab  é", max_size=30))
def test_words_are_cut_at_the_six_blanks(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    got = word_hashes(text.encode())
    assert len(got) == len(words)
    assert [int(word_hashes(w.encode())[0]) for w in words] == [int(x) for x in got]


# --- language ID ----------------------------------------------------------------------------------

def test_languages(spark):
    base = {"en": "the house and the river with that thing", "de": "das haus und der fluss mit diesem ding", "fr": "la maison et le fleuve avec cette chose"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.permutation(base[x].split() * 4)), x) for i, x in enumerate(list(base) * 60)]
    odd = [(900, None, "en"), (901, "", None), (902, "123 !?", "de"), (903, rows[0][1], None), (903, rows[0][1], None), (904, "the river " * 50_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["de", "en", "fr"]
    got = docs.select("doc_id", "lang", langid.identify(F.col("text"), model).alias("x")).select("doc_id", F.col("lang").alias("truth"), "x.*").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert np.mean([by[i].lang == x for i, _, x in rows]) > 0.97
    assert [by[i].lang for i in (900, 901, 902)] == ["und"] * 3 and all(by[i].rejected for i in (900, 901, 902))
    assert by[903].lang == by[0].lang and by[904].lang == "en" and all(0 <= r.score <= 1 for r in got)
    again = langid.train(docs)
    assert np.array_equal(again.folded, model.folded)


def test_unlearned_languages_and_random_letters_are_rejected(spark):
    rng = np.random.default_rng(3)
    words = {x: ["".join(rng.choice(list(letters), int(rng.integers(2, 8)))) for _ in range(150)] for x, letters in (("a", "etaoinsh"), ("b", "eaiunrst"), ("c", "aeosrnid"))}
    make = lambda x: " ".join(rng.choice(words[x], int(rng.integers(20, 120))))
    model = langid.train(spark.createDataFrame([(make(x), x) for x in "abc" for _ in range(300)], "text string, lang string"))
    letters = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(60)) for _ in range(60)]
    other = [" ".join(rng.choice("дом и река с этой вещью которая была там всегда потому что никто не знал".split(), 40)) for _ in range(60)]
    rows = [("clean", make(x)) for x in "abc" for _ in range(100)] + [("letters", t) for t in letters] + [("other", t) for t in other]
    got = spark.createDataFrame(rows, "kind string, text string").select("kind", langid.identify(F.col("text"), model)["rejected"].alias("r"))
    share = {r.kind: r.s for r in got.groupBy("kind").agg(F.avg(F.col("r").cast("int")).alias("s")).collect()}
    assert share["clean"] <= 0.02 and share["letters"] >= 0.9 and share["other"] >= 0.9


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [tuple(r.x) for r in docs.select(langid.identify(F.col("text"), model).alias("x")).collect()] == [("und", 0.0, True)]
    assert docs.limit(0).select(langid.identify(F.col("text"), model)).collect() == []


def test_slots_of_long_texts_are_counted_in_blocks(monkeypatch):
    text = "abc déf " * 300
    whole = langid.slot_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.array_equal(langid.slot_counts(text), whole)
    assert langid.slot_counts("").sum() > 0


# --- pieces -----------------------------------------------------------------------------------------

def best_score(word, pieces):
    """Plain Viterbi of one word, no shared prefixes."""
    best = [0.0] + [-1e18] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            s = pieces.scores.get(word[start:end])
            if s is None and end - start == 1:
                s = pieces.unknown
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


@given(st.lists(st.text(alphabet="theinganou sé\n", min_size=1, max_size=14), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_shared_prefixes_change_nothing(words):
    pieces = sp.load(PIECES)
    names = {i: p for p, i in pieces.ids.items()}
    for word, ids in sp.encode_words(words, pieces).items():
        assert ids == sp.encode_words([word], pieces)[word]
        raw = sum(1 for i in ids if i not in names)
        unknown = len([c for c in word if c == "\n"])
        assert raw == unknown
        total = sum(pieces.scores[names[i]] for i in ids if i in names) + unknown * pieces.unknown
        assert total == pytest.approx(best_score(word, pieces))


@pytest.mark.parametrize("text", ["def f(x):\n        return x", "   a", "a" + " " * 40 + "the thing", " " * 17, "end   ", "\n    if the:\n            on   e"])
def test_blank_runs_equal_plain_viterbi(text):
    """Over the whole text and every piece of the file's vocabulary that holds no mark behind another character."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = sp.load(PIECES)
    runs = {m.id_to_piece(i) for i in range(m.get_piece_size()) if set(m.id_to_piece(i)) == {sp.MARK}}
    assert len(runs) == 15 and {r.replace(sp.MARK, " ") for r in runs} <= set(pieces.scores)
    ids = sp.encode_text(text, pieces)
    assert sp.decode_ids(ids, pieces) == text
    names = {i: p for p, i in pieces.ids.items()}
    total = sum(pieces.scores[names[i]] if i in names else pieces.unknown for i in ids)
    assert total == pytest.approx(best_score(" " + text, pieces))
    assert len(ids) < len(re.findall(" ", text)) + len(re.findall(r"\S|\n", text)) + 1


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    pieces = sp.load(PIECES)
    assert sp.decode_ids(sp.encode_text(text, pieces), pieces) == text


@pytest.mark.parametrize("text", ["▁", "a▁b", " ▁ ", "  two  blanks ", "\u0000x", "line\nbreak", "x" * 5000, "▁▁▁▁", " "])
def test_round_trip_of_odd_texts(text):
    pieces = sp.load(PIECES)
    assert sp.decode_ids(sp.encode_text(text, pieces), pieces) == text


def test_library_agrees(tmp_path):
    """The library's own unigram segmentation with the same pieces and scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    pieces = sp.load(PIECES)
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        p.score = pieces.scores[p.piece.replace(sp.MARK, " ")] if pieces.ids.get(p.piece.replace(sp.MARK, " ")) == i else 0.0 if p.type != 1 else -1000.0
    own = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ["The thing on the river.", "en ouéaieux le sont", "Anblewh sttible athawh thonre was"]:
        assert own.encode(text) == sp.encode_text(text, pieces)


def test_columns(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "The thing"), (3, "The thing")], DOC)
    got = docs.select("doc_id", sp.encode(F.col("text"), PIECES).alias("ids"), "text").select("*", sp.decode(F.col("ids"), PIECES).alias("back")).collect()
    assert [(r.ids is None, r.back) for r in got] == [(True, None), (False, ""), (False, "The thing"), (False, "The thing")]
    assert docs.limit(0).select(sp.encode(F.col("text"), PIECES)).collect() == []


def test_digest_is_of_the_kept_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_long_texts_are_encoded_a_few_at_a_time(spark):
    """Texts of 5 000 characters: what the encoder holds at once is bounded by characters, not by 256 texts; rows, order and ids stay."""
    import tracemalloc

    texts = [None, "", "a" * (sp.CHARS + 5), *[f"w{i} word {i % 7} " * 400 for i in range(300)], "é x", None]
    runs = list(sp.parts(texts))
    assert [t for r in runs for t in r] == texts
    assert all(len(r) == 1 or (len(r) <= sp.ROWS and sum(len(t or "") for t in r) <= sp.CHARS) for r in runs)
    assert [len(r) for r in sp.parts(["x"] * 600)] == [256, 256, 88] and list(sp.parts([])) == []
    pieces = sp.load(PIECES)
    memory, most = sp.Memory(pieces), 0
    tracemalloc.start()
    for run in runs[3:]:
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        sp._same(*memory.ids(run), run, pieces)
        most = max(most, tracemalloc.get_traced_memory()[1] - before)
    tracemalloc.stop()
    assert most < 24 * 2**20
    docs = spark.createDataFrame(list(enumerate(texts[-40:])), "doc_id INT, text STRING").coalesce(1)
    got = docs.select("text", sp.encode_checked(F.col("text"), PIECES).alias("x")).collect()
    assert [r["text"] for r in got] == texts[-40:] and all(r["x"]["round_trip"] for r in got)
    assert all(r["x"]["ids"] == (None if r["text"] is None else sp.encode_text(r["text"], pieces)) for r in got)
