"""Suffix-array dedup, ranked search and conversation repair: brute force, odd rows, skew."""
import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfgrade.llm import conversation_repair as cr, lexical, suffix_dedup as sd

DOCS = "doc_id long, text string"


# --- suffix-array dedup ----------------------------------------------------------------------------

def without_repeats(docs, window):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if b[i: i + window] in seen:
                gone[i: i + window] = b"\1" * window
            seen.add(b[i: i + window])
        spans = [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(gone))]
        out[d] = (len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g), spans)
    return out


def prose(seed, n=40, alphabet="abcdefghé"):
    r = random.Random(seed)
    parts = ["".join(r.choice(alphabet) for _ in range(r.randint(5, 60))) for _ in range(12)]
    return [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(n)]


def removed(df, **kw):
    return {r.doc: (r.n_bytes, r.n_removed, bytes(r.kept), [(s.start, s.length) for s in r.spans]) for r in sd.remove_repeats(df, **kw).collect()}


@pytest.mark.parametrize("seed, most", [(0, 10_000), (1, 2), (2, 10_000)])
def test_removed_bytes_equal_brute_force(spark, seed, most):
    docs = prose(seed, alphabet="ab" if seed == 2 else "abcdefghé") + [(100, None), (101, "a" * 300), (102, "ab" * 200), (104, ""), (105, "short")]
    docs += [(103, docs[3][1])]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    assert removed(df, window=20, seed=8, most=most) == without_repeats(docs, 20)


def test_very_long_text_and_views(spark, monkeypatch):
    r = random.Random(5)
    part = "".join(r.choice("abcdefgh ") for _ in range(1000))
    long = "".join(r.choice("abcdefgh ") for _ in range(300_000))
    docs = [(1, long), (2, part + long[100_000:100_500] + part), (3, "x" + part)]
    assert removed(spark.createDataFrame(docs, DOCS)) == without_repeats(docs, 100)
    # Phrases do not depend on the pieces in which bytes are hashed.
    buf, offsets = np.frombuffer((long[:5000] + part).encode(), np.uint8), np.array([0, 5000, 6000])
    whole = [x.tolist() for x in sd.phrases(buf, offsets, 100, 40)]
    monkeypatch.setattr(sd, "_VIEW", 333)
    assert [x.tolist() for x in sd.phrases(buf, offsets, 100, 40)] == whole


def test_odd_rows(spark):
    text = "".join(random.Random(1).choices("abcdef", k=200))
    rows = [(None, text, "x"), (7, text, None), (7, text, "y"), (7, text + "zz", "y"), (None, None, None), (9, text[:50], "z")]
    # Extra columns whose names the operator uses itself.
    df = spark.createDataFrame(rows, "doc_id long, text string, own string").withColumn("body", F.lit(1)).withColumn("anchor", F.lit("q"))
    got = sorted(((r.doc is None, r.doc or 0, r.n_bytes, r.n_removed) for r in sd.remove_repeats(df).collect()))
    # Of the two texts of document 7 one comes first by its hash and the other loses the 200 bytes; repeated rows share their result; null ids come last.
    rest = [(False, 9, 50, 0), (True, 0, 0, 0), (True, 0, 200, 200)]
    assert got in (sorted([(False, 7, 200, a), (False, 7, 200, a), (False, 7, 202, 200 - a), *rest]) for a in (0, 200))
    assert sd.remove_repeats(df.limit(0)).collect() == []


def test_suffix_array_is_sorted_with_true_prefixes():
    r = random.Random(3)
    bodies = list({"".join(r.choice("ab") for _ in range(r.randint(20, 90))).encode() for _ in range(80)} | {b"a" * 70, b"ab" * 30, b"\0" * 40, b"\xff" * 33})
    body, offset, common = sd.suffix_array(bodies, 20)
    got = [bodies[b][o:] for b, o in zip(body, offset)]
    assert got == sorted(got) and len(got) == sum(max(0, len(x) - 19) for x in bodies)
    for i in range(1, len(got)):
        k = 0
        while k < min(len(got[i]), len(got[i - 1])) and got[i][k] == got[i - 1][k]:
            k += 1
        assert common[i] == k


def test_groups_are_left_and_right_maximal_with_all_occurrences(spark):
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh") for _ in range(33))
    noise = ["".join(r.choice("ijklmnop") for _ in range(30)) for _ in range(12)]
    docs = [(i, noise[2 * i] + passage + noise[2 * i + 1]) for i in range(5)] + [(5, noise[10] + noise[0][-4:] + passage + noise[11])]
    rows = sd.maximal_repeats(spark.createDataFrame(docs, DOCS), window=20, seed=8).collect()
    text = dict(docs)
    groups = defaultdict(set)
    for x in rows:
        groups[x.grp, x.length].add((x.doc, x.start))
    assert groups
    for (_, length), members in groups.items():
        strings = {text[d][s: s + length] for d, s in members}
        assert len(strings) == 1 and length >= 20
        # All occurrences, not just neighbours.
        string = strings.pop()
        assert members == {(d, m.start()) for d, t in docs for m in re.finditer(f"(?={string})", t)}
    # Together the chain covers the passage in all six documents, and document 0 and 5 share four bytes more.
    cover = defaultdict(set)
    for (_, length), members in groups.items():
        for d, s in members:
            cover[d] |= set(range(s, s + length))
    assert all(set(range(t.index(passage), t.index(passage) + 33)) <= cover[d] for d, t in docs)
    assert set(range(26, 63)) <= cover[0] and set(range(30, 67)) <= cover[5] and min(cover[1]) == 30


def test_one_passage_in_all_documents_is_split(spark):
    """A short passage between other words: its block is cut into single windows, which go everywhere."""
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh") for _ in range(26))
    docs = [(i, "".join(r.choice("ijklmnop") for _ in range(60)) + passage + "".join(r.choice("qrstuv") for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(docs, DOCS)
    assert removed(df, window=20, seed=8, most=50) == without_repeats(docs, 20) == removed(df, window=20, seed=8)


# --- ranked lexical search ---------------------------------------------------------------------------

def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_ranking(docs, items, k):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, words, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in plain_terms(text) if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        for i, (s, none, d) in enumerate(sorted(scores)[:k], 1):
            out[item, i] = (None if none else d, -s)
    return out


def ranked(docs, items, **kw):
    return {(r.item_id, r.rank): (r.doc_id, r.score) for r in lexical.rank(docs, items, **kw).collect()}


@pytest.mark.parametrize("slots", [1, 16, 1024])
def test_ranking_equals_brute_force(spark, slots):
    r = random.Random(slots)
    vocabulary = [f"w{i}" for i in range(200)] + ["Élan", "straße", "naïve", "ÄÖ", "a_b", "x-y", "42", "İ", "日本"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(int(r.paretovariate(1) * 10) % 400))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "... --"), (None, docs[5][1]), (1003, docs[5][1]), (1004, docs[5][1]), (1005, "w1 " * 20_000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(12))) for i in range(30)] + [(50, None), (51, "absent"), (52, docs[5][1]), (53, "w1 W1 w1")]
    got = ranked(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=10, slots=slots)
    assert got == plain_ranking(docs, items, 10)


def test_bounds_hold_and_spare_exact_scores():
    r = random.Random(2)
    vocabulary = [f"w{i}".encode() for i in range(3000)]
    rows = [(i, Counter(r.choices(vocabulary, k=60)), 100) for i in range(2000)]
    item = {t: 1000 for t in rows[77][1]}
    search = lexical.Search([item], 10, lexical.SLOTS)
    assert all(b[0] >= lexical.score(c, m, item) for b, (_, c, m) in zip(search.bounds(rows), rows))
    for k in range(0, 2000, 250):
        search.add(rows[k: k + 250])
    want = heapq.nsmallest(10, ((-lexical.score(c, m, item), False, d) for d, c, m in rows))
    assert search.best[0] == want and want[0][2] == 77
    assert search.rescored < 400


def test_search_blocks_repeats_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "c d")], DOCS).withColumn("score", F.lit("x")).withColumn("item_id", F.lit(5))
    items = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c"), (3, "d")], "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("rank", F.lit(1))
    monkeypatch.setattr(lexical, "ITEMS", 1)
    got = ranked(docs, items)
    # Equal items are one item; a document that stands twice is ranked twice.
    assert {k: v[0] for k, v in got.items()} == {(1, 1): 1, (1, 2): 1, (2, 1): 2, (2, 2): 1, (2, 3): 1, (3, 1): 2}
    assert lexical.rank(docs.limit(0), items).collect() == [] and lexical.rank(docs, items.limit(0)).collect() == []
    assert lexical.rank(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


# --- conversation repair -------------------------------------------------------------------------------

def plain_cheapest(symbols):
    """Cheapest edits by a search over (rows read, state), costs and strings compared as they are."""
    heap, done = [(0, "", 0, 0)], {}
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = cost, edits
        steps = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
        to = {"s": 1, "u": 2, "a": 3}
        for c in steps:
            if c != "s":
                heapq.heappush(heap, (cost + 2, edits + "I", i, to[c]))
        if i < len(symbols):
            x = symbols[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state))
            if x != "D":
                for c in steps:
                    if c == x.lower():
                        heapq.heappush(heap, (cost + x.isupper(), edits + "K", i + 1, to[c]))
                    if c != "s":
                        heapq.heappush(heap, (cost + 2 + x.isupper(), edits + "R", i + 1, to[c]))
    return min(done[len(symbols), s] for s in (0, 3) if (len(symbols), s) in done)


def test_matrices_equal_a_plain_search():
    r = random.Random(1)
    sequences = ["".join(r.choice(cr.SYMBOLS) for _ in range(r.randint(1, 14))) for _ in range(400)] + list(cr.SYMBOLS) + ["u" * 50, "ua" * 40 + "a", "suuaXDsA" * 9]
    for s, m in zip(sequences, cr.solved(sequences)):
        assert cr.cheapest([m]) == plain_cheapest(s), s
    # Pieces of a conversation give what the whole gives.
    long = "".join(r.choice(cr.SYMBOLS) for _ in range(120))
    assert cr.cheapest(cr.solved([long[:31], long[31:90], long[90:]])) == plain_cheapest(long)
    assert cr.cheapest([]) == (0, "")


def test_grammar_gives_the_sequences_back():
    r = random.Random(2)
    sequences = ["".join(r.choice("sua") for _ in range(r.randint(1, 60))) for _ in range(50)] + ["uuuuuuu", "u" * 100]
    rules, coded = cr.re_pair(sequences)

    def spelled(x):
        return cr.SYMBOLS[x] if x < len(cr.SYMBOLS) else "".join(map(spelled, rules[x - len(cr.SYMBOLS)]))

    assert ["".join(map(spelled, c)) for c in coded] == sequences
    assert sum(map(len, coded)) + 2 * len(rules) < sum(map(len, sequences))
    pairs = Counter(p for c in coded for p in zip(c, c[1:]) if p[0] != p[1])
    assert all(n < 2 for n in pairs.values())


def test_ropes_compare_as_strings():
    r = random.Random(3)
    ropes = ["", "K", "D"]
    for _ in range(300):
        ropes.append(cr.joined(r.choice(ropes[-40:]), r.choice(ropes[-40:])))
    for _ in range(3000):
        a, b = r.choice(ropes), r.choice(ropes)
        if len(a) < 10_000 and len(b) < 10_000:
            assert cr.before(a, b) == (str(a) < str(b))


def plain_repair(rows, damage=True):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub(r"[.!?]", "", text)
        elif kind == 4:
            role = "user"
        groups[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))
        seen, symbols, n = set(), "", Counter()
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "D" if fault in ("blank", "duplicate") else c.upper() if fault else c
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit = plain_cheapest(symbols)
        lines, state, at = [], 0, iter(mine)
        for e in audit:
            _, role, text = next(at) if e != "I" else (None, "", "")
            if e != "D":
                role = role if e == "K" else "assistant" if state == 2 else "user"
                lines.append((role, "" if e == "I" else text))
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest), lines
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversations(seed=0):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  ", "a. b", "wait...\n", "Yes.", None]
    rows = []
    for c in range(120):
        for t in range(r.randint(1, 12)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, t, r.choice([role, role, role, "system", "tool", None, ""]) if r.random() < 0.3 else role, r.choice(texts) if r.random() < 0.4 else f"text {c} {t}."))
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y."), (500, None, "user", "a."), (500, None, "assistant", "b."), (501, 3, "user", "z" * 100_000 + ".")]
    return rows + rows[3:6]


@pytest.mark.parametrize("damage", [True, False])
def test_repair_equals_brute_force(spark, monkeypatch, damage):
    rows = conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("part", F.lit("x")).withColumn("conv", F.lit(3)).withColumn("symbols", F.lit(1)).repartition(3)
    want = plain_repair(rows, damage)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_summary(df, damage=damage).collect()}
    assert got == {c: x for c, (x, _) in want.items()}
    turns = defaultdict(list)
    for r in sorted(cr.repaired_turns(df, damage=damage).collect(), key=lambda r: (r.conv_id is None, r.conv_id, r.position)):
        turns[r.conv_id].append((r.role, r.text))
    assert turns == {c: x for c, (_, x) in want.items() if x}
    assert cr.repair_summary(df.limit(0)).collect() == []


def test_one_long_conversation_over_many_pieces(spark):
    r = random.Random(9)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), f"text {t}" + r.choice([".", "", "!"])) for t in range(5000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    want = plain_repair(rows)
    assert {x.conv_id: tuple(x)[1:] for x in cr.repair_summary(df, damage=True).collect()} == {c: x for c, (x, _) in want.items()}
