"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Index. Documents are cut where the smallest hash of a ``SEED``-word run changes within a sliding window, which depends on the
words alone: all windows of ``window`` words that share their smallest run (their anchor) form a phrase. Every phrase of
every document belongs to the reference block of its anchor; the index says which anchors occur more than once, which phrases do,
and, for phrases that do not, which single windows do.

Parse. Left to right, a document's phrases are looked up in the blocks of their anchors. A phrase that the reference holds
elsewhere extends the current factor while it continues at the same distance from the same source, and
starts a new factor otherwise. At factor boundaries, where a phrase as a whole is not in the reference, each of its
windows is looked up by itself. Factors are at least ``window`` words long and are the duplicate spans.

Exact: a window is in a span if and only if its word sequence also starts elsewhere (same document included), up to
collisions of two 64-bit hashes (anchor and window). Two equal windows have equal anchors, so
nothing is lost by looking only into the anchor's block.

Scale: phrases are about ten times fewer than words; only those with a repeated anchor are looked at again. Counts are
pre-aggregated, so a passage in a third of all documents is one row per task; joins back to its occurrences are plain equi-joins,
which Spark splits when skewed. Texts are shuffled once, compressed.

Defined results: a null text has no words. Texts shorter than ``window`` words lose nothing. Repeated rows are documents of their own, so
they lose whatever a window covers, in every copy. Rows with the same id are told apart by their text. Null ids are
allowed. Extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfgrade.llm.common import WORDS, gram_hashes, mix, word_hashes

WINDOW = 35
#: Rows that are looked at together.
_VIEW = 1 << 18


def _raw(text) -> bytes:
    """UTF-8 of a text, or of a packed one."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else zlib.decompress(text) if isinstance(text, bytes) else b""


def _pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts compressed one by one: they are most of what is shuffled."""
    for pdf in it:
        yield pdf.assign(text=[zlib.compress(t.encode("utf-8", "surrogatepass"), 1) if isinstance(t, str) else None for t in pdf["text"]])


def phrases(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each phrase of a document."""
    seed = (window + 1) // 2
    span = window - seed + 1
    grams = gram_hashes(words, seed)
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    at = np.concatenate([view[k: k + _VIEW].argmin(axis=1) + np.arange(k, min(k + _VIEW, n)) for k in range(0, n, _VIEW)])
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[start]], start, np.diff(np.concatenate([start, [n]]))


def _anchors(window: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            doc, anchor, start = [], [], []
            for d, text in zip(pdf["doc"].array, pdf["text"]):
                a, s, _ = phrases(word_hashes(_raw(text)), window)
                if len(a):
                    doc.append(np.full(len(a), d, object if pd.isna(d) else np.int64))
                    anchor.append(a.view(np.int64))
                    start.append(s)
            if doc:
                yield pd.DataFrame({"doc": pd.array(np.concatenate(doc), "Int64"), "anchor": np.concatenate(anchor), "start": np.concatenate(start).astype(np.int32)})

    return run


def _looked_up(window: int, with_windows: bool):
    """Phrases whose anchors repeat, with the hash of all their words; if asked, with the hash of each window."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = {k: [] for k in ("doc", "own", "anchor", "phrase", "start", "size")}
            windows: list[np.ndarray] = []
            for d, own, text, want in zip(pdf["doc"].array, pdf["own"], pdf["text"], pdf["want"]):
                w = word_hashes(_raw(text))
                a, s, n = phrases(w, window)
                # Rows with the same id share what is wanted; starts of another row do no harm.
                take = np.isin(s, np.asarray(want))
                a, s, n = a[take], s[take], n[take]
                if not len(a):
                    continue
                up, down = WORDS.get(len(w) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)])])
                whole = mix((total[s + n + window - 1] - total[s]) * down[s] + (n + window - 1).astype(np.uint64))
                out["doc"].append(np.full(len(a), d, object if pd.isna(d) else np.int64))
                out["own"].append(np.full(len(a), own))
                out["anchor"].append(a.view(np.int64))
                out["phrase"].append(whole.view(np.int64))
                out["start"].append(s.astype(np.int32))
                out["size"].append(n.astype(np.int32))
                if with_windows:
                    each = gram_hashes(w, window).view(np.int64)
                    windows.extend(each[i: i + k] for i, k in zip(s, n))
            if out["doc"]:
                flat = pd.DataFrame({k: np.concatenate(v) for k, v in out.items() if k != "doc"} | {"doc": pd.array(np.concatenate(out["doc"]), "Int64")})
                if with_windows:
                    flat["windows"] = pd.Series(windows, dtype=object)
                yield flat[["doc", "own", "anchor", "phrase", "start", "size", *(["windows"] if with_windows else [])]]

    return run


def parse(found: list, window: int) -> list[tuple[int, int, int | None, int | None]]:
    """Factors ``(start, length, source document, source start)`` from looked-up phrases ``(start, size, mask, source document, source start)``.

    ``mask`` is null where the whole phrase is in the reference. Else its bits say which windows are; their source is not recorded.
    """
    out: list[list] = []
    for start, size, mask, doc, at in sorted(found, key=lambda x: x[0]):
        runs, k = [], 0
        if mask is None:
            runs = [(start, size, doc, at)]
        else:
            while k < size:
                if mask >> k & 1:
                    first = k
                    while k < size and mask >> k & 1:
                        k += 1
                    runs.append((start + first, k - first, None, None))
                k += 1
        for s, n, d, a in runs:
            last = out[-1] if out else None
            if last and s == last[0] + last[1] and last[2] == d and (d is None or a == last[3] + last[1]):
                last[1] += n
            else:
                out.append([s, n, d, a])
    return [(s, n + window - 1, d, a) for s, n, d, a in out]


def _same(it):
    yield from it


def _parsed(window: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            words, removed, kept, factors = [], [], [], []
            for own, text, found in zip(pdf["own"], pdf["text"], pdf["found"]):
                w = _raw(text).split()
                mine = [] if found is None else [(x["start"], x["size"], None if pd.isna(x["mask"]) else int(x["mask"]), x["ref_doc"], x["ref_start"]) for x in found if x["own"] == own]
                spans = parse(mine, window)
                gone = np.zeros(len(w) + 1, np.int64)
                for s, n, _, _ in spans:
                    gone[s] += 1
                    gone[s + n] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                words.append(len(w))
                removed.append(int(gone.sum()))
                kept.append((b" ".join(x for x, g in zip(w, gone) if not g) if spans else b" ".join(w)).decode("utf-8", "replace"))
                factors.append([{"start": s, "length": n, "ref_doc": None if d is None or pd.isna(d) else int(d), "ref_start": None if a is None or pd.isna(a) else int(a)} for s, n, d, a in spans])
            yield pd.DataFrame({"doc": pdf["doc"], "n_words": words, "n_removed": removed, "kept_text": kept, "factors": factors})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc, n_words, n_removed, kept_text, factors)``, one row per input row.

    ``factors`` are the duplicate spans ``(start, length, ref_doc, ref_start)`` in words; the reference is null for spans that were
    found window by window. ``window`` is at most 64.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    cut_up = base.filter("text is not null").mapInPandas(_anchors(window), "doc long, anchor long, start int")
    repeated = cut_up.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor")
    wanted = cut_up.join(repeated, "anchor", "left_semi").groupBy(F.col("doc").alias("wdoc")).agg(F.collect_set("start").alias("want"))
    packed = base.select("doc", F.xxhash64("text").alias("own"), "text").mapInPandas(_pack, "doc long, own long, text binary")
    rows = packed.join(wanted, F.col("doc").eqNullSafe(F.col("wdoc"))).select("doc", "own", "text", "want")
    kind = "doc long, own long, anchor long, phrase long, start int, size int"
    every = rows.mapInPandas(_looked_up(window, True), kind + ", windows array<long>")
    # Handing the rows on as they are keeps Spark from pruning the aggregate in two ways: both readers below share its exchange.
    block = every.groupBy("anchor", "phrase").agg(F.struct(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "start")).alias("ref"), F.max(F.struct("doc", "start")).alias("last"), F.first("windows").alias("windows")).alias("b"))
    block = block.mapInArrow(_same, block.schema)
    # Windows, for the phrases that are not repeated as a whole. Those that are count with their windows, too.
    single = block.select("anchor", "phrase", F.col("b.times").alias("times"), F.posexplode("b.windows").alias("offset", "window"))
    known = single.groupBy("anchor", "window").agg(F.sum("times").alias("times")).filter("times > 1").select("anchor", "window")
    masks = single.filter("times = 1").join(known, ["anchor", "window"]).groupBy("anchor", "phrase").agg(
        F.expr("bit_or(shiftleft(1L, offset))").alias("mask"))
    whole = block.filter("b.times > 1").select("anchor", "phrase", F.lit(None).cast("long").alias("mask"), "b.ref", "b.last")
    none = F.lit(None).cast(whole.schema["ref"].dataType)
    answers = whole.union(masks.select("anchor", "phrase", "mask", none.alias("ref"), none.alias("last")))
    # The source of a phrase is its first occurrence; for the first itself, the last.
    ref = F.when(F.struct("doc", "start").eqNullSafe(F.col("ref")), F.col("last")).otherwise(F.col("ref"))
    found = rows.mapInPandas(_looked_up(window, False), kind).join(answers, ["anchor", "phrase"]).select("doc", F.struct(
        "own", "start", "size", "mask", ref["doc"].alias("ref_doc"), ref["start"].alias("ref_start")).alias("x"))
    found = found.groupBy(F.col("doc").alias("fdoc")).agg(F.collect_set("x").alias("found"))
    final = packed.join(found, F.col("doc").eqNullSafe(F.col("fdoc")), "left").select("doc", "own", "text", "found")
    return final.mapInPandas(_parsed(window), "doc long, n_words long, n_removed long, kept_text string, factors array<struct<start: int, length: int, ref_doc: long, ref_start: int>>")
