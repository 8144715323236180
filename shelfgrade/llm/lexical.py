"""Ranked lexical search by hashed max-sketches.

Terms are the runs of letters, digits and bytes above 127, with A-Z lower-cased. A document's score for an item is the sum of
``weight(term) * impact(tf, length)`` over the item's terms, all in whole numbers.

Sketch. A document's terms are hashed into ``slots``; each slot keeps the largest impact of the terms in it. As impacts depend on the
document alone, a sketch knows nothing of the items. Looked up with an item's term weights, it gives an upper bound of the score:
the items of a block are looked up at once, as one matrix product per batch of sketches (whole numbers below 2**53, so doubles are exact).

Search. Within a batch, an item's documents are taken by descending bound and scored exactly, until the bound falls below the
item's k-th best score so far. That threshold is kept over the batches of a task. Each task returns at most k rows an item, which
a window ranks.

Scale: texts are read twice, for the statistics and for the search, and never shuffled. Document counts are only kept of the terms of
a block of items; they are summed in each task first. Items are taken in blocks of bounded size, each against all rows; a block's term
weights are all that the tasks are handed.

Defined results: null and empty texts have no terms and are not ranked. A null item text gives no rows. Rows of equal item id and text are one
item; equal ids with other texts are ranked by themselves. Repeated documents are each ranked, null ids after all others. Terms that no document
holds add nothing. Extra columns are ignored; empty tables give an empty result.
"""
from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SLOTS = 4096
#: Documents whose sketches are looked up together, and the items and the bytes of their texts in a block.
BATCH, ITEMS, ITEM_BYTES = 256, 2048, 1 << 24
#: Every byte that is no part of a term becomes a blank, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def impact(tf, m):
    """Whole-number saturation of a term frequency; ``m`` is the length factor of the document."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_factor(n: int, docs: int, words: int) -> int:
    return 100 - 75 + 75 * n * docs // words


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _slot(term: bytes, slots: int) -> int:
    # Python's own hash of bytes differs between processes; a sketch lives within one task.
    return hash(term) % slots


def _statistics(vocabulary: frozenset[bytes]):
    """``(term, value)``: documents that hold a term; under null the documents, under the empty term the words."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = Counter(), 0, 0
        for b in it:
            for x in b.column("body"):
                found = terms(x.as_py())
                docs += bool(found)
                words += len(found)
                df.update(vocabulary.intersection(found))
        yield pa.RecordBatch.from_arrays([pa.array([None, b"", *df], pa.binary()), pa.array([docs, words, *df.values()], pa.int64())], ["term", "value"])

    return run


def sketch(counts: Counter, m: int, slots: int) -> np.ndarray:
    """Largest impact in each slot."""
    out = np.zeros(slots)
    if counts:
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        np.maximum.at(out, np.fromiter((_slot(t, slots) for t in counts), np.int64, len(counts)), impact(tf, m))
    return out


def score(counts: Counter, m: int, item: dict[bytes, int]) -> int:
    return sum(w * impact(counts[t], m) for t, w in item.items() if t in counts)


class Search:
    """The k best documents of each item of a block, over all batches of a task."""

    def __init__(self, items: list[dict[bytes, int]], k: int, slots: int):
        self.items, self.k, self.slots = items, k, slots
        # Smallest of the k best scores; 0 while there are fewer, which also keeps documents without any term out.
        self.threshold = np.zeros(len(items))
        self.best: list[list[tuple]] = [[] for _ in items]
        self.rescored = 0

        # Slots that any item asks for, and the summed term weights by slot and item.
        self.used = np.array(sorted({_slot(t, slots) for item in items for t in item}), np.int64)
        self.lookup = np.zeros((len(self.used), len(items)))
        for j, item in enumerate(items):
            for t, w in item.items():
                self.lookup[np.searchsorted(self.used, _slot(t, slots)), j] += w

    def bounds(self, rows: list[tuple]) -> np.ndarray:
        """Upper bounds of the scores, documents by items."""
        return np.stack([sketch(c, m, self.slots)[self.used] for _, c, m in rows]) @ self.lookup

    def add(self, rows: list[tuple]) -> None:
        """``rows``: (id, term counts, length factor) of a batch."""
        bounds = self.bounds(rows)
        for j in np.flatnonzero((bounds >= np.maximum(self.threshold, 1)).any(axis=0)):
            best, item = self.best[j], self.items[j]
            for i in np.argsort(-bounds[:, j], kind="stable"):
                # A document that ties with the k-th may come before it by its id.
                if bounds[i, j] < max(self.threshold[j], 1):
                    break
                doc, counts, m = rows[i]
                self.rescored += 1
                s = score(counts, m, item)
                if s > 0:
                    insort(best, (-s, doc is None, doc or 0))
                    if len(best) > self.k:
                        best.pop()
                    if len(best) == self.k:
                        self.threshold[j] = -best[-1][0]


def _searched(keys: list[int], items: list[dict[bytes, int]], docs: int, words: int, k: int, slots: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held = Search(items, k, slots), []
        for b in it:
            for d, x in zip(b.column("doc").to_pylist(), b.column("body")):
                found = terms(x.as_py())
                if found:
                    held.append((d, Counter(found), length_factor(len(found), docs, words)))
                if len(held) >= BATCH:
                    search.add(held)
                    held = []
        if held:
            search.add(held)
        rows = [(key, None if none else d, -s) for key, best in zip(keys, search.best) for s, none, d in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item", "doc", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items in blocks of at most ``ITEMS`` rows and about ``ITEM_BYTES`` of text, one block on the driver at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append(row)
        size += len(row["text"])
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         slots: int = SLOTS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k highest-scoring documents of each item, equal scores by ascending id."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("body"))
    asked = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("binary").alias("text")).filter("text is not null").distinct()
    found, number = None, 0
    for block in _blocks(asked):
        counted = [Counter(terms(bytes(r["text"]))) for r in block]
        stats = base.filter("body is not null").select("body").mapInArrow(_statistics(frozenset().union(*counted)), "term binary, value long")
        sums = {None if r["term"] is None else bytes(r["term"]): r["value"] for r in stats.groupBy("term").agg(F.sum("value").alias("value")).collect()}
        n, words = sums.pop(None, 0), sums.pop(b"", 0)
        weighted = [{t: q * weight(n, sums[t]) for t, q in c.items() if t in sums} for c in counted]
        keys = list(range(number, number + len(block)))
        number += len(block)
        names = spark.createDataFrame([(key, r["id"]) for key, r in zip(keys, block)], "item long, item_id long")
        part = base.mapInArrow(_searched(keys, weighted, n, max(words, 1), k, slots), "item long, doc long, score long").join(F.broadcast(names), "item")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
