"""MinHash-style near-dedup with SetSketch registers.

A document is the set of its distinct ``n``-word shingles. Each of the ``m`` registers is the truncated
logarithm, to a base near 1, of the smallest of exponentially spaced values that the set's elements
draw; registers merge by maximum, and two sets' registers agree about as often as their Jaccard
similarity. Runs of ``rows`` registers are bands; documents that agree in a band are candidates. For
these the similarity is estimated from all registers jointly (likelihood over smaller, equal, larger),
clearly unlike pairs are dropped, and every other pair is confirmed on the full shingle sets.

No link is lost to group sizes, and no list of pairs is made. Documents with equal word sequences are one class from
the start. The members of a band group are compared by registers in blocks of at most ``BLOCK``, block against block; a
task keeps its members joined where the estimate lets a pair through and emits only a forest. The forests' components
are clusters of likely links. Within a cluster full texts meet in the same way, block against block: a pair that is not
yet joined is tested on the full shingle sets, and a forest of confirmed links is emitted. The components of these
are the result. With 32 bands of 4 the chance that a pair at the threshold shares no band is below 1e-9; the
estimate drops a pair only 4.5 standard deviations below the threshold.

Scale: what a task holds is bounded by two blocks, what it emits by their members. Work within one cluster of m different texts is
(m / BLOCK)^2 / 2 tasks, and m / BLOCK copies of each of its texts are shuffled.

Defined results: a document without words (null or empty text too) is alone and is kept, with 0
shingles. With fewer than ``n`` words, the whole sequence is the one shingle. Repeated rows are one
class; rows with the same id count as one document whose texts are all linked through it. Null ids
come as one component with a null label and ``kept`` false unless without words. Extra columns are ignored. An empty
table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfgrade.llm.common import components, cut, gram_hashes, mix, word_hashes

M, ROWS, BASE, RATE, TOP = 128, 4, 1.001, 20.0, 65535
#: Most members of a block on average, and most shingles.
BLOCK, SHINGLES = 512, 1 << 20
_SEEDS = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(text: str) -> bytes:
    """The lower-cased (A-Z) words, joined by one blank."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def shingles(words: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    w = word_hashes(words)
    if not len(w):
        return w
    return np.unique(gram_hashes(w, min(n, len(w))))


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of hashes.

    The smallest of the exponential values comes from the smallest hash, so logarithms are taken once per register.
    """
    low = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 1024):
        x = elements[at: at + 1024, None] * _SEEDS[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, x.min(axis=0), out=low)
    value = -np.log1p(-np.minimum((low.astype(np.float64) + 0.5) * 2.0**-64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    larger, smaller = (a > b).sum(axis=-1).astype(float), (a < b).sum(axis=-1).astype(float)
    return a.shape[-1] - larger - smaller, larger, smaller


def _slope(j, equal, larger, smaller, u, v):
    """Derivative of the log-likelihood at similarity ``j``.

    With u and v the shares of the two sizes, a register of the first set is larger with probability p(u - v J),
    smaller with p(v - u J) and equal otherwise, where p(x) = -log_b(1 - x (b - 1) / b). For the base used here p is the identity
    to within a thousandth, so equal has probability J. The likelihood is concave in J.
    """
    return equal / np.maximum(j, 1e-9) - larger * v / np.maximum(u - v * j, 1e-9) - smaller * u / np.maximum(v - u * j, 1e-9)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint likelihood estimate of the Jaccard similarity of register rows, given the set sizes."""
    counts, u = _counts(a, b), na / (na + nb)
    v = 1 - u
    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(20):
        j = (lo + hi) / 2
        up = _slope(j, *counts, u, v) > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def reaches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Is the estimate at least ``least``? As the likelihood is concave, its slope there says so."""
    u = na / (na + nb)
    v = 1 - u
    return (np.minimum(u / v, v / u) >= least) & (_slope(least, *_counts(a, b), u, v) >= 0)


def _fingerprints(n: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            keys, sizes, sketches = [], [], []
            for text in pdf["text"]:
                words = words_of(text) if isinstance(text, str) else b""
                s = shingles(words, n)
                keys.append(hashlib.blake2b(words, digest_size=16).digest() if words else None)
                sizes.append(len(s))
                sketches.append(registers(s).astype("<u2").tobytes() if len(s) else None)
            yield pd.DataFrame({"doc": pdf["doc"], "key": keys, "n": sizes, "sketch": sketches})

    return run


def _floor(threshold: float) -> float:
    return threshold - 4.5 * sqrt(threshold * (1 - threshold) / M)


def _joined(label: np.ndarray, a: int, b: int) -> None:
    """Union by relabelling, for a few thousand members."""
    label[label == label[b]] = label[a]


#: Groups up to this size are compared all at once, many groups together.
SMALL = 8


def _likely(threshold: float):
    """Sorted rows of many block pairs of band groups: per block pair links whose estimate is high enough to look at the texts.

    A stream of batches: only the rows of one block pair are carried over. Of a large block pair a forest is emitted, of
    a small one all its at most 28 pairs that pass.
    """
    least = _floor(threshold)

    def near(x, y, s, n):
        ok = np.minimum(n[x], n[y]) >= (threshold - 1e-9) * np.maximum(n[x], n[y])
        x, y = x[ok], y[ok]
        fits = [reaches(s[x[k: k + 4096]], s[y[k: k + 4096]], n[x[k: k + 4096]], n[y[k: k + 4096]], least) for k in range(0, len(x), 4096)]
        ok = np.concatenate(fits) if fits else np.empty(0, bool)
        return x[ok], y[ok]

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.frombuffer(b"".join(pdf["sketch"]), "<u2").reshape(-1, M)
        n, rep, side = pdf["n"].to_numpy(float), pdf["rep"].to_numpy(np.int64), pdf["side"].to_numpy()
        same = (pdf["i"] == pdf["j"]).to_numpy()
        start = _starts(pdf)
        size = np.diff(np.concatenate([start, [len(pdf)]]))
        out = []
        for k in range(2, SMALL + 1):
            first = start[size == k]
            x, y = np.triu_indices(k, 1)
            x, y = (first[:, None] + x).ravel(), (first[:, None] + y).ravel()
            ok = same[x] | (side[x] != side[y])
            out.append(near(x[ok], y[ok], s, n))
        for at, k in zip(start[size > SMALL], size[size > SMALL]):
            rows = np.arange(at, at + k)
            label, left = np.arange(k), np.flatnonzero(side[rows] == 0)
            for a in left:
                others = np.flatnonzero((label != label[a]) & ((np.arange(k) > a) if same[at] else (side[rows] == 1)))
                for b in near(np.full(len(others), at + a), at + others, s, n)[1] - at:
                    if label[a] != label[b]:
                        _joined(label, a, b)
                        out.append((np.array([at + a]), np.array([at + b])))
        x, y = (np.concatenate([o[i] for o in out]) for i in (0, 1))
        return pd.DataFrame({"a": rep[x], "b": rep[y]})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in it:
            if not len(pdf):
                continue
            pdf = pd.concat([*held, pdf], ignore_index=True)
            last = int(_starts(pdf)[-1])
            if last:
                yield links(pdf.iloc[:last])
            held = [pdf.iloc[last:]]
        if held:
            yield links(held[0].reset_index(drop=True))

    return run


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    """First rows of the runs of equal ``(band, i, j)``."""
    key = pdf[["band", "i", "j"]].to_numpy()
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    same = bool(pdf["i"].iloc[0] == pdf["j"].iloc[0])
    left = pdf[pdf["side"] == 0]
    return left, left if same else pdf[pdf["side"] == 1], same


def _linked(n: int, num: int, den: int):
    """Two blocks of one cluster: a forest of links confirmed on the full shingle sets."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        both = left if same else pd.concat([left, right])
        rep, sets = both["rep"].to_numpy(np.int64), [shingles(words_of(t), n) for t in both["text"]]
        sizes = np.array([len(x) for x in sets])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        names, where = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True)
        label, links, mark = np.arange(len(rep)), [], np.zeros(len(names), np.int8)
        for k in range(len(left)):
            first = k + 1 if same else len(left)
            if not (label[first:] != label[k]).any():
                continue
            own = where[ends[k]: ends[k + 1]]
            mark[own] = 1
            inter = np.add.reduceat(mark[where[ends[first]:]], ends[first:-1] - ends[first], dtype=np.int64)
            for j in first + np.flatnonzero(den * inter >= num * (sizes[k] + sizes[first:] - inter)):
                if label[j] != label[k]:
                    _joined(label, k, j)
                    links.append((rep[k], rep[j]))
            mark[own] = 0
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _dealt(members: DataFrame, group: str, blocks: DataFrame) -> DataFrame:
    """Rows ``(group, rep, i, j, side)``: every member goes to each pair of blocks that holds its own block."""
    m = members.join(blocks, group).withColumn("own", F.pmod(F.xxhash64("rep", group), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return m.select(group, "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc, n_shingles, component, kept)``, one row per input row.

    Linked are documents with ``den * intersection >= num * union`` of their distinct ``n``-word shingles. Ids are integers.
    """
    threshold = num / den
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    prints = cut(slim.mapInPandas(_fingerprints(n), "doc long, key binary, n long, sketch binary"))
    classes = prints.filter("key is not null and doc is not null").groupBy("key").agg(
        F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes)
    bands = classes.select("rep", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.substring("sketch", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(M // ROWS)])).alias("band"))
    groups = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    dealt = _dealt(bands, "band", groups.select("band", F.ceil(F.col("size") / BLOCK).alias("blocks")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.join(classes.select("rep", "n", "sketch"), "rep").repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    likely = met.mapInPandas(_likely(threshold), "a long, b long")
    clusters = cut(components(likely).select(F.col("node").alias("rep"), F.col("label").alias("cluster")))
    weights = clusters.join(classes.select("rep", "n"), "rep").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    blocks = weights.select("cluster", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("n") / SHINGLES)).alias("blocks"))
    # The representative's text; where an id has several texts, all of them stand for it.
    texts = slim.filter("doc is not null and text is not null").select(F.col("doc").alias("rep"), "text")
    met = _dealt(clusters, "cluster", blocks).join(texts, "rep")
    links = met.groupBy("cluster", "i", "j").applyInPandas(_linked(n, num, den), "a long, b long")
    final = components(links.union(_same_id(prints)))
    final = final.select(F.col("node").alias("rep"), "label")
    reps = classes.select(F.col("key").alias("k"), "rep")
    out = prints.select("doc", "key", "n").join(reps, F.col("key") == F.col("k"), "left").join(final, "rep", "left")
    component = F.coalesce("label", "rep", "doc")
    return out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNull(), F.lit(None)).otherwise(component).cast("long").alias("component"),
                      F.coalesce(component == F.col("doc"), F.col("key").isNull()).alias("kept"))


def _same_id(prints: DataFrame) -> DataFrame:
    """Links between the class representatives of texts that carry the same id."""
    p = prints.filter("key is not null and doc is not null")
    reps = p.groupBy("key").agg(F.min("doc").alias("rep"))
    several = p.groupBy("doc").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("doc")
    return p.join(several, "doc").join(reps, "key").select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct()
