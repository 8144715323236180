"""URL filter: rules first, then the ratio of two character language models.

Rules are ``(verdict, host, path)``. A rule fits its host and all subdomains of it, if the URL's path
starts with the rule's path; the longest fitting rule decides. URLs that no rule decides are judged
by two smoothed variable-order Markov models over UTF-8 bytes, one counted on accepted, one on
rejected URLs. Each model mixes orders 0 to ``ORDER``: p_k = (n(context, c) + p_(k-1)) / (n(context) + 1).
The score is the difference of log-likelihoods per byte, calibrated on URLs kept out of the counts.

All labelled URLs are counted, none is sampled, and every context and symbol has its own count. A position is the number of its
last ``ORDER`` + 1 symbols (a gram), which names the contexts and symbols of all orders at once. The grams of all distinct URLs
are a table that grows with the input: workers add up their batches, one aggregate adds these. Its sums over shorter ends
are the lower orders, and a chain of joins, in which no key has more than 258 rows, gives each gram its log ratio. URLs are scored in
chunks of ``URLS`` or ``BYTES``: a chunk meets the log ratios of its own distinct grams only, so a gram that all URLs hold is sent once a chunk.
``train`` and ``Models`` are another, approximate form with hashed cells in one object; the filter does not use them.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
scored as its text (null: the empty text). Without accepted or without rejected URLs there is no
model: the score is 0 and the verdict is allow. Repeated rows count each time and get equal verdicts. Very long URLs are
scored whole. Extra columns are kept; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfgrade.llm.common import ascii_lower, cut, packed, unpacked

ORDER, CELLS, STEP, EDGE = 4, 1 << 19, 0.01, 10.0
#: Predicted positions handled at once.
BLOCK = 1 << 16
#: Distinct URLs, and bytes of them, that are scored together on average; bits of a symbol in a gram.
URLS, BYTES, BITS = 4096, 1 << 20, 9
#: Uniform probability under order 0: 256 byte values and the end.
FLAT = 1 / 257


def url_parts(url: Column) -> Column:
    """Struct ``(host, path)``; both empty for null and for text without ``://``."""
    tail = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    tail = F.coalesce(tail, F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    return F.struct(ascii_lower(host).alias("host"), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, else null. The first of equally long rules wins."""
    out = F.lit(None)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _cells(url: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells of every predicted position (the bytes and the end) and order: with the symbol, and of the context alone."""
    raw = np.frombuffer((url or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64) + np.uint64(2)
    s = np.concatenate([np.zeros(ORDER, np.uint64), raw, np.ones(1, np.uint64)])
    n = len(s) - ORDER
    context = np.full(n, 0x51ED270B, np.uint64)
    with_symbol, alone = np.empty((ORDER + 1, n), np.int64), np.empty((ORDER + 1, n), np.int64)
    shift = np.uint64(64 - CELLS.bit_length() + 1)
    for k in range(ORDER + 1):
        if k:
            context = (context + s[ORDER - k: ORDER - k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            context ^= context >> np.uint64(29)
        alone[k] = ((context * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64)
        own = (context ^ ((s[ORDER:] + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x94D049BB133111EB)
        own ^= own >> np.uint64(32)
        with_symbol[k] = ((own * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    return with_symbol, alone


@dataclass
class Models:
    """Counts of ``(context, symbol)`` and ``context`` cells for accepted (0) and rejected (1); logistic calibration of the score."""

    symbols: np.ndarray
    contexts: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    usable: bool = True

    def score(self, url: str | None) -> float:
        if not self.usable:
            return 0.0
        cells, alone = _cells(url)
        total = [0.0, 0.0]
        for side in (0, 1):
            for at in range(0, cells.shape[1], BLOCK):
                p = np.full(min(BLOCK, cells.shape[1] - at), FLAT)
                for k in range(ORDER + 1):
                    p = (self.symbols[side][cells[k, at: at + BLOCK]] + p) / (np.maximum(self.contexts[side][alone[k, at: at + BLOCK]], 0) + 1)
                # Hashed cells may collide, so a value can pass 1.
                total[side] += float(np.log(np.minimum(p, 1.0)).sum())
        return (total[0] - total[1]) / cells.shape[1]

    def allows(self, score: float) -> bool:
        return self.slope * score + self.offset >= 0


def _count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    symbols, contexts = np.zeros((2, CELLS), np.int64), np.zeros((2, CELLS), np.int64)
    for pdf in it:
        for url, ok in zip(pdf["url"], pdf["accepted"]):
            cells, alone = _cells(url)
            np.add.at(symbols[0 if ok else 1], cells.ravel(), 1)
            np.add.at(contexts[0 if ok else 1], alone.ravel(), 1)
    at = np.flatnonzero(symbols.any(axis=0) | contexts.any(axis=0))
    yield pd.DataFrame({"cell": at, "s0": symbols[0][at], "s1": symbols[1][at], "c0": contexts[0][at], "c1": contexts[1][at]})


def _binned(models: Models):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            s = np.array([models.score(u) for u in pdf["url"]], float)
            yield pd.DataFrame({"bin": np.round(np.clip(s, -EDGE, EDGE) / STEP).astype(np.int64), "accepted": pdf["accepted"]})

    return run


def train(labelled: DataFrame, url_col: str = "url", accepted_col: str = "accepted", seed: int = 3) -> Models:
    """Models from rows with a URL and a boolean. A fifth, by hash of the URL, calibrates. Null labels are left out."""
    rows = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(accepted_col).alias("accepted")).filter("accepted is not null")
    aside = F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(5)) == 0
    counted = rows.filter(~aside).mapInPandas(_count, "cell long, s0 long, s1 long, c0 long, c1 long")
    cells = counted.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "c0", "c1")]).toPandas()
    symbols, contexts = np.zeros((2, CELLS), np.float32), np.zeros((2, CELLS), np.float32)
    at = cells["cell"].to_numpy(np.int64)
    for side in (0, 1):
        symbols[side][at], contexts[side][at] = cells[f"s{side}"].to_numpy(np.float32), cells[f"c{side}"].to_numpy(np.float32)
    models = Models(symbols, contexts)
    models.usable = bool(symbols[0].any() and symbols[1].any())
    if models.usable:
        bins = rows.filter(aside).mapInPandas(_binned(models), "bin long, accepted boolean").groupBy("bin", "accepted").count().toPandas()
        models.slope, models.offset = calibrate(bins["bin"].to_numpy(float) * STEP, bins["accepted"].to_numpy(bool), bins["count"].to_numpy(float))
    return models


def calibrate(score: np.ndarray, accepted: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of acceptance on the score, both classes with equal weight. A weak prior at slope 1 keeps separable data finite."""
    if not accepted.any() or accepted.all():
        return 1.0, 0.0
    w = np.where(accepted, weight / weight[accepted].sum(), weight / weight[~accepted].sum()) / 2
    theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    x, y = np.stack([score, np.ones_like(score)], axis=1), accepted.astype(float)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 1e-3 * (theta - prior)
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def grams(url: str) -> np.ndarray:
    """The last ``ORDER`` + 1 symbols at every predicted position, the newest in the lowest bits: start 0, end 1, bytes from 2."""
    raw = np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) + 2
    s = np.concatenate([np.zeros(ORDER, np.int64), raw, np.ones(1, np.int64)])
    out = np.zeros(len(s) - ORDER, np.int64)
    for k in range(ORDER + 1):
        out = out << BITS | s[k: k + len(out)]
    return out


def _gram_counts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Grams of distinct URLs, with the rows that count for the accepted (``n0``) and the rejected (``n1``); 0 for URLs that do not count."""
    def added(held: list[tuple[np.ndarray, int, int]]) -> pd.DataFrame:
        gram, at = np.unique(np.concatenate([g for g, _, _ in held]), return_inverse=True)
        out = {"gram": gram}
        for side in (1, 2):
            n = np.zeros(len(gram), np.int64)
            np.add.at(n, at, np.repeat([h[side] for h in held], [len(h[0]) for h in held]))
            out[f"n{side - 1}"] = n
        return pd.DataFrame(out)

    for pdf in it:
        held, size = [], 0
        for url, n0, n1 in zip(pdf["text"], pdf["n0"], pdf["n1"]):
            held.append((grams(url), n0, n1))
            size += len(held[-1][0])
            if size > BYTES:
                yield added(held)
                held, size = [], 0
        if held:
            yield added(held)


def gram_values(counts: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """``(gram, value)``: the log ratio of the two models' probabilities, from ``(gram, n0, n1)`` with distinct grams."""
    end = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << BITS * k) - 1))
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    p = counts.groupBy(end("gram", 1).alias("key")).agg(*sums)
    p = p.select("key", *[((F.col(f"n{i}") + F.lit(FLAT)) / F.lit(totals[i] + 1.0)).alias(f"p{i}") for i in (0, 1)])
    for k in range(1, ORDER + 1):
        own = counts.groupBy(end("gram", k + 1).alias("key")).agg(*sums) if k < ORDER else counts.withColumnRenamed("gram", "key")
        own = own.select("key", "n0", "n1", F.shiftright("key", BITS).alias("context"), end("key", k).alias("shorter"))
        contexts = own.groupBy("context").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
        shorter = p.select(F.col("key").alias("shorter"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        p = own.join(contexts, "context").join(shorter, "shorter").select(
            "key", *[((F.col(f"n{i}") + F.col(f"q{i}")) / (F.col(f"c{i}") + F.lit(1.0))).alias(f"p{i}") for i in (0, 1)])
    return p.select(F.col("key").alias("gram"), (F.log("p0") - F.log("p1")).alias("value"))


def _chunk_grams(pdf: pd.DataFrame) -> pd.DataFrame:
    own = np.unique(np.concatenate([grams(u) for u in pdf["text"]]))
    return pd.DataFrame({"chunk": np.full(len(own), pdf["chunk"].iloc[0]), "gram": own})


def _chunk_scores(pdf: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    order = np.argsort(values["gram"].to_numpy())
    gram, value = values["gram"].to_numpy()[order], values["value"].to_numpy()[order]
    return pdf.drop(columns="chunk").assign(score=[float(value[np.searchsorted(gram, grams(u))].mean()) for u in pdf["text"]])


def scored(urls: DataFrame, seed: int = 3) -> tuple[DataFrame, float, float]:
    """``urls`` with their scores, and the calibration's slope and offset.

    ``urls``: distinct non-null ``text``, ``n`` rows of it, ``host``, ``path``, and ``rule`` and ``found`` (the rule's verdict) or nulls.
    """
    aside = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(5)) == 0
    weight = lambda ok: F.when(F.col("found").isNotNull() & ~aside & ((F.col("found") == "allow") == F.lit(ok)), F.col("n")).otherwise(0)
    size = urls.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(weight(True)).alias("n0"), F.sum(weight(False)).alias("n1")).first()
    if not size["n0"] or not size["n1"]:
        return urls.withColumn("score", F.lit(0.0)), 1.0, 0.0
    counted = urls.select("text", weight(True).cast("long").alias("n0"), weight(False).cast("long").alias("n1")).mapInPandas(_gram_counts, "gram long, n0 long, n1 long")
    counts = cut(counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    totals = counts.agg(F.sum("n0"), F.sum("n1")).first()
    chunks = max(ceil(size["n"] / URLS), ceil(size["bytes"] / BYTES))
    dealt = urls.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.lit(chunks)).cast("long"))
    wanted = dealt.select("chunk", "text").groupBy("chunk").applyInPandas(_chunk_grams, "chunk long, gram long")
    values = wanted.join(gram_values(counts, (totals[0], totals[1])), "gram")
    out = dealt.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInPandas(
        _chunk_scores, "text string, n long, host string, path string, rule string, found string, score double")
    out = cut(out)
    edge = F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col("score")))
    bins = out.filter(aside & F.col("found").isNotNull()).groupBy(F.round(edge / F.lit(STEP)).cast("long").alias("bin"), (F.col("found") == "allow").alias("accepted")).agg(
        F.sum("n").alias("n")).orderBy("bin", "accepted").toPandas()
    return out, *calibrate(bins["bin"].to_numpy(float) * STEP, bins["accepted"].to_numpy(bool), bins["n"].to_numpy(float))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with struct ``url_verdict``: host, path, rule, verdict, score. What the rules decide trains the models."""
    rows = packed(pages, F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("text"))
    urls = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", url_parts(F.col("text")))
    urls = urls.withColumn("by", rule_of(F.col("parts.host"), F.col("parts.path"), rules).cast("struct<rule:string,verdict:string>"))
    urls = cut(urls.select("text", "n", "parts.host", "parts.path", "by.rule", F.col("by.verdict").alias("found")))
    judged, slope, offset = scored(urls)
    verdict = F.coalesce("found", F.when(F.col("score") * F.lit(slope) + F.lit(offset) >= 0, "allow").otherwise("block"))
    judged = judged.select("text", F.struct("host", "path", "rule", verdict.alias("verdict"), "score").alias("judged"))
    return unpacked(rows.join(judged, "text"), pages.columns, ("url_verdict", F.col("judged")))
