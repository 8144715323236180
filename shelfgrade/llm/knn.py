"""Exact top-k search: a Voronoi join with per-group bounds, for the inner product.

Pivots (a bounded sample of the queries) split queries and data into Voronoi cells. One aggregate per side
gives each cell's size, radius and largest norm, another how many different ids of the data it counts: at most ``len(pivots)`` rows. From these follows, for every query
cell Q, a lower bound on the k-th best score of any query in it (enough vectors lie in cells whose worst score is at
least that). A data row x goes to Q only if p_Q.x + r_Q |x|, the most that x can score there, reaches the bound. Each query cell is
solved in blocks: a block of queries meets a slice of the data that was sent to the cell, keeps the k best per query, and the
slices' bests are merged. Blocks and slices bound what meets in one task, whatever a cell's size.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids. Scores are
exact: sums below 2**53 in floating point, others in Python integers, cut to 64 bits. Shorter vectors count as filled
with zeros. Rows that carry the query's id are the query's own. Repeated data rows appear once for each
row. Equal scores go to the smaller id. With fewer than k others all are returned; alone, a query gives no row. An empty table gives none.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Queries per cell aimed at, most pivots, queries in a block, data rows in a slice.
PER_CELL, MOST_PIVOTS, QUERY_BLOCK, SLICE = 256, 256, 1024, 16384


def whole_vector(v: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component as doubles; null if the vector is unusable."""
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("double"))
    big = F.transform(v, lambda c: c.cast("double") * F.lit(scale))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    # floor() goes through 64-bit integers; a value beyond them has no fraction.
    safe = F.zip_with(x, big, lambda a, b: F.when(F.abs(b) < F.lit(2.0**62), a).otherwise(b))
    return F.when(v.isNotNull() & fine, safe)


def _matrix(vs, dim: int) -> np.ndarray:
    out = np.zeros((len(vs), dim))
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _assign(pivots: np.ndarray):
    half = (pivots**2).sum(axis=1) / 2

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = _matrix(pdf["v"], pivots.shape[1])
                cell = (x @ pivots.T - half).argmax(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": cell, "radius": np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)), "norm": np.sqrt((x**2).sum(axis=1))})

    return run


def lower_bounds(pivots: np.ndarray, q: pd.DataFrame, d: pd.DataFrame, k: int) -> np.ndarray:
    """For each query cell a score that at least ``k`` rows of other ids than the query's reach.

    ``ids`` counts each id of the data in one cell, so only one of the counted rows can be the query's own.
    """
    norms = np.sqrt((pivots**2).sum(axis=1))
    out = np.full(len(pivots), -np.inf)
    cells, counts, radii = d["cell"].to_numpy(), d["ids"].to_numpy(), d["radius"].to_numpy()
    for c, r in zip(q["cell"], q["radius"]):
        least = pivots[cells] @ pivots[c] - norms[c] * radii - r * norms[cells] - r * radii
        order = np.argsort(-least)
        enough = np.flatnonzero(np.cumsum(counts[order]) > k)
        if len(enough):
            b = least[order[enough[0]]]
            out[c] = b - 1e-9 * (abs(b) + (norms[c] + r) * (norms.max() + radii.max()))
    return out


def _send(pivots: np.ndarray, radius: np.ndarray, bound: np.ndarray, blocks: np.ndarray, slices: int):
    """Each data row to every block of every query cell where it may count."""
    used = np.flatnonzero(blocks)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at: at + 1024]
                x = _matrix(part["v"], pivots.shape[1])
                norm = np.sqrt((x**2).sum(axis=1))[:, None]
                most = x @ pivots[used].T + radius[used] * norm
                row, col = np.nonzero(most + 1e-9 * (np.abs(most) + norm * radius[used]) >= bound[used])
                cell = used[col]
                many = blocks[cell]
                row, cell = np.repeat(row, many), np.repeat(cell, many)
                first = np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else np.empty(0, np.int64)
                block = np.arange(len(row)) - np.repeat(first, many)
                yield pd.DataFrame({"cell": cell, "block": block, "slice": part["slice"].to_numpy()[row], "id": part["id"].to_numpy()[row], "v": part["v"].to_numpy()[row]})

    return run


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    a, b = [[int(t) for t in r] for r in q], [[int(t) for t in r] for r in x]
    lo, hi = -(1 << 63), (1 << 63) - 1
    return np.array([[max(lo, min(hi, sum(s * t for s, t in zip(r, c)))) for c in b] for r in a], np.int64).reshape(len(a), len(b))


def _solve(k: int, dim: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        qs, ids, scores = [], [], []
        if len(left) and len(right):
            x, own = _matrix(right["v"], dim), right["id"].to_numpy(np.int64)
            for at in range(0, len(left), 64):
                part = left.iloc[at: at + 64]
                s = exact_scores(_matrix(part["v"], dim), x)
                for qid, row in zip(part["id"], s):
                    other = np.flatnonzero(own != qid)
                    r = row[other]
                    if len(r) > k:
                        keep = r >= -np.partition(-r, k - 1)[k - 1]
                        other, r = other[keep], r[keep]
                    order = np.lexsort((own[other], -r))[:k]
                    qs.append(np.full(len(order), qid, np.int64))
                    ids.append(own[other[order]])
                    scores.append(r[order])
        cat = lambda a: np.concatenate(a) if a else np.empty(0, np.int64)
        return pd.DataFrame({"query_id": cat(qs), "vec_id": cat(ids), "score": cat(scores)})

    return run


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "v", seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best inner products of each query row with rows of other ids.

    Both inputs have an id and an array of whole numbers as doubles (see ``whole_vector``).
    """
    d = data.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    # A query is its id: repeated rows of one id and vector are asked once.
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null").distinct()
    facts = d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n_queries = q.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n_queries or not facts["n"]:
        return data.sparkSession.createDataFrame([], schema)
    want = min(MOST_PIVOTS, ceil(n_queries / PER_CELL))
    picked = q.select("v", F.xxhash64(F.lit(seed), "id").alias("h"), "id").orderBy("h", "id").limit(want).toPandas()
    dim = max(int(facts["dim"]), int(picked["v"].map(len).max()))
    pivots = _matrix(picked["v"], dim)
    kind = "id long, v array<double>, cell long, radius double, norm double"
    qa, da = q.mapInPandas(_assign(pivots), kind), d.mapInPandas(_assign(pivots), kind)

    def summary(x: DataFrame) -> pd.DataFrame:
        return x.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).toPandas()

    qs, ds = summary(qa), summary(da)
    # An id's rows may lie in several cells; it counts in the first of them only.
    ids = da.groupBy("id").agg(F.min("cell").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("ids")).toPandas()
    ds = ds.merge(ids, "left", "cell").fillna({"ids": 0})
    bound = lower_bounds(pivots, qs, ds, k)
    radius, blocks = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    radius[qs["cell"]] = qs["radius"]
    blocks[qs["cell"]] = np.ceil(qs["n"] / QUERY_BLOCK).astype(np.int64)
    slices = ceil(facts["n"] / SLICE)
    # Slices are dealt by row, not by id or vector: neither a repeated id nor a repeated vector fills one.
    dealt = d.withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(slices)).cast("long"))
    sent = dealt.mapInPandas(_send(pivots, radius, bound, blocks, slices), "cell long, block long, slice long, id long, v array<double>")
    many = F.element_at(F.array(*[F.lit(int(max(1, b))) for b in blocks]), (F.col("cell") + 1).cast("int"))
    asked = qa.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), many).cast("long")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))).select("cell", "block", "slice", "id", "v")
    near = asked.groupBy("cell", "block", "slice").cogroup(sent.groupBy("cell", "block", "slice")).applyInPandas(
        _solve(k, dim), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
