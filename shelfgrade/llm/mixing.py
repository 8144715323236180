"""Mix sources to target weights by subset-sum budget fitting.

Targets: the sources share the total of all sizes by weight; no target passes ``most`` times its
source's size, and what is above is shared anew by weight. Fitting: every document is taken whole
as often as fits; the remaining budget of a source is filled with further single documents.
Documents are counted by exact length; each length gets its proportional share, rounded down, and
a bounded-knapsack dynamic programme over the lengths closes the gap that is left. Which documents
of a length are taken is decided by a seeded hash.

Scale: only (source, length) counts meet in one task, so the size of a group is the number of
different lengths. Documents of one (source, length) are ranked in hash slices, so a group that
holds a third of all rows is not ranked in one task. The number of sources is assumed to be small
beside the data (they are ordered and shared out in one window).

Defined results: a null text has size 0 and is taken 0 times. A null source is a source of its own
and comes last. Repeated rows are documents of their own. Equal hashes are told apart by id and
otherwise interchangeable. Without any words all targets are 0. An empty table gives an empty
result. Extra columns are kept; one named like a result (``mix_...``) is replaced.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfgrade.llm.common import n_words, packed, unpacked

#: Slices of a (source, length) group.
SLICES = 64


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``(source, size)`` per document to ``(source, source_size, target)`` per source.

    Sources in code point order, null last, take the weights in turn. The shared level ``w * t`` at
    which the targets add up to the total follows from the sources sorted by the ``t`` at which
    each reaches its limit: the first k are at their limit, the rest share what those leave.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    w = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth + 1).cast("int")))
    w = w.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    full = W.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    w = (w.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
         .withColumn("_share", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
         # Sources up to the first that stays below its limit are at their limit.
         .withColumn("_level", F.when(F.col("_limit") >= F.col("_left") * F.col("_w") / F.col("_share"), F.col("_left") / F.col("_share"))))
    level = F.first("_level", ignorenulls=True).over(full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return w.select("source", "source_size", F.least(F.col("_limit"), F.coalesce(level, F.lit(0.0)) * F.col("_w")).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be.

    Every length first gives its proportional share, rounded down. The gap that is left is at most
    the sum of the lengths; long documents close it down to a few times the longest, and a bounded
    knapsack over reachable sums (bits of one integer) closes the rest, one below or above.
    """
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if total == 0 or budget <= 0:
        return taken
    if budget >= total:
        return counts.copy()
    taken = np.floor(counts * (budget / total)).astype(np.int64)
    gap = int(round(budget - int((lengths * taken).sum())))
    order = np.argsort(-lengths, kind="stable")
    # Leave at least twice the longest length to the knapsack, and all of a small source, so that it has room to fit exactly.
    room = max(2 * int(lengths.max()), 1 << 16)
    for i in order:
        if gap <= room:
            break
        more = min(int(counts[i] - taken[i]), (gap - room) // int(lengths[i]))
        if more > 0:
            taken[i] += more
            gap -= more * int(lengths[i])
    cap = gap + int(lengths.max())
    reach, steps, wanted = 1, [], 1 << gap
    inside = (1 << (cap + 1)) - 1
    for i in order[::-1]:
        left, k = int(counts[i] - taken[i]), 1
        while left > 0 and k * int(lengths[i]) <= cap:
            k = min(k, left)
            grown = (reach | (reach << (k * int(lengths[i])))) & inside
            if grown != reach:
                steps.append((i, k, reach))
                reach = grown
            left -= k
            k *= 2
        if reach & wanted:
            break
    below = (reach & ((1 << (gap + 1)) - 1)).bit_length() - 1
    above = reach >> (gap + 1)
    up = gap + 1 + ((above & -above).bit_length() - 1) if above else None
    best = below if up is None or gap - below <= up - gap else up
    for i, k, had in reversed(steps):
        if not (had >> best) & 1:
            taken[i] += k
            best -= k * int(lengths[i])
    return taken


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size").reset_index(drop=True)
    got = fit_counts(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["budget"].iloc[0]))
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "extra": got})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 7, size: Column | None = None) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` (how often each document is taken)."""
    d = packed(docs, F.col(source_col).alias("source"), F.col(id_col).alias("id"), (n_words(F.col(text_col)) if size is None else size).cast("long").alias("size"))
    d = d.withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(SLICES)).cast("int")).withColumn("order", F.xxhash64(F.lit(seed + 1), "id"))
    pieces = d.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    counts = pieces.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(d.select("source", "size"), weights, most)
    # Whole repeats of a source, and what single documents have to add.
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    budgets = plan.select(F.col("source").alias("s"), "budget")
    fitted = (counts.filter("size > 0").join(budgets, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "budget")
              .groupBy("source").applyInPandas(_fit, "source string, size long, extra long"))
    # How many documents of each slice are taken: the slices are filled in order.
    f = fitted.filter("extra > 0").select(F.col("source").alias("fs"), F.col("size").alias("fn"), "extra")
    earlier = W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    quota = (pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
             .join(f, F.col("source").eqNullSafe(F.col("fs")) & (F.col("size") == F.col("fn")))
             .select(F.col("source").alias("qs"), F.col("size").alias("qn"), F.col("slice").alias("qk"), (F.col("extra") - F.col("before")).alias("quota"))
             .filter("quota > 0"))
    rank = F.row_number().over(W.partitionBy("source", "size", "slice").orderBy("order", F.col("id").asc_nulls_last()))
    ranked = d.withColumn("rank", rank)
    ranked = ranked.join(quota, F.col("source").eqNullSafe(F.col("qs")) & (F.col("size") == F.col("qn")) & (F.col("slice") == F.col("qk")), "left")
    p = plan.select(F.col("source").alias("ps"), "source_size", "target", "whole")
    out = ranked.join(p, F.col("source").eqNullSafe(F.col("ps")), "left")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0))
    return unpacked(out, docs.columns, ("mix_size", F.col("size")), ("mix_source_size", F.col("source_size")), ("mix_target", F.col("target")),
                    ("mix_copies", copies.cast("int")))


def taken_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, without the ``mix_`` columns."""
    plain = [c for c in mixed.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]
    repeated = F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy")
    return mixed.filter("mix_copies > 0").select(*plain, repeated).drop("mix_copy")
