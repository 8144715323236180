"""Window operators that stay even when one key holds a large share of the rows.

Three devices:

* "best row per group" is ``max_by`` over a struct, so each map task keeps one row per key before
  the shuffle;
* "top k per group" is ``row_number() <= k``, which Spark cuts to k rows per task before the shuffle
  (WindowGroupLimit);
* running sums, ranks, lags and trailing counts run inside (key, chunk) pieces. A chunk is a coarse
  form of the ordering column. One row per piece carries the state across pieces.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Chunks in a group of chunks, where one sequence runs over a whole table.
FAN = 1024


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group under ``order``.

    Ascending order on plain comparable columns is expressed by ``min_by``; pass negated numbers for
    descending parts. The last order column should make the order total.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return picked.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _offsets(pieces: DataFrame, keys: Sequence[str], chunk: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier chunks of each key."""
    w = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    return pieces.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0))).drop(value)


def _global_offsets(pieces: DataFrame, chunk: str, value: str, out: str) -> DataFrame:
    """The same over one sequence: the groups of chunks in ``_group`` run side by side, and only one row per group meets in one task."""
    p = pieces
    groups = _offsets(p.groupBy("_group").agg(F.sum(value).alias("_sum")), [], "_group", "_sum", "_earlier")
    inner = _offsets(p, ["_group"], chunk, value, "_inner")
    return inner.join(groups, "_group").withColumn(out, F.col("_earlier") + F.col("_inner")).drop("_group", "_earlier", "_inner")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, value: Column, out: str,
    include_current: bool = True, group: Column | None = None,
) -> DataFrame:
    """Running total per key, or over everything without keys. ``chunk`` must not decrease along ``order``.

    Without keys, ``group`` cuts the chunks into groups and must not decrease either; by default ``FAN`` numbered chunks make one.
    """
    d = df.withColumns({"_chunk": chunk, "_val": value})
    if not keys:
        d = d.withColumn("_group", F.floor(F.col("_chunk") / FAN) if group is None else group)
    totals = d.groupBy(*keys or ["_group"], "_chunk").agg(F.sum("_val").alias("_tot"))
    before = _offsets(totals, keys, "_chunk", "_tot", "_before") if keys else _global_offsets(totals, "_chunk", "_tot", "_before")
    d = d if keys else d.drop("_group")
    w = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    joined = d.join(before, [*keys, "_chunk"])
    total = F.coalesce(F.sum("_val").over(w), F.lit(0)) + F.col("_before")
    return joined.withColumn(out, total).drop("_chunk", "_val", "_before")


def numbered(df: DataFrame, key: str, order: Sequence[Column], coarse: Column) -> DataFrame:
    """Adds ``n`` (rows of the key) and ``idx`` (0-based rank under ``order``).

    Every key is cut by ``coarse`` (a whole number that does not decrease along the order; nulls first), so no task ranks
    an unbounded group. One table of pieces gives both the key's size and the rows before a piece.
    """
    d = df.withColumn("_chunk", F.coalesce(coarse.cast("long"), F.lit(-(1 << 62))))
    all_pieces, earlier = W.partitionBy(key), W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    pieces = d.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_tot"))
    pieces = pieces.select(key, "_chunk", F.sum("_tot").over(all_pieces).alias("n"), F.coalesce(F.sum("_tot").over(earlier), F.lit(0)).alias("_before"))
    w = W.partitionBy(key, "_chunk").orderBy(*order)
    return d.join(pieces, [key, "_chunk"]).withColumn("idx", F.row_number().over(w) - 1 + F.col("_before")).drop("_chunk", "_before")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, chunk: Column, value: str, out: str
) -> DataFrame:
    """``lag(value)`` per key across chunks of the ordering column; equal places go by value, so that reruns agree."""
    d = df.withColumn("_chunk", chunk)
    ends = d.groupBy(*keys, "_chunk").agg(F.max_by(value, F.struct(order, value)).alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
    w = W.partitionBy(*keys, "_chunk").orderBy(order, value)
    inner = d.withColumns({"_prev": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    return (
        inner.join(carried, [*keys, "_chunk"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev")))
        .drop("_chunk", "_prev", "_first", "_carried")
    )


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, out: str = "in_window") -> DataFrame:
    """Rows of the same key in the closed window [ts - seconds, ts].

    Each row goes to its own time bucket and, as context only, to the next one, so that a bucket
    holds all a row can see and no task holds a whole key.
    """
    micros = F.unix_micros(F.col(ts))
    width = seconds * 1_000_000
    d = df.withColumns({"_us": micros, "_slot": F.floor(micros / width)})
    d = d.withColumn("_b", F.explode(F.array("_slot", F.col("_slot") + 1)))
    w = W.partitionBy(*keys, "_b").orderBy("_us").rangeBetween(-width, 0)
    return (
        d.withColumn(out, F.count(F.lit(1)).over(w)).filter(F.col("_b") == F.col("_slot")).drop("_us", "_slot", "_b")
    )


# --- named operators ------------------------------------------------------------------------

def variant_score(status: Column, has_list: Column, url: Column, price: Column, description: Column, image: Column) -> Column:
    """Richness of a row: verified 1000, list 500, product URL 200, price 100, description 50, image 25."""
    def points(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    return (
        points(status == "verified_inci", 1000) + points(has_list, 500) + points(F.lower(url).contains("/produto"), 200)
        + points(price.isNotNull(), 100) + points(description.isNotNull(), 50) + points(image.isNotNull(), 25)
    )


def dedupe_variants(df: DataFrame, brand: str, name: str, size: str, score: Column, created: str, key: str) -> DataFrame:
    """The richest row of each (brand, name, size); earlier, then smaller key, on ties."""
    d = df.withColumns({"_size": F.coalesce(F.col(size), F.lit("")), "_score": -score})
    kept = best_row(d, [brand, name, "_size"], [F.col("_score"), F.col(created), F.col(key)])
    return kept.withColumn("richness", -F.col("_score")).select(*df.columns, "richness")


def dedupe_review(queue: DataFrame, product: str, field: str, created: str, key: str) -> DataFrame:
    """Newest pending item per (product, field) stays pending, older ones are superseded."""
    pending = queue.filter(F.col("status") == "pending")
    newest = pending.groupBy(product, field).agg(F.max_by(key, F.struct(created, key)).alias("_keep"))
    marked = queue.join(newest, [product, field], "left")
    old = (F.col("status") == "pending") & (F.col(key) != F.col("_keep"))
    return marked.withColumn("status", F.when(old, F.lit("superseded")).otherwise(F.col("status"))).drop("_keep")


def latest_by(df: DataFrame, key: str, value: str, when: str, tie: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(when, tie)).alias(value))


def fill_from_evidence(products: DataFrame, evidence: DataFrame, key: str, target: str) -> DataFrame:
    """Empty targets take the newest evidence text."""
    newest = evidence.groupBy(key).agg(F.max_by("raw_source_text", F.struct("extracted_at", "evidence_id")).alias("_text"))
    empty = F.coalesce(F.trim(F.col(target)) == "", F.lit(True))
    return products.join(newest, key, "left").withColumn(
        target, F.when(empty, F.coalesce("_text", target)).otherwise(F.col(target))).drop("_text")


def fill_first_image(products: DataFrame, images: DataFrame, key: str, target: str, gallery: str) -> DataFrame:
    """Missing image: the lowest-position image row, else the first of the gallery."""
    first = images.groupBy(key).agg(F.min_by("url", F.struct("position", "url")).alias("_img"))
    return products.join(first, key, "left").withColumn(
        target, F.coalesce(F.col(target), F.col("_img"), F.try_element_at(F.col(gallery), F.lit(1)))).drop("_img")


def first_per_field(sections: DataFrame, page: str, field: str, pos: str, content: str) -> DataFrame:
    return sections.groupBy(page, field).agg(F.min_by(content, pos).alias(content))


def stop_the_line(
    runs: DataFrame, brand: str, seq: str, failed: Column, min_rows: int = 5, threshold: float = 0.50, chunk_rows: int = 100_000
) -> DataFrame:
    """Rows up to and including the first row where, from ``min_rows`` on, the failed share is above the threshold.

    ``seq`` numbers the rows of a brand from 1, so the running row count is the number itself.
    """
    marked = running_sum(
        runs, [brand], [F.col(seq)], F.floor(F.col(seq) / chunk_rows), failed.cast("long"), "failures")
    tripped = (F.col(seq) >= min_rows) & (F.col("failures") / F.col(seq) > threshold)
    cut = marked.filter(tripped).groupBy(brand).agg(F.min(seq).alias("_cut"))
    return (
        marked.join(cut, brand, "left")
        .filter(F.col("_cut").isNull() | (F.col(seq) <= F.col("_cut")))
        .withColumn("stopped", F.col("_cut").isNotNull()).drop("_cut")
    )


def rate_limit_flags(events: DataFrame, user: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """Adds ``in_window`` and ``limited``: more than ``limit`` attempts in the trailing window."""
    return trailing_count(events, [user], ts, seconds).withColumn("limited", F.col("in_window") > limit)


def budget_cut(work: DataFrame, order: Sequence[Column], cost: Column, budget: int, chunk: Column, group: Column | None = None) -> DataFrame:
    """Work items whose start falls inside the global budget, in priority order; ``group`` as in ``running_sum``."""
    spent = running_sum(work, [], order, chunk, cost, "spent_before", include_current=False, group=group)
    return spent.filter(F.col("spent_before") < budget)


def list_dedupe_positions(bridge: DataFrame, product: str, entity: str, position: str, raw: str) -> DataFrame:
    """One row per (product, entity): the first occurrence, at its own position."""
    return bridge.groupBy(product, entity).agg(
        F.min(position).alias(position), F.min_by(raw, F.struct(position, raw)).alias(raw))


def fill_down(rows: DataFrame, order: str, value: str, chunk: Column) -> DataFrame:
    """Carry the last non-null value down.

    Chunks of the order column carry theirs over, within groups of ``FAN`` chunks and then from group to group.
    """
    d = rows.withColumn("_chunk", chunk)
    ends = d.groupBy("_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    ends = ends.withColumn("_group", F.floor(F.col("_chunk") / FAN))
    groups = ends.groupBy("_group").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_chunk"))).alias("_end"))
    groups = groups.select("_group", F.last("_end", True).over(W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"))
    inner = F.last("_last", True).over(W.partitionBy("_group").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.withColumn("_inner", inner).join(groups, "_group").select("_chunk", F.coalesce("_inner", "_earlier").alias("_carried"))
    w = W.partitionBy("_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        d.withColumn("_here", F.last(value, True).over(w)).join(carried, "_chunk", "left")
        .withColumn(value, F.coalesce("_here", "_carried")).drop("_chunk", "_here", "_carried")
    )


def pick_master(entities: DataFrame, group: str, curated: Column, usage: str, name: str, key: str) -> DataFrame:
    """Master of each group: a curated name, else most used, else shortest name, else smallest key."""
    order = F.struct(F.when(curated, 0).otherwise(1), -F.col(usage), F.length(name), F.col(key))
    return entities.groupBy(group).agg(F.min_by(key, order).alias("master_id"), F.count(F.lit(1)).alias("members"))


def last_turns(messages: DataFrame, thread: str, turn: str, n: int) -> DataFrame:
    """The most recent 2n messages of each thread, in chronological order."""
    kept = top_k(messages, [thread], [F.col(turn).desc()], 2 * n, "_rank").drop("_rank")
    return kept.orderBy(thread, turn)


def last_user_message(messages: DataFrame, thread: str, turn: str, role: str, text: str, who: str = "user") -> DataFrame:
    return messages.filter(F.col(role) == who).groupBy(thread).agg(
        F.max_by(text, turn).alias("last_message"), F.max(turn).alias("last_turn"))


def conversation_title(messages: DataFrame, thread: str, turn: str, role: str, text: str, chars: int = 80) -> DataFrame:
    return messages.filter(F.col(role) == "user").groupBy(thread).agg(
        F.left(F.min_by(text, turn), F.lit(chars)).alias("title"))


def url_priority_wave(queue: DataFrame, bucket: str, slug: str, size: int) -> DataFrame:
    """Next wave: buckets in order, slugs in order, cut to ``size``, each with its rank in the bucket."""
    cut = queue.orderBy(bucket, slug).limit(size)
    return cut.withColumn("rank_in_bucket", F.row_number().over(W.partitionBy(bucket).orderBy(slug)))
