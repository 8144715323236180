"""Structured Streaming forms of the log, rate, session, dedupe and merge operators.

Each function takes a streaming DataFrame and returns one, or starts a sink. The batch twins are in
``operators``; the same expressions run on both.
"""
from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.windows import best_row
from ..session import staged
from ..sources import manifests


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def audit_stream(events: DataFrame, ts: str, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append events to date folders; the file sink writes each event exactly once."""
    writer = (
        events.withColumn("event_date", F.to_date(ts)).writeStream.format("parquet").outputMode("append")
        .partitionBy("event_date").option("path", target).option("checkpointLocation", checkpoint))
    return writer.trigger(availableNow=True).start() if once else writer.start()


def failure_rate(events: DataFrame, ts: str, kind: str, ok: str, fail: str, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Failed share per tumbling window. On a stream give ``late``, the watermark delay."""
    d = events.withWatermark(ts, late) if late else events
    out = d.groupBy(F.window(ts, window)).agg(
        F.count_if(F.col(kind) == ok).alias("ok"), F.count_if(F.col(kind) == fail).alias("failed"))
    return out.select(F.col("window.start").alias("window_start"), "ok", "failed",
                      F.when(F.col("ok") + F.col("failed") > 0, F.round(F.col("failed") * 100 / (F.col("ok") + F.col("failed")), 1)).alias("fail_rate_pct"))


def sliding_activity(events: DataFrame, ts: str, user: str, window: str = "60 seconds", slide: str = "10 seconds", late: str | None = None) -> DataFrame:
    d = events.withWatermark(ts, late) if late else events
    return d.groupBy(F.window(ts, window, slide), user).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("window.start").alias("window_start"), user, "events")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions by inactivity gap; the session window merges partial sessions before the shuffle."""
    d = events.withWatermark(ts, late) if late else events
    return d.groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("events")).select(
        user, F.col("session_window.start").alias("session_start"), "events")


def stream_dedupe(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class _Ordered(StatefulProcessor):
    """Rows of a key in the order of (time, ident), over all triggers.

    Rows wait in state, cut into slices of event time and there into the Arrow pieces they came in. When the watermark has passed a slice,
    a timer takes it out, puts it in order and runs the rule on it; the rule's own state goes on to the next slice. So neither a key's trigger nor a key
    is ever one frame, only a slice is.
    """

    def __init__(self, key: str, ident: str, value: str, flag: str, slice_ms: int, start, step):
        self.key, self.ident, self.value, self.flag, self.slice_ms, self.start, self.step = key, ident, value, flag, slice_ms, start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "slice bigint, piece int", "body binary")
        self.waiting = handle.getMapState("waiting", "slice bigint", "pieces int")
        self.memory = handle.getValueState("memory", "body binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            at = pdf["at_us"] // (self.slice_ms * 1000)
            for no, part in pdf.groupby(at):
                no = int(no)
                count = self.waiting.getValue((no,))[0] if self.waiting.containsKey((no,)) else 0
                body = pickle.dumps(list(zip(part["at_us"].tolist(), part[self.ident].tolist(), part[self.value].tolist())))
                self.pieces.updateValue((no, count), (body,))
                self.waiting.updateValue((no,), (count + 1,))
                if not count:
                    self.handle.registerTimer((no + 1) * self.slice_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() // self.slice_ms
        # Older slices first, whatever order timers fire in.
        for no in sorted(k[0] for k in self.waiting.keys() if k[0] < due):
            rows = []
            for piece in range(self.waiting.getValue((no,))[0]):
                rows += pickle.loads(self.pieces.getValue((no, piece))[0])
                self.pieces.removeKey((no, piece))
            self.waiting.removeKey((no,))
            rows.sort(key=lambda r: r[:2])
            memory = pickle.loads(self.memory.get()[0]) if self.memory.exists() else self.start
            memory, flags = self.step(memory, [r[0] for r in rows], [r[2] for r in rows])
            self.memory.update((pickle.dumps(memory),))
            yield pd.DataFrame({self.key: [key[0]] * len(rows), self.ident: [r[1] for r in rows], self.flag: flags})

    def close(self) -> None:
        pass


def ordered_rule(
    events: DataFrame, key: str, ts: str, ident: str, value: str, flag: str, start, step, late: str = "10 minutes", slice_seconds: int = 60,
) -> DataFrame:
    """(key, ident, flag) per event of a stream: a rule that is defined row by row, in the order of (time, ident), over all triggers.

    ``step(memory, times, values)`` gives the new memory and a flag for each row of a slice. A row is answered when the watermark has passed
    its slice of ``slice_seconds``; rows later than ``late`` are dropped, as are rows without a time. The state store must
    be the RocksDB one (``spark.sql.streaming.stateStore.providerClass``).
    """
    types = dict(events.dtypes)
    extra = [] if value in (key, ts, ident) else [value]
    d = events.withWatermark(ts, late).filter(F.col(ts).isNotNull()).select(key, ident, *extra, F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))
    return d.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Ordered(key, ident, "at_us" if value == ts else value, flag, slice_seconds * 1000, start, step),
        outputStructType=f"{key} {types[key]}, {ident} {types[ident]}, {flag} boolean", outputMode="append", timeMode="EventTime")


def accepted_rate_limit(events: DataFrame, user: str, ts: str, ident: str, limit: int, seconds: int, late: str = "10 minutes", slice_seconds: int = 60) -> DataFrame:
    """(user, ident, accepted) per event. Accepted-only trailing window: old entries leave, a full window rejects, only accepted ones enter."""
    width = seconds * 1_000_000

    def step(stamps: list[int], times: list[int], _: list) -> tuple[list[int], list[bool]]:
        flags = []
        for t in times:
            stamps = [s for s in stamps if s >= t - width]
            flags.append(len(stamps) < limit)
            if flags[-1]:
                stamps.append(t)
        return stamps, flags

    return ordered_rule(events, user, ts, ident, ts, "accepted", [], step, late, slice_seconds)


def circuit_breaker(rows: DataFrame, brand: str, ts: str, ident: str, failed: str, min_rows: int = 5, threshold: float = 0.50, late: str = "10 minutes", slice_seconds: int = 60) -> DataFrame:
    """(brand, ident, kept): rows stop being kept once the running failed share trips."""
    def step(memory: tuple, _: list[int], fails: list[bool]) -> tuple[tuple, list[bool]]:
        n, bad, open_ = memory
        kept = []
        for f in fails:
            kept.append(open_)
            if open_:
                n, bad = n + 1, bad + int(bool(f))
                open_ = not (n >= min_rows and bad / n > threshold)
        return (n, bad, open_), kept

    return ordered_rule(rows, brand, ts, ident, failed, "kept", (0, 0, True), step, late, slice_seconds)


def _buckets(root: str, content: dict, numbers: list[int]) -> list[str]:
    return [f"{root}/{content['buckets'][str(b)]}/_bucket={b}" for b in numbers if str(b) in content.get("buckets", {})]


def snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of the newest version."""
    _, content = manifests.newest(spark, root)
    paths = _buckets(root, content, [int(b) for b in content.get("buckets", {})])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_batch(
    spark: SparkSession, batch: DataFrame, batch_id: int, key: str, newest: list[Column], root: str, schema: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64, fan_out: Callable[[DataFrame, str], None] | None = None, keep: int = 2,
) -> bool:
    """Merge one batch into the snapshot; False if it is in already.

    The snapshot lies in buckets by the key's hash. Only buckets with a key of the batch are read and written, into a fresh folder; a
    manifest then names a folder for every bucket and the batch it is up to, so that a repeated batch changes nothing. ``fan_out`` gets the
    changed rows. Folders that no bucket needs go with the ``keep``-th manifest after.
    """
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    while True:
        number, content = manifests.newest(spark, root)
        if content and batch_id <= content["batch"]:
            return False
        one = staged(best_row(batch, [key], newest).withColumn("_bucket", bucket))
        # At most one number per bucket comes to the driver.
        touched = sorted(r[0] for r in one.select("_bucket").distinct().collect())
        paths = _buckets(root, content, touched)
        current = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        merged = merge(current, one.select(*[c for c in columns if c in one.columns])).select(*columns)
        name = f"data-{batch_id}-{uuid.uuid4().hex}"
        # A bucket is one file: its rows meet in one task, and no task holds two buckets' worth because there are many.
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{name}")
        made = {str(b): name for b in touched}
        fresh = {"batch": batch_id, "buckets": content.get("buckets", {}) | made, "before": [*content.get("before", []), sorted(set(content.get("buckets", {}).values()))][-keep:]}
        if touched and fan_out:
            after = spark.read.schema(schema).parquet(*_buckets(root, fresh, touched))
            fan_out(after.join(one.select(key), key, "left_semi"), f"{root}/side/batch={batch_id}")
        if manifests.publish(spark, root, number + 1, fresh):
            break
    manifests.sweep(spark, root, {*fresh["buckets"].values(), *[n for old in fresh["before"] for n in old], "side"}, keep + 1)
    return True


def upsert_stream(
    source: DataFrame, key: str, newest: list[Column], root: str, checkpoint: str, schema: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64,
    fan_out: Callable[[DataFrame, str], None] | None = None, once: bool = False, keep: int = 2,
) -> StreamingQuery:
    """Each micro-batch into the bucketed snapshot of :func:`upsert_batch`; read it with :func:`snapshot`."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch.sparkSession, batch, batch_id, key, newest, root, schema, merge, buckets, fan_out, keep)

    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def split_late(source: DataFrame, ts: str, delay_seconds: int, on_time: str, late: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Rows later than the delay behind the newest time of the earlier batches go to a side folder.

    The newest time is kept as one row per batch next to the output, so a restarted driver goes on from it.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        before = None
        if batch_id > 0:
            before = spark.read.schema("newest BIGINT").parquet(f"{on_time}/_state/batch={batch_id - 1}").first()["newest"]
        is_late = F.lit(False) if before is None else us < F.lit(before - delay_seconds * 1_000_000)
        tagged = batch.withColumn("_late", is_late)
        tagged.filter(~F.col("_late")).drop("_late").write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        tagged.filter(F.col("_late")).drop("_late").write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        batch.agg(F.greatest(F.max(us), F.lit(before).cast("long")).alias("newest")).write.mode("overwrite").parquet(
            f"{on_time}/_state/batch={batch_id}")

    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def latest_asof(events: DataFrame, revisions: DataFrame, key: str, ts: str, rev_ts: str, value: str, bucket_seconds: int) -> DataFrame:
    """Value in force at each event: the newest revision at or before it.

    Both sides are cut into time buckets. Inside a bucket the newest earlier revision is a window over
    (key, bucket); a table with one row per key and bucket carries the last value of older buckets.
    """
    def us(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    width = bucket_seconds * 1_000_000
    e = events.withColumns({"_t": us(ts), "_rev": F.lit(None).cast(dict(revisions.dtypes)[value]), "_ord": F.lit(1)})
    r = revisions.select(key, us(rev_ts).alias("_t"), F.col(value).alias("_rev"), F.lit(0).alias("_ord"))
    both = e.unionByName(r, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    ends = both.groupBy(key, "_b").agg(F.max_by("_rev", F.when(F.col("_ord") == 0, F.struct("_t", "_rev"))).alias("_end"))
    before = ends.withColumn("_before", F.last("_end", True).over(
        W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    w = W.partitionBy(key, "_b").orderBy("_t", "_ord", "_rev").rowsBetween(W.unboundedPreceding, 0)
    inner = both.withColumn("_here", F.last("_rev", True).over(w)).filter(F.col("_ord") == 1)
    return inner.join(before, [key, "_b"], "left").select(*events.columns, F.coalesce("_here", "_before").alias(value))
