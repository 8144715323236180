"""Streams replayed to the end give what the batch twins give."""
import datetime as dt
import os
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfgrade.operators import merges as J
from shelfgrade.operators import windows as W
from shelfgrade.streaming import streams as K

SCHEMA = "event_id BIGINT, user_id STRING, kind STRING, ts TIMESTAMP, failed BOOLEAN"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    out = [(i, "hot" if i % 3 else f"u{i % 7}", ["ok", "fail", "view"][i % 3], T0 + dt.timedelta(seconds=7 * i), i % 5 in (1, 2, 3)) for i in range(400)]
    return out


@pytest.fixture(scope="module")
def source(spark, rows):
    path = tempfile.mkdtemp(prefix="events-")
    df = spark.createDataFrame(rows, SCHEMA)
    for i in range(4):
        df.filter((F.col("event_id") >= i * 100) & (F.col("event_id") < (i + 1) * 100)).coalesce(1).write.mode("append").parquet(path)
    return path


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="ck-")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(map(tuple, spark.table(name).collect()))


def stream(spark, source, per_trigger=1000):
    return K.read_stream(spark, source, SCHEMA, per_trigger)


def test_windows_match_batch(spark, source, rows):
    batch = spark.createDataFrame(rows, SCHEMA)
    pairs = [
        ("rate", lambda d, late: K.failure_rate(d, "ts", "kind", "ok", "fail", "10 minutes", late)),
        ("slide", lambda d, late: K.sliding_activity(d, "ts", "user_id", late=late)),
        ("sess", lambda d, late: K.sessions(d, "ts", "user_id", "30 seconds", late=late))]
    for name, fn in pairs:
        mode = "append" if name == "sess" else "complete"
        src = stream(spark, source, 1 if mode == "append" else 1000)
        got = run(fn(src, "1 minute" if mode == "append" else None), spark, name, mode)
        want = sorted(map(tuple, fn(batch, None).collect()))
        if mode == "complete":
            assert got == want
        else:
            assert got and set(got) <= set(want)


def test_audit_stream_appends_once(spark, source, rows):
    out, ck = tempfile.mkdtemp(prefix="audit-"), tempfile.mkdtemp(prefix="ck-")
    for _ in range(2):
        K.audit_stream(stream(spark, source), "ts", out, ck, once=True).awaitTermination(120)
    assert spark.read.parquet(out).count() == len(rows)


def test_dedupe(spark, source, rows):
    d = K.stream_dedupe(stream(spark, source), "ts", ["user_id", "kind"], "1 day").select("user_id", "kind")
    got = run(d, spark, "dedupe")
    assert got == sorted(set(got)) and set(got) == {(u, k) for _, u, k, _, _ in rows}


@pytest.fixture(scope="module")
def rocks(spark):
    """Python state with timers lives in the RocksDB store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def shuffled(spark, rows):
    """The rows mixed over four triggers, then a row that moves the watermark past all of them."""
    path, mixed = tempfile.mkdtemp(prefix="mixed-"), list(rows)
    random.Random(5).shuffle(mixed)
    flush = (10_000, "flush", "view", T0 + dt.timedelta(days=1), False)
    for i, part in enumerate([mixed[k::4] for k in range(4)] + [[flush], [(10_001, "flush", "view", T0 + dt.timedelta(days=2), False)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/part-{i}")
        for f in Path(f"{path}/part-{i}").glob("part-*"):
            os.utime(f.rename(f"{path}/{i:02d}-{f.name}"), (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def sequential(rows):
    limited, kept, logs, state = {}, {}, {}, {}
    for ident, user, _k, ts, failed in rows:
        log = [t for t in logs.get(user, []) if t >= ts - dt.timedelta(seconds=60)]
        limited[ident] = len(log) < 3
        logs[user] = log + [ts] if limited[ident] else log
        n, bad, is_open = state.get(user, (0, 0, True))
        kept[ident] = is_open
        if is_open:
            n, bad = n + 1, bad + failed
            is_open = not (n >= 5 and bad / n > 0.5)
        state[user] = (n, bad, is_open)
    return limited, kept


def test_rules_follow_event_time_over_triggers(spark, rocks, shuffled, rows):
    limited, kept = sequential(rows)
    src = stream(spark, shuffled, 1)
    got = run(K.accepted_rate_limit(src, "user_id", "ts", "event_id", 3, 60, late="1 day", slice_seconds=300), spark, "limit")
    assert {r[1]: r[2] for r in got if r[0] != "flush"} == limited
    got = run(K.circuit_breaker(src, "user_id", "ts", "event_id", "failed", late="1 day", slice_seconds=300), spark, "breaker")
    assert {r[1]: r[2] for r in got if r[0] != "flush"} == kept
    batch = spark.createDataFrame(rows, SCHEMA)
    numbered = W.numbered(batch, "user_id", [F.col("event_id")], F.floor(F.col("event_id") / 50)).withColumn("seq", F.col("idx") + 1)
    assert {r["event_id"] for r in W.stop_the_line(numbered, "user_id", "seq", F.col("failed")).collect()} == {i for i, k in kept.items() if k}


SNAPSHOT = "product_url STRING, product_id BIGINT, verification_status STRING, inci_ingredients ARRAY<STRING>"


def merge(old, new):
    return J.merge_never_downgrade(old, new, lists=["inci_ingredients", "verification_status"])


def test_upsert_stream_equals_batch_merge(spark, source, rows):
    root, ck, sides = tempfile.mkdtemp(prefix="snap-"), tempfile.mkdtemp(prefix="ck-"), []
    items = stream(spark, source, 1).select(
        F.col("user_id").alias("product_url"), F.col("event_id").alias("product_id"), F.lit("verified_inci").alias("verification_status"), F.array("kind").alias("inci_ingredients"))

    def fan_out(changed, path):
        sides.append((path, sorted(r.product_url for r in changed.collect())))

    K.upsert_stream(items, "product_url", [-F.col("product_id")], root, ck, SNAPSHOT, merge, buckets=4, fan_out=fan_out, once=True).awaitTermination(180)
    newest = {}
    for _ident, user, kind, _t, _f in rows:
        newest[user] = kind
    assert {r["product_url"]: r["inci_ingredients"][0] for r in K.snapshot(spark, root, SNAPSHOT).collect()} == newest
    assert len(sides) == 4 and all(urls == sorted(set(newest)) for _, urls in sides)


def test_a_batch_rewrites_its_buckets_only(spark):
    root = tempfile.mkdtemp(prefix="snap-")

    def rows_of(keys, status):
        return spark.createDataFrame([(k, i, status, ["x" * 200]) for i, k in enumerate(keys)], SNAPSHOT)

    def put(batch_id, df):
        return K.upsert_batch(spark, df, batch_id, "product_url", [-F.col("product_id")], root, SNAPSHOT, merge, buckets=16)

    def written():
        return {str(p.relative_to(root)): p.stat().st_size for p in Path(root).rglob("*.parquet")}

    assert K.snapshot(spark, root, SNAPSHOT).collect() == []
    put(0, rows_of([f"u{i}" for i in range(3000)], "catalog_only"))
    before = written()
    assert put(1, rows_of(["u7", "new"], "verified_inci"))
    new = {f: n for f, n in written().items() if f not in before}
    # Two of sixteen buckets at most, an eighth of the bytes.
    assert len(new) <= 2 and sum(new.values()) < 0.2 * sum(before.values())
    state = sorted(map(tuple, K.snapshot(spark, root, SNAPSHOT).select("product_url", "verification_status").collect()))
    assert len(state) == 3001 and dict(state)["u7"] == dict(state)["new"] == "verified_inci" and dict(state)["u8"] == "catalog_only"
    # Repeated and older batch ids change nothing, an empty batch neither.
    files = written()
    assert not put(1, rows_of(["u7"], "quarantined")) and not put(0, rows_of(["u9"], "quarantined"))
    put(2, rows_of([], "x"))
    assert sorted(map(tuple, K.snapshot(spark, root, SNAPSHOT).select("product_url", "verification_status").collect())) == state and set(files) >= set(written())
    # Old versions of a bucket go after a few batches.
    for i in range(3, 9):
        put(i, rows_of(["u7"], "verified_inci"))
    assert len(written()) < len(before) + 8


def test_late_rows_go_aside(spark):
    path, a, b = (tempfile.mkdtemp(prefix=p) for p in ("late-", "on-", "off-"))
    for i, secs in enumerate(([0, 1000], [5, 990])):
        spark.createDataFrame([(s, T0 + dt.timedelta(seconds=s)) for s in secs], "n INT, ts TIMESTAMP").coalesce(1).write.mode("append").parquet(path)
        del i
    src = K.read_stream(spark, path, "n INT, ts TIMESTAMP", 1)
    K.split_late(src, "ts", 600, a, b, tempfile.mkdtemp(prefix="ck-"), once=True).awaitTermination(120)
    on, off = (sorted(r["n"] for r in spark.read.option("recursiveFileLookup", "true").schema("n INT, ts TIMESTAMP").option("pathGlobFilter", "part-*").parquet(*[f"{d}/batch=0", f"{d}/batch=1"]).collect()) for d in (a, b))
    assert sorted(on + off) == [0, 5, 990, 1000] and off in ([5], [0])
