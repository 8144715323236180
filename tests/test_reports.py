"""Reports: sketches against exact values, the joint audit log by date."""
import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from shelfgrade.operators import reports as R


def test_merged_sketches_are_near_exact_values(spark):
    r = random.Random(1)
    rows = [(f"b{r.randint(0, 4)}", r.choice("xyz"), f"name {r.randint(0, 3000)}", f"u{i}", r.gauss(100, 30) if i % 5 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "brand STRING, kind STRING, name STRING, url STRING, price DOUBLE")
    stored = R.profile_sketches(df, ["brand", "kind"], "name", "url", "price")
    path = tempfile.mkdtemp(prefix="sketches-") + "/s"
    stored.write.parquet(path)
    stored = spark.read.parquet(path)
    groups = {None: rows} | {b: [x for x in rows if x[0] == b] for b in {x[0] for x in rows}}
    got = {r.brand: r for r in R.merged_profile(stored, ["brand"]).collect()} | {None: R.merged_profile(stored, []).first()}
    assert got.keys() == groups.keys()
    for b, mine in groups.items():
        prices = sorted(x[4] for x in mine if x[4] is not None)
        assert got[b].n == len(mine)
        assert abs(got[b].names - len({x[2] for x in mine})) <= 0.05 * len({x[2] for x in mine})
        assert abs(got[b].urls - len(mine)) <= 0.05 * len(mine)
        for q, value in ((0.25, got[b].p25), (0.5, got[b].p50), (0.75, got[b].p75)):
            # The rank of the answer, not its value, is what a sketch promises.
            assert abs(sum(p <= value for p in prices) / len(prices) - q) < 0.02
    none = R.merged_profile(R.profile_sketches(df.filter("price is null"), ["brand"], "name", "url", "price"), [])
    assert none.first().p50 is None and R.merged_profile(stored.limit(0), ["brand"]).collect() == []


def test_audit_search_reads_the_days_it_needs(spark):
    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(i, "click" if i % 2 else "error", f"u{i % 3}@x.com", t0 + dt.timedelta(hours=7 * i)) for i in range(60)], "event_id INT, event_type STRING, email STRING, ts TIMESTAMP")
    log = R.audit_log(auth=(e.filter("event_type = 'error'"), {"event_id": "event_id", "event_type": "event_type", "email": "email", "created_at": "ts"}),
                      retrieval=(e.filter("event_type = 'click'"), {"event_id": "event_id", "event_type": "event_type", "created_at": "ts"}))
    assert dict(log.dtypes) == R.AUDIT_COLUMNS
    path = tempfile.mkdtemp(prefix="audit-") + "/log"
    log.write.partitionBy("event_date").parquet(path)
    found = R.audit_search(spark.read.parquet(path), "created_at", kind=F.col("event_type") == "error", since="2024-01-03", until="2024-01-05", date="event_date")
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "event_date" in filters and ">=" in filters and "<=" in filters
    want = [str(i) for i in range(59, -1, -1) if not i % 2 and dt.datetime(2024, 1, 3) <= t0 + dt.timedelta(hours=7 * i) <= dt.datetime(2024, 1, 5)]
    assert [r.event_id for r in found.collect()] == want and {r.log for r in found.collect()} == {"auth"} and len(want) > 2
    assert [r.event_id for r in R.audit_search(log, "created_at", user=F.col("email") == "u0@x.com", limit=1).collect()] == ["54"]
