"""Leases in stream state, the overview cache, and locale order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import catalog
from corpusforge.plans import overview
from corpusforge.plans.store import Store
from corpusforge.streaming import leases

START = datetime(2024, 1, 1, 12)
EVENTS = "key string, request_id string, kind string, ts timestamp"


def ms(minutes):
    return int((START.timestamp() + minutes * 60) * 1000)


def at(minutes):
    return START + timedelta(minutes=minutes)


def history(n=160, seed=3):
    r = random.Random(seed)
    return [(f"k{r.randrange(4)}", f"r{r.randrange(9)}", r.choice(["request", "request", "beat", "beat", "done"]), at(r.randrange(0, 900))) for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("requeue", [False, True])
def test_stream_equals_replay_whatever_the_order(spark, tmp_path, requeue):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r, events = random.Random(1), history()
    # events come up to nine minutes late, in seven batches; then the watermark is pushed on
    arrived = sorted(events, key=lambda e: e[3] + timedelta(minutes=9 * r.random()))
    size = -(-len(arrived) // 7)
    batches = [arrived[i : i + size] for i in range(0, len(arrived), size)] + [[("zz", "r", "beat", at(3000))], [("zz", "r", "beat", at(3001))]]
    for i, some in enumerate(batches):
        spark.createDataFrame(some, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i:03d}"))
    seen = []
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    out = leases.lease_actions(stream, seconds=1800, requeue=requeue)
    out.writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(240)
    want = rows(leases.replay(spark.createDataFrame(events, EVENTS), 1800, requeue, ms(2990)))
    until = ms(1400)
    cut = lambda found: sorted((x for x in found if x[3] <= until and x[0] != "zz"), key=str)
    assert cut(seen) == cut(want) and len(cut(seen)) > 50
    assert {x[2] for x in seen} >= {"granted", "released", "expired" if requeue else "failed"}


def test_replay_equals_single_flight_and_reaping(spark):
    """Whom a key's lease goes to, and what has run out, as the catalog's operators say at one moment."""
    asked = [("a", "r1", "request", at(0)), ("a", "r2", "request", at(5)), ("b", "r3", "request", at(1)), ("b", "r3", "beat", at(25)), ("c", "r4", "request", at(2)), ("c", "r4", "done", at(3)), ("c", "r6", "request", at(4)), (None, "r", "request", at(1)), ("d", None, "request", at(1)), ("d", "x", "odd", at(1))]
    actions = leases.replay(spark.createDataFrame(asked, EVENTS), 1800, False, ms(40))
    assert rows(actions.filter("action = 'failed'").select("key", "request_id")) == [("a", "r1"), ("c", "r6")]
    jobs = spark.createDataFrame([("a", "running", ms(0) / 1000), ("b", "running", ms(25) / 1000), ("c", "running", ms(4) / 1000)], "key string, status string, updated_at double")
    requests = spark.createDataFrame([("a", "r2", 5.0), ("a", "r9", 6.0), ("b", "r8", 5.0)], "key string, request_id string, created_at double")
    free = rows(catalog.single_flight(requests, jobs, ms(40) / 1000, 1800))
    passed_on = actions.filter(F.col("action") == "granted").groupBy("key").agg(F.max_by("request_id", "at").alias("request_id"))
    assert free == [("a", "r2")] and rows(passed_on.filter("key = 'a'")) == free
    stale = catalog.reap_stale(jobs.withColumn("status", F.lit("PROCESSING")), ms(40) / 1000, 1800).filter("status = 'PENDING'").select("key")
    assert rows(stale) == [("a",), ("c",)] == rows(actions.filter("action = 'failed'").select("key").distinct())


def test_cached_overview(spark, tmp_path, monkeypatch):
    schema = ("file_id long, slug string, category string", "job_id long, file_id long, status string, created_at long", "file_id long, body_hash string")
    files = [(i, f"s{i % 3}", "a" if i % 2 else "b") for i in range(12)] + [(99, None, "a")]
    jobs = [(i, i, "COMPLETED" if i % 4 else "FAILED", i) for i in range(12)]
    chunks = [(i, h) for i in range(12) for h in ("same", f"h{i}")]
    frames = lambda: (spark.createDataFrame(d, s) for d, s in zip((files, jobs, chunks), schema, strict=True))
    store = Store(spark, str(tmp_path))
    first = rows(overview.cached(store, *frames()))
    assert first == rows(overview.sections(*[f.filter("slug IS NOT NULL") if "slug" in f.columns else f for f in frames()]))
    # a second call reads no chunk: these would fail if they were read
    f, j, c = frames()
    broken = c.withColumn("body_hash", F.expr("CAST(raise_error('read') AS string)"))
    assert rows(overview.cached(store, f, j, broken)) == first and store.versions() == [1]
    # one directory changes: it alone is computed again
    jobs.append((50, 4, "PENDING", 50))
    files.append((50, "s1", "c"))
    f, j, c = frames()
    computed, whole = [], overview.sections
    monkeypatch.setattr(overview, "sections", lambda *a: (computed.extend(r.slug for r in a[0].select("slug").distinct().collect()), whole(*a))[1])
    second = rows(overview.cached(store, f, j, c))
    assert computed == ["s1"]
    assert second == rows(whole(f.filter("slug IS NOT NULL"), j, c)) != first
    files[:] = [x for x in files if x[1] != "s2"]
    f, j, c = frames()
    assert rows(overview.cached(store, f, j, broken.limit(0))) == [r for r in second if r[0] != "s2"]


def test_names_in_the_order_of_a_locale(spark):
    names = ["zeta", "Àlbero", "albero", "Élan", "elan", "casa", "Casa", "perché", "perche", None]
    jobs = spark.createDataFrame([(i, n, ["FAILED", "COMPLETED", "PENDING"][i % 3], i) for i, n in enumerate(names)], "job_id long, filename string, status string, created_at long")
    ordered = [r.filename for r in catalog.client_order(jobs).collect()]
    assert ordered == [None, "albero", "Àlbero", "casa", "Casa", "elan", "Élan", "perche", "perché", "zeta"]
    assert [r.filename for r in catalog.client_order(jobs, "status").collect()] == [None, "Casa", "Élan", "zeta", "albero", "casa", "perche", "Àlbero", "elan", "perché"]
    assert sorted(r.filename for r in catalog.client_filter(jobs, " PERCHE ").collect()) == ["perche", "perché"]
    assert sorted(r.job_id for r in catalog.client_filter(jobs, "a", ["FAILED"]).collect()) == [0, 3, 6]
    assert catalog.client_filter(jobs, "  ").count() == 10
    assert dict(map(tuple, catalog.client_counts(jobs, "e").collect())) == {"all": 7, "FAILED": 2, "COMPLETED": 3, "PENDING": 2}
    assert rows(catalog.same_names(jobs, "filename")) == [("Casa", 2, 2), ("albero", 2, 2), ("elan", 2, 2), ("perche", 2, 2), ("zeta", 1, 1)]
