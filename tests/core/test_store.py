"""The bucketed store, incremental provenance, and the paged folder source."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import curation
from corpusforge.plans import ingest, provenance
from corpusforge.plans.store import Conflict, Store, remove_files
from corpusforge.sources import paged

ROWS = "file_id string, v int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, data, schema=ROWS):
    return spark.createDataFrame(data, schema)


def folders(store, name="points"):
    return dict(store.manifest()["tables"][name].folders)


def test_a_file_writes_one_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("points") is None and store.manifest()["version"] == 0
    old = [(f"f{i}", v) for i in range(200) for v in (1, 2)]
    store.change().upsert("points", frame(spark, old), "file_id", buckets=16).commit()
    before = folders(store)
    change = store.change().upsert("points", frame(spark, [("f7", 9)]), "file_id")
    assert change.figures["points buckets"] == 1 and change.commit() == 2
    after = folders(store)
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert rows(store.read("points")) == sorted([r for r in old if r[0] != "f7"] + [("f7", 9)], key=str)
    assert rows(store.read("points", version=1)) == sorted(old, key=str)  # older versions stand
    assert rows(store.lookup("points", frame(spark, [("f7",), ("none",)], "k string"))) == [("f7", 9)]


def test_a_lost_job_changes_nothing_and_vacuum_clears_up(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.change().upsert("points", frame(spark, [("a", 1), ("b", 2), (None, 3)]), "file_id").commit()
    store.change().upsert("points", frame(spark, [("a", 5)]), "file_id")  # never committed
    bad = frame(spark, [("b", 1)]).withColumn("v", F.expr("CAST(raise_error('lost') AS int)"))
    with pytest.raises(Exception, match="lost"):
        store.change().upsert("points", bad, "file_id").commit()
    assert rows(store.read("points")) == [("a", 1), ("b", 2), (None, 3)]
    store.change().upsert("points", frame(spark, [(None, 4)]), "file_id").commit()
    assert store.vacuum() and rows(store.read("points")) == [("a", 1), ("b", 2), (None, 4)]
    assert store.versions() == [2] and len(os.listdir(tmp_path / "data")) == len(set(folders(store).values()))


def test_of_two_writers_one_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one, two = store.change(), store.change()
    one.upsert("points", frame(spark, [("a", 1)]), "file_id").commit()
    with pytest.raises(Conflict):
        two.upsert("points", frame(spark, [("b", 1)]), "file_id").commit()
    assert rows(store.read("points")) == [("a", 1)]


def test_a_batch_that_runs_twice_is_written_once(spark, tmp_path):
    for batch, data in ((0, [("a", 1)]), (1, [("b", 2)]), (1, [("b", 7)]), (0, [("a", 9)])):
        got = ingest.upsert(frame(spark, data), str(tmp_path), stream="s", batch=batch)
    assert rows(got) == [("a", 1), ("b", 2)] and Store(spark, str(tmp_path)).versions() == [1, 2]


def test_files_go_from_all_tables_in_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    change = store.change()
    for name, n in (("points", 3), ("mentions", 2), ("jobs", 1)):
        change.upsert(name, frame(spark, [(f, i) for f in "abc" for i in range(n)]), "file_id")
    change.commit()
    gone = remove_files(store, frame(spark, [("a",), ("zz",), ("b",)], "file_id string"), {"points": "file_id", "mentions": "file_id", "jobs": "file_id", "never": "file_id"})
    assert gone == {"points": 6, "mentions": 4, "jobs": 2} and store.versions() == [1, 2]
    assert {n: rows(store.read(n)) for n in ("jobs", "mentions")} == {"jobs": [("c", 0)], "mentions": [("c", 0), ("c", 1)]}
    assert remove_files(store, frame(spark, [("a",)], "file_id string"), {"points": "file_id"}) == {"points": 0}


def test_provenance_equals_a_recount(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(provenance, "FOLD", 4)
    store, r, have = Store(spark, str(tmp_path)), random.Random(4), {}
    schema = "file_id string, body_hash string"
    assert rows(provenance.counts(store)) == [] and provenance.purge(store, frame(spark, [("f",)], "file_id string")) == 0
    for step in range(11):
        kind = ["register", "register", "replace", "purge", "again"][step % 5] if step != 8 else "drop"
        some = [(f"f{r.randrange(6)}", r.choice(["h1", "h2", "h3", "h4", f"u{step}"])) for _ in range(12)]
        if kind == "purge":
            gone = {f for f, _ in some[:3]}
            provenance.purge(store, frame(spark, [(f,) for f in gone], "file_id string"))
            have = {f: b for f, b in have.items() if f not in gone}
        elif kind == "drop":
            provenance.drop(store)
            have = {}
        else:
            new = {}
            for f, b in some:
                new.setdefault(f, set()).add(b)
            for _ in range(2 if kind == "again" else 1):
                provenance.register(store, frame(spark, [*some, some[0], (None, "x"), ("y", None)], schema), replace=kind == "replace", buckets=8)
            have |= {f: b if kind == "replace" else b | have.get(f, set()) for f, b in new.items()}
        pairs = frame(spark, [(f, b) for f, bs in have.items() for b in bs], schema)
        assert rows(provenance.counts(store)) == rows(curation.body_provenance(pairs)), (step, kind)
    provenance.compact(store)
    assert rows(provenance.counts(store)) == rows(curation.body_provenance(pairs))
    assert not store.manifest()["tables"][provenance.LOG].parts


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(paged.PagedFolders)
    data = [("r", f"d{i}", True, i) for i in range(5)] + [(f"d{i % 5}", f"f{i}", False, i) for i in range(2500)]
    schema = "parent string, child string, is_folder boolean, seq long"
    frame(spark, data, schema).repartition(3).write.parquet(str(tmp_path / "t"))
    found = spark.read.format("paged_folders").option("pageSize", 100).load(str(tmp_path / "t"))
    assert found.rdd.getNumPartitions() == 3 and rows(found) == sorted(data, key=str)
    os.makedirs(tmp_path / "none")
    assert spark.read.format("paged_folders").load(str(tmp_path / "none")).count() == 0


def test_paged_source_as_a_stream(spark, tmp_path):
    spark.dataSource.register(paged.PagedFolders)
    schema, source = "parent string, child string, is_folder boolean, seq long", tmp_path / "t"
    os.makedirs(source)
    add = lambda n, data: (frame(spark, data, schema).coalesce(1).write.parquet(str(tmp_path / f"x{n}")), os.rename(next((tmp_path / f"x{n}").glob("*.parquet")), source / f"{n:05d}.parquet"))
    seen = []

    def run():
        q = spark.readStream.format("paged_folders").option("filesPerTrigger", 1).load(str(source)).writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.child for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    add(1, [("r", "a", True, 1), ("a", "b", False, 2)])
    add(2, [("r", "c", False, 3)])
    run()
    assert [s for s in seen if s] == [["a", "b"], ["c"]]
    add(3, [("r", "d", False, 4)])
    run()  # goes on where it stopped
    assert [s for s in seen if s] == [["a", "b"], ["c"], ["d"]]


def test_walk(spark):
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("c", "a"), ("b", "c"), ("c", "r"), ("c", None), (None, "x"), ("z", "y"), ("r", "r")]
    df = frame(spark, edges, "parent string, child string")
    roots = lambda *r: frame(spark, [(x,) for x in r], "id string")
    assert rows(paged.walk(df, roots("r"))) == [("a", 1), ("b", 1), ("c", 2), ("r", 0)]
    assert rows(paged.walk(df, roots("z", "nowhere"))) == [("nowhere", 0), ("y", 1), ("z", 0)]
    assert rows(paged.walk(df.limit(0), roots("r"))) == [("r", 0)]


def test_walk_of_a_million_nodes_with_cycles(spark):
    n = 1_200_000
    down = spark.range(1, n).select(((F.col("id") - 1) / 30).cast("long").alias("parent"), F.col("id").alias("child"))
    back = spark.range(0, n, 1000).select(F.col("id").alias("parent"), (F.col("id") / 900).cast("long").alias("child"))
    found = paged.walk(down.union(back), spark.createDataFrame([(0,)], "id long"))
    assert found.count() == n and found.agg(F.count_distinct("id"), F.max("depth")).first()[0] == n
