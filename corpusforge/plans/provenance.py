"""In how many files each body stands, kept up without counting anew.

The pairs (file_id, body_hash) are a table in buckets of files; what a change adds or
takes from a body's count is appended to a log of signed rows, (body_hash, change), one
for each body that the change touches. Counts are the compacted table joined with the
log's sums, and the log stays small, as ``compact`` folds it into the counts. Both tables
change in one version, so a lost job leaves them in step.

Adding pairs that are there already, or taking ones that aren't, changes nothing, so a
file that is ingested twice counts once. Null hashes and null files are left out. No body
ever needs its files in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.plans.store import BUCKETS, Store

PAIRS, LOG, COUNTS = "body_pairs", "body_changes", "body_counts"
#: Parts of the log at which a change folds it.
FOLD = 16


def register(store: Store, pairs: DataFrame, replace: bool = False, buckets: int = BUCKETS) -> int:
    """Files with their bodies (file_id, body_hash): pairs that are new are added.

    With ``replace``, what the files had before and don't have now goes, as when a
    file is ingested again. Gives the new version.
    """
    change = store.change()
    stored = lambda rows: store.spark.read.schema(rows.schema).parquet(f"{store.path}/data/{change._write(rows, False)}")
    # written once, as they are read several times
    new = stored(pairs.select("file_id", "body_hash").filter("file_id IS NOT NULL AND body_hash IS NOT NULL").distinct())
    added, gone = new, new.limit(0)
    if PAIRS in change.tables:
        files = new.select("file_id")
        old = store.lookup(PAIRS, files) if replace else store._rows(change.tables[PAIRS], store.buckets_of(PAIRS, files))
        old = old.select("file_id", "body_hash")
        added = new.join(old, ["file_id", "body_hash"], "left_anti")
        if replace:
            gone = old.join(new, ["file_id", "body_hash"], "left_anti")
        else:
            added = stored(added)
    signed = added.select("body_hash", F.lit(1).alias("change")).unionByName(gone.select("body_hash", F.lit(-1).alias("change")))
    _log(change, signed)
    if replace:
        change.upsert(PAIRS, new, "file_id", buckets)
    else:
        change.add(PAIRS, added, "file_id", buckets)
    return _commit(store, change)


def purge(store: Store, files: DataFrame) -> int:
    """Take files (file_id) from all counts."""
    change = store.change()
    if PAIRS not in change.tables:
        return change.base["version"]
    old = store.lookup(PAIRS, files)
    _log(change, old.select("body_hash", F.lit(-1).alias("change")))
    change.delete(PAIRS, files)
    return _commit(store, change)


def drop(store: Store) -> int:
    """Forget all files and bodies."""
    change = store.change()
    for name in (PAIRS, LOG, COUNTS):
        change.clear(name)
    return change.commit()


def _log(change, signed: DataFrame) -> None:
    net = signed.groupBy("body_hash").agg(F.sum("change").cast("long").alias("change")).filter("change <> 0")
    change.append(LOG, net)


def _commit(store: Store, change) -> int:
    version = change.commit()
    return compact(store) if len(change.tables[LOG].parts) >= FOLD else version


def _sums(log: DataFrame) -> DataFrame:
    return log.groupBy("body_hash").agg(F.sum("change").alias("change")).filter("change <> 0")


def compact(store: Store) -> int:
    """Fold the log into the counts; only buckets of bodies in the log are written."""
    change = store.change()
    if LOG not in change.tables or not change.tables[LOG].parts:
        return change.base["version"]
    sums = _sums(change.rows(LOG))
    if COUNTS in change.tables:
        before = store.lookup(COUNTS, sums.select("body_hash"))
        sums = sums.join(before, "body_hash", "left").select("body_hash", (F.coalesce("doc_count", F.lit(0)) + F.col("change")).alias("doc_count"))
    else:
        sums = sums.withColumnRenamed("change", "doc_count")
    change.upsert(COUNTS, sums, "body_hash")
    # bodies without files were written as 0 so that their old rows went; they aren't read
    change.clear(LOG)
    return change.commit()


def counts(store: Store) -> DataFrame:
    """(body_hash, doc_count) of all bodies that some file has."""
    tables = store.manifest()["tables"]
    empty = store.spark.createDataFrame([], "body_hash string, doc_count long")
    base = store._rows(tables[COUNTS]) if COUNTS in tables else empty
    if LOG not in tables or not tables[LOG].parts:
        return base.filter("doc_count > 0")
    sums = _sums(store._rows(tables[LOG]))
    changed = base.join(sums, "body_hash", "left").select("body_hash", (F.col("doc_count") + F.coalesce("change", F.lit(0))).alias("doc_count"))
    known = base.join(sums, "body_hash", "left_semi").select("body_hash")
    fresh = sums.join(known, "body_hash", "left_anti").select("body_hash", F.col("change").alias("doc_count"))
    return changed.unionByName(fresh).filter("doc_count > 0")
