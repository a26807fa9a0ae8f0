"""Reconciling a remote listing with the catalog.

Listings are (id, name, size, modified, ...); jobs carry remote_id, status and
remote_modified. Every decision is one expression over a joined row.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILE_SIZE = 512 * 1024 * 1024
#: Attributes that the sync sets itself; fixed values.
RESERVED_ATTRIBUTES = ("sharepoint_file_modified", "sharepoint_file_id")


def attributes_match(wanted: Column, attributes: Column) -> Column:
    """Whether a file has all attributes wanted of it; null asks for none.

    Keys that are reserved, hold a dot or begin with a dollar sign ask for nothing.
    """
    asked = F.map_filter(wanted, lambda k, _: ~(k.isin(*RESERVED_ATTRIBUTES) | F.contains(k, F.lit(".")) | F.startswith(k, F.lit("$"))))
    return F.coalesce(F.forall(F.map_entries(asked), lambda e: F.coalesce(F.try_element_at(attributes, e["key"]) == e["value"], F.lit(False))), F.lit(True))


def rule_matches(kind: str, value: str, name: str = "name") -> Column:
    """``pattern``: comma-separated substrings in any case; ``regex``: anchored at the start."""
    if kind == "pattern":
        parts = [p.strip().lower() for p in value.split(",")]
        return reduce(or_, [F.contains(F.lower(F.col(name)), F.lit(p)) for p in parts])
    if kind == "regex":
        return F.col(name).rlike(f"^(?:{value})")
    raise ValueError(f"unknown rule type {kind}")


def all_types_match(rules: list[tuple[str, str]], name: str = "name") -> Column:
    """Every type present has a rule that matches: AND between types, OR within one."""
    by_type: dict[str, list[Column]] = defaultdict(list)
    for kind, value in rules:
        by_type[kind].append(rule_matches(kind, value, name))
    return reduce(and_, [reduce(or_, each) for each in by_type.values()])


def admission(remote: DataFrame, jobs: DataFrame, extensions: list[str], include: list | None = None, exclude: list | None = None, excluded_ids: DataFrame | None = None, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """``remote`` with (included, reason); the first reason in this order holds:
    extension, size, excluded by hand, include rules, exclude rules, in flight, unchanged."""
    active = jobs.groupBy(F.col("remote_id").alias("_rid")).agg(
        F.max(F.col("status").isin("PENDING", "PROCESSING")).alias("_busy"),
        F.collect_set(F.when(F.col("status") == "COMPLETED", F.col("remote_modified"))).alias("_done"),
    )
    rows = remote.join(active, remote["id"] == active["_rid"], "left").drop("_rid")
    if excluded_ids is not None:
        rows = rows.join(excluded_ids.select(F.col("remote_id").alias("_xid")).distinct().withColumn("_out", F.lit(True)), F.col("id") == F.col("_xid"), "left").drop("_xid")
    else:
        rows = rows.withColumn("_out", F.lit(None).cast("boolean"))
    extension = F.lower(F.regexp_extract("name", r"[^.](\.[^./]*)$", 1))
    reasons = [
        (~extension.isin(extensions), "extension"),
        (F.coalesce(F.col("size"), F.lit(0)) > max_size, "size"),
        (F.coalesce("_out", F.lit(False)), "excluded"),
        *([(~all_types_match(include), "include_rules")] if include else []),
        *([(all_types_match(exclude), "exclude_rules")] if exclude else []),
        (F.coalesce("_busy", F.lit(False)), "in_flight"),
        (F.coalesce(F.array_contains("_done", F.col("modified")), F.lit(False)), "unchanged"),
    ]
    reason = F.lit("included")
    for test, why in reversed(reasons):
        reason = F.when(test, F.lit(why)).otherwise(reason)
    return rows.withColumn("reason", reason).withColumn("included", F.col("reason") == "included").drop("_busy", "_done", "_out")


def superseded_by_sync(remote: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, file_id) of earlier ingests that a new one of the same remote file replaces:
    completed with another modification, or failed."""
    old = jobs.select("file_id", "status", "remote_modified", "remote_id")
    other = (F.col("status") == "FAILED") | ((F.col("status") == "COMPLETED") & ~F.col("remote_modified").eqNullSafe(F.col("modified")))
    return remote.join(old, remote["id"] == old["remote_id"]).filter(other).select("id", "file_id")


def deleted_remotely(indexed: DataFrame, remote: DataFrame) -> DataFrame:
    """Indexed files whose remote file is gone."""
    return indexed.join(remote.select(F.col("id").alias("remote_id")), "remote_id", "left_anti")


def overlapping_jobs(jobs: DataFrame) -> DataFrame:
    """(job_id, class_id, links) of completed sync jobs (job_id, status, folder_ids) with folders.

    Jobs of the same folders are one class, named by its least id. Classes that share
    a folder are linked, so a shared folder pairs no jobs; ``links`` counts the other
    jobs that share a folder with this one.
    """
    placed = jobs.filter("status = 'COMPLETED'").select("job_id", F.array_sort(F.array_distinct("folder_ids")).alias("folders")).filter(F.size("folders") > 0)
    classes = placed.groupBy("folders").agg(F.min("job_id").alias("class_id"), F.count("*").alias("n"))
    within = classes.select("class_id", "n", F.explode("folders").alias("folder"))
    x, y = within.alias("x"), within.alias("y")
    pairs = x.join(y, F.col("x.folder") == F.col("y.folder")).select(F.col("x.class_id").alias("class_id"), F.col("y.class_id").alias("other"), F.col("y.n").alias("n")).distinct()
    links = pairs.groupBy("class_id").agg((F.sum("n") - 1).alias("links"))
    return placed.join(classes.select("folders", "class_id"), "folders").join(links, "class_id").select("job_id", "class_id", "links")


def rolled_up(sync_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sync jobs are in process while any of their files is."""
    busy = jobs.filter(F.col("status").isin("PENDING", "PROCESSING")).select(F.col("sync_job_id").alias("_sid")).distinct()
    joined = sync_jobs.join(busy, sync_jobs["sync_job_id"] == busy["_sid"], "left")
    return joined.withColumn("status", F.when(F.col("_sid").isNotNull(), F.lit("PROCESSING")).otherwise(F.col("status"))).drop("_sid")


def summary(decided: DataFrame) -> DataFrame:
    """Found, admitted and skipped files, and bytes admitted."""
    return decided.agg(
        F.count("*").alias("found"),
        F.count_if("included").alias("processed"),
        F.count_if(~F.col("included")).alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("included"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
    )
