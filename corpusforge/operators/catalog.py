"""The ingestion queue and catalog: statuses, claims, schemas, directories, runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.time import next_run

STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "EXCLUDED")
TRANSITIONS = {"PENDING": ("PROCESSING", "EXCLUDED"), "PROCESSING": ("COMPLETED", "FAILED", "PENDING", "EXCLUDED"), "COMPLETED": ("EXCLUDED",), "FAILED": ("PENDING", "EXCLUDED"), "EXCLUDED": ("PENDING",)}


def file_counts(jobs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct files per status; a file with jobs of several statuses counts in each."""
    files = lambda *s: F.count_distinct(F.when(F.col("status").isin(*s), F.col("file_id")))
    return jobs.groupBy(*(by or [])).agg(
        F.count_distinct("file_id").alias("total"),
        files("COMPLETED").alias("completed"),
        files("PENDING", "PROCESSING").alias("in_progress"),
        files("FAILED").alias("failed"),
        files("EXCLUDED").alias("excluded"),
        F.lit(0).cast("long").alias("cancelled"),
    )


def latest_job(jobs: DataFrame) -> DataFrame:
    """Each file's newest job; of equal times the first."""
    w = Window.partitionBy("file_id").orderBy(F.desc("created_at"), F.asc("job_id"))
    return jobs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def claim(jobs: DataFrame, n: int) -> DataFrame:
    """The n oldest pending jobs, as processing."""
    return jobs.filter("status = 'PENDING'").orderBy("created_at", "job_id").limit(n).withColumn("status", F.lit("PROCESSING"))


def reap_stale(jobs: DataFrame, as_of: float, seconds: int = 3600) -> DataFrame:
    """Jobs in process for too long are pending again."""
    stale = (F.col("status") == "PROCESSING") & (F.lit(as_of) - F.col("updated_at") > seconds)
    return jobs.withColumn("status", F.when(stale, F.lit("PENDING")).otherwise(F.col("status")))


def retry_failed(jobs: DataFrame, slug: str | None = None) -> DataFrame:
    """Failed jobs (of a directory) are pending again, without their error."""
    again = F.col("status") == "FAILED"
    if slug is not None:
        again = again & (F.col("slug") == slug)
    out = jobs.withColumn("_again", F.coalesce(again, F.lit(False))).withColumn("status", F.when(F.col("_again"), F.lit("PENDING")).otherwise(F.col("status")))
    if "error" in jobs.columns:
        out = out.withColumn("error", F.when(F.col("_again"), F.lit(None)).otherwise(F.col("error")))
    return out.drop("_again")


def transition(jobs: DataFrame, to: str, when: Column) -> DataFrame:
    """Jobs that ``when`` holds for change status, where the change is allowed."""
    allowed = F.col("status").isin(*[s for s, t in TRANSITIONS.items() if to in t])
    return jobs.withColumn("status", F.when(F.coalesce(when, F.lit(False)) & allowed, F.lit(to)).otherwise(F.col("status")))


def guard(jobs: DataFrame) -> DataFrame:
    """(status, error) after the checks before and after chunking; null num_chunks: not chunked yet."""
    rules = (
        (F.col("is_excluded"), "EXCLUDED", None),
        (F.coalesce(F.col("file_size"), F.lit(0)) == 0, "FAILED", "file is missing or empty"),
        (F.col("num_chunks") == 0, "FAILED", "no chunks"),
    )
    status, error = F.col("status"), F.lit(None).cast("string")
    for rule, to, why in reversed(rules):
        status, error = F.when(rule, F.lit(to)).otherwise(status), F.when(rule, F.lit(why)).otherwise(error)
    return jobs.withColumns({"status": status, "error": error})


def superseded(jobs: DataFrame) -> DataFrame:
    """(file_id) of files that a completed job replaces."""
    return jobs.filter("status = 'COMPLETED'").select(F.explode("supersedes_file_ids").alias("file_id")).distinct()


#: New files at most that stand in one row beside what they replace.
ATTACHED = 1_000


def attach_groups(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """``attach`` with a row for each name, directory and content: its new files in ``new``, a thousand at most.

    The files of a name and directory are listed once, and what a content replaces is
    worked out beside them once for its new files, so no list of a content is shuffled, sorted or kept.
    """
    old = jobs.select(F.col("filename").alias("_f"), F.col("slug").alias("_s"), F.col("file_id").alias("old_id"), F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"))
    named = (F.col("filename") == F.col("_f")) & F.col("slug").eqNullSafe(F.col("_s"))
    live = old.filter("old_status <> 'FAILED'").groupBy("_f", "_s", "old_hash").agg(F.min("old_id").alias("duplicate_of"))
    # a file with one content alone is not replaced by that content
    files = old.filter("old_id IS NOT NULL AND old_hash IS NOT NULL").groupBy("_f", "_s", "old_id").agg(F.min("old_hash").alias("low"), F.max("old_hash").alias("high"))
    each = files.select("_f", "_s", F.struct("old_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only")).alias("file"))
    listed = each.groupBy("_f", "_s").agg(F.array_sort(F.collect_list("file")).alias("files"))
    keys = ["filename", "slug", "content_hash"]
    rest = [c for c in new.columns if c not in keys]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*rest) if rest else F.lit(0)))
    asked = new.distinct().withColumn("_part", F.floor((nth - 1) / ATTACHED)).groupBy(*keys, "_part").agg(F.collect_list(F.struct(*rest)).alias("new"))
    other = F.filter("files", lambda x: F.col("content_hash").isNotNull() & (x["only"].isNull() | (x["only"] != F.col("content_hash"))))
    found = asked.join(live, named & (F.col("old_hash") == F.col("content_hash")), "left").select(*keys, "new", "duplicate_of")
    return found.join(listed, named, "left").select(*keys, "new", "duplicate_of", F.coalesce(F.transform(other, lambda x: x["old_id"]), F.array().cast(f"array<{dict(old.dtypes)['old_id']}>")).alias("supersedes_file_ids"))


def attach(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each new file against jobs of its name and directory: duplicate of the same
    content, and the files of other content that it replaces.
    """
    out = attach_groups(new, jobs).withColumn("new", F.explode("new"))
    return out.select(*[c if c in ("filename", "slug", "content_hash") else F.col(f"new.{c}") for c in new.columns], "duplicate_of", "supersedes_file_ids")


def directory_counts(directories: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each directory with its numbers of files and jobs, most first."""
    counts = jobs.groupBy("slug").agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("points"))
    out = directories.join(counts, "slug", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files", "points")})


def unassigned(jobs: DataFrame, directories: DataFrame) -> DataFrame:
    """Jobs whose directory is missing or unknown."""
    known = directories.select(F.col("slug").alias("_slug")).distinct()
    return jobs.join(known, F.coalesce(jobs["slug"], F.lit("")) == known["_slug"], "left_anti")


def schema_cascade(files: DataFrame, schemas: DataFrame, defaults: dict) -> DataFrame:
    """Each field from the narrowest scope that sets it: file, dir, sync, store, default."""
    fields = list(defaults)
    out = files
    for scope, key in (("file", "file_id"), ("dir", "slug"), ("sync", "sync_job_id"), ("store", "store_id")):
        if key not in files.columns:
            continue
        one = schemas.filter(F.col("scope") == scope).select(F.col("ident").alias(f"_{scope}"), *[F.col(f).alias(f"_{scope}_{f}") for f in fields])
        out = out.join(one, F.col(key).cast("string") == F.col(f"_{scope}"), "left").drop(f"_{scope}")
    scopes = [s for s in ("file", "dir", "sync", "store") if f"_{s}_{fields[0]}" in out.columns]
    chosen = [F.coalesce(*[F.col(f"_{s}_{f}") for s in scopes], F.lit(defaults[f])).alias(f) for f in fields]
    return out.select(*files.columns, *chosen)


def validate_schema(tokens: int | None, labels: list[str] | None) -> tuple[int | None, list[str] | None]:
    """Bounds of chunk sizes, and labels without blanks."""
    if tokens is not None and not 16 <= tokens <= 8192:
        raise ValueError("chunk_max_tokens must be from 16 to 8192")
    return tokens, None if labels is None else [x.strip() for x in labels if x and x.strip()]


def retain_runs(runs: DataFrame, keep: int = 5) -> DataFrame:
    """The newest runs of each type."""
    w = Window.partitionBy("type").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def due(schedules: DataFrame, as_of: float) -> DataFrame:
    return schedules.filter(F.col("enabled") & (F.col("next_run") <= as_of))


def reschedule(schedules: DataFrame, as_of: float, zone: str = "Europe/Rome") -> DataFrame:
    """Schedules that are due get their next run; those that are never due again are disabled."""

    @F.pandas_udf("long")
    def following(cron: pd.Series) -> pd.Series:
        def one(c):
            try:
                return next_run(c, as_of, zone)
            except ValueError:
                return None

        return cron.map(one).astype("Int64")

    is_due = F.col("enabled") & (F.col("next_run") <= as_of)
    out = schedules.withColumn("_next", F.when(is_due, following("cron")))
    return out.withColumns({"next_run": F.when(is_due, F.col("_next")).otherwise(F.col("next_run")), "enabled": F.col("enabled") & (~is_due | F.col("_next").isNotNull())}).drop("_next")


#: How people read names: accents and case don't matter, except between names that are equal without.
LOCALE, EXACT = "it_CI_AI", "it"


def client_order(jobs: DataFrame, mode: str = "name", locale: str = LOCALE) -> DataFrame:
    """The listing's orders: by name as its locale sorts it, newest first, or by status and then name."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(("FAILED", "PROCESSING", "PENDING", "COMPLETED", "EXCLUDED")) for x in (s, i)]), F.col("status"))
    name = [F.collate("filename", locale), F.collate("filename", locale.split("_")[0]), F.col("filename")]
    orders = {"name": name, "recent": [F.desc("created_at")], "status": [rank, *name]}
    return jobs.orderBy(*orders[mode], "job_id")


def client_filter(jobs: DataFrame, needle: str | None = None, statuses: list[str] | None = None, locale: str = LOCALE) -> DataFrame:
    """Rows whose name holds the needle, whatever case and accents, and of some statuses; blank ones ask for nothing."""
    out = jobs
    if needle and needle.strip():
        out = out.filter(F.contains(F.collate("filename", locale), F.collate(F.lit(needle.strip()), locale)))
    return out.filter(F.col("status").isin(statuses)) if statuses else out


def client_counts(jobs: DataFrame, needle: str | None = None, locale: str = LOCALE) -> DataFrame:
    """(status, n) of what a search for the needle finds, with a row for all."""
    found = client_filter(jobs, needle, locale=locale)
    return found.rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("all")).alias("status"), "n")


def same_names(rows: DataFrame, column: str, locale: str = LOCALE) -> DataFrame:
    """(name, n, forms): names that are equal in a locale, by their least form; nulls left out."""
    name = F.col(column)
    grouped = rows.filter(name.isNotNull()).groupBy(F.collate(name, locale).alias("_name")).agg(F.min(name).alias("name"), F.count("*").alias("n"), F.count_distinct(name).alias("forms"))
    return grouped.select("name", "n", "forms")


def page(df: DataFrame, limit: int, after: tuple | None = None, order: str = "created_at", key: str = "id", most: int = 500) -> DataFrame:
    """A page of the newest rows after the key (value, id) of the last, and ``has_more``."""
    limit = min(max(limit, 1), most)
    if after is not None:
        value, ident = after
        df = df.filter((F.col(order) < F.lit(value)) | ((F.col(order) == F.lit(value)) & (F.col(key) > F.lit(ident))))
    rows = df.orderBy(F.desc(order), F.asc(key)).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(F.desc(order), F.asc(key)))  # at most limit + 1 rows
    return rows.withColumn("_n", n).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).filter(F.col("_n") <= limit).drop("_n")


def fingerprint(counts: DataFrame) -> DataFrame:
    """A hash of a one-row frame of counts, as the key of cached overviews."""
    return counts.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(counts.columns)]), 256).alias("fingerprint"))


def expire_runs(runs: DataFrame, as_of: float, seconds: int = 1800) -> DataFrame:
    """Running runs without a sign of life for ``seconds`` have failed; so has one that never gave any."""
    stale = (F.col("status") == "running") & (F.lit(as_of) - F.coalesce(F.col("updated_at"), F.lit(0)) > seconds)
    return runs.withColumn("error", F.when(stale, F.lit("timed out"))).withColumn("status", F.when(stale, F.lit("failed")).otherwise(F.col("status")))


def single_flight(requests: DataFrame, runs: DataFrame, as_of: float, seconds: int = 1800) -> DataFrame:
    """(key, request_id): the oldest request of each key that no live run holds.

    requests: key, request_id, created_at. runs: key, status, updated_at; a run that
    ``expire_runs`` ends holds its key no longer, as a lock that has expired.
    """
    held = expire_runs(runs, as_of, seconds).filter("status = 'running'").select("key").distinct()
    oldest = F.min(F.struct("created_at", "request_id")).alias("_first")
    return requests.groupBy("key").agg(oldest).join(held, "key", "left_anti").select("key", "_first.request_id")


#: Bytes that a point counts for, whatever its size; a fixed value.
POINT_BYTES = 1024


def usage(points: DataFrame, by: str) -> DataFrame:
    """Points and bytes of each store."""
    return points.groupBy(by).agg(F.count("*").alias("points"), (F.count("*") * POINT_BYTES).alias("usage_bytes"))
