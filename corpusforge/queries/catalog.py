"""The queue and the catalog, over events in the role of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import catalog
from corpusforge.plans.projections import Tables
from corpusforge.queries.registry import query
from corpusforge.queries.shared import JOBS

NOW = 1704200000


def with_slug(t: Tables):
    """Jobs with a directory: one of seven, and none for every fifth."""
    return t.jobs().withColumn("slug", F.when(F.col("k") % 5 != 0, F.concat(F.lit("src"), (F.col("k") % 7).cast("string"))))


SLUGGED = f"{JOBS}, slugged AS (SELECT *, CASE WHEN k % 5 <> 0 THEN 'src' || (k % 7) END AS slug FROM jobs)"
COUNTS = "count(DISTINCT file_id) AS total, count(DISTINCT file_id) FILTER (status = 'COMPLETED') AS completed, count(DISTINCT file_id) FILTER (status IN ('PENDING', 'PROCESSING')) AS in_progress, count(DISTINCT file_id) FILTER (status = 'FAILED') AS failed, count(DISTINCT file_id) FILTER (status = 'EXCLUDED') AS excluded, 0::BIGINT AS cancelled"


@query(f"WITH {JOBS} SELECT {COUNTS} FROM jobs")
def file_counts_by_status(t: Tables):
    return catalog.file_counts(t.jobs())


@query(f"WITH {SLUGGED} SELECT slug, {COUNTS} FROM slugged GROUP BY slug")
def file_counts_by_directory(t: Tables):
    return catalog.file_counts(with_slug(t), ["slug"])


@query(f"WITH {JOBS} SELECT file_id, job_id, status, created_at FROM jobs QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, job_id) = 1")
def latest_job_per_file(t: Tables):
    return catalog.latest_job(t.jobs()).select("file_id", "job_id", "status", "created_at")


@query(f"WITH {JOBS} SELECT status, count(*) AS n FROM (SELECT status FROM jobs QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, job_id) = 1) GROUP BY status")
def latest_status_counts(t: Tables):
    return catalog.latest_job(t.jobs()).groupBy("status").agg(F.count("*").alias("n"))


def directories(t: Tables):
    return t.read("documents").select(F.col("source").alias("slug")).distinct()


@query(f"WITH {SLUGGED} SELECT d.slug, count(DISTINCT file_id) AS files, count(file_id) AS points FROM (SELECT DISTINCT source AS slug FROM documents) d LEFT JOIN slugged USING (slug) GROUP BY d.slug")
def directory_counts(t: Tables):
    return catalog.directory_counts(directories(t), with_slug(t))


@query(f"WITH {SLUGGED} SELECT job_id, slug FROM slugged WHERE coalesce(slug, '') NOT IN (SELECT source FROM documents WHERE source < 'src3')")
def unassigned_files(t: Tables):
    """Jobs of no directory, or of one that the (cut) list doesn't have."""
    return catalog.unassigned(with_slug(t), directories(t).filter("slug < 'src3'")).select("job_id", "slug")


@query("SELECT category, count(*) AS n FROM (SELECT unnest([lang, source]) AS category FROM documents) GROUP BY category")
def category_histogram(t: Tables):
    """Counts of a multi-valued field."""
    return t.read("documents").select(F.explode(F.array("lang", "source")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS} SELECT job_id, 'PROCESSING' AS status, created_at FROM jobs WHERE status = 'PENDING' ORDER BY created_at, job_id LIMIT 64")
def claim_pending(t: Tables):
    """The 64 oldest pending jobs."""
    return catalog.claim(t.jobs(), 64).select("job_id", "status", "created_at")


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'PROCESSING' AND {NOW} - created_at > 3600 THEN 'PENDING' ELSE status END AS status FROM jobs")
def reap_stale(t: Tables):
    jobs = t.jobs().withColumn("updated_at", F.col("created_at"))
    return catalog.reap_stale(jobs, NOW).select("job_id", "status")


@query(f"WITH {SLUGGED} SELECT job_id, CASE WHEN status = 'FAILED' AND slug = 'src2' THEN 'PENDING' ELSE status END AS status FROM slugged")
def retry_failed(t: Tables):
    return catalog.retry_failed(with_slug(t), "src2").select("job_id", "status")


@query(f"WITH {SLUGGED} SELECT job_id, CASE WHEN slug = 'src1' AND status IN ('PENDING', 'PROCESSING', 'COMPLETED', 'FAILED') THEN 'EXCLUDED' ELSE status END AS status FROM slugged")
def exclude_directory(t: Tables):
    return catalog.transition(with_slug(t), "EXCLUDED", F.col("slug") == "src1").select("job_id", "status")


@query(f"""WITH {JOBS} SELECT job_id, CASE WHEN k % 13 = 0 THEN 'EXCLUDED' WHEN value < 1 THEN 'FAILED' WHEN k % 9 = 0 THEN 'FAILED' ELSE status END AS status,
CASE WHEN k % 13 = 0 THEN NULL WHEN value < 1 THEN 'file is missing or empty' WHEN k % 9 = 0 THEN 'no chunks' END AS error FROM jobs""")
def ingest_guards(t: Tables):
    """Checks of a job before and after chunking, in their order."""
    jobs = t.jobs().withColumns({"is_excluded": F.col("k") % 13 == 0, "file_size": F.when(F.col("value") >= 1, 1).otherwise(0), "num_chunks": F.col("k") % 9})
    return catalog.guard(jobs).select("job_id", "status", "error")


def named(t: Tables):
    """Jobs as files with a name, a content hash and a directory."""
    return with_slug(t).select("job_id", F.col("file_id").cast("string").alias("file_id"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("filename"), F.floor(F.col("value") / 10).cast("string").alias("content_hash"), "slug", "status")


NAMED = f"{SLUGGED}, named AS (SELECT job_id, file_id::VARCHAR AS file_id, 'f' || k AS filename, floor(value / 10)::BIGINT::VARCHAR AS content_hash, slug, status FROM slugged)"


@query(f"""WITH {NAMED}, new AS (SELECT job_id, filename, content_hash, slug FROM named WHERE status = 'PENDING'), old AS (SELECT * FROM named WHERE status <> 'PENDING')
SELECT new.job_id, min(CASE WHEN old.content_hash = new.content_hash AND old.status <> 'FAILED' THEN old.file_id END) AS duplicate_of,
  coalesce(string_agg(DISTINCT CASE WHEN old.content_hash <> new.content_hash THEN old.file_id END, ',' ORDER BY CASE WHEN old.content_hash <> new.content_hash THEN old.file_id END), '') AS supersedes
FROM new LEFT JOIN old ON new.filename = old.filename AND new.slug IS NOT DISTINCT FROM old.slug GROUP BY new.job_id""")
def attach_dedupe(t: Tables):
    """Pending files against the others of their name and directory."""
    rows = named(t)
    new = rows.filter("status = 'PENDING'").select("job_id", "filename", "content_hash", "slug")
    groups = catalog.attach_groups(new, rows.filter("status <> 'PENDING'"))
    # a list is written out once for all of its jobs
    out = groups.select("new", "duplicate_of", F.array_join("supersedes_file_ids", ",").alias("supersedes"))
    return out.select(F.explode("new.job_id").alias("job_id"), "duplicate_of", "supersedes")


@query(f"WITH {JOBS} SELECT job_id FROM jobs WHERE file_id NOT IN (SELECT file_id + 1 FROM jobs WHERE status = 'COMPLETED' AND k % 4 = 0)")
def supersede_cleanup(t: Tables):
    """Jobs of files that no completed job replaces."""
    jobs = t.jobs().withColumn("supersedes_file_ids", F.when(F.col("k") % 4 == 0, F.array(F.col("file_id") + 1)).otherwise(F.array().cast("array<bigint>")))
    return jobs.join(catalog.superseded(jobs), "file_id", "left_anti").select("job_id")


@query("""WITH f AS (SELECT doc_id::VARCHAR AS file_id, source AS slug FROM documents)
SELECT file_id, CASE WHEN file_id::BIGINT % 10 = 0 THEN 128 WHEN slug = 'src1' THEN 256 ELSE 512 END::BIGINT AS chunk_max_tokens, CASE WHEN slug = 'src1' THEN false ELSE true END AS relations_enabled, CASE WHEN slug = 'src2' THEN 'dir' ELSE 'store' END AS labels FROM f""")
def schema_cascade(t: Tables):
    """Extraction settings from file, directory, store and default, field by field."""
    files = t.read("documents").select(F.col("doc_id").cast("string").alias("file_id"), F.col("source").alias("slug"), F.lit("vs").alias("store_id"))
    kinds = "scope string, ident string, chunk_max_tokens long, relations_enabled boolean, labels string"
    fixed = t.spark.createDataFrame([("dir", "src1", 256, False, None), ("dir", "src2", None, None, "dir"), ("store", "vs", None, True, "store")], kinds)
    of_files = files.filter("CAST(file_id AS BIGINT) % 10 = 0").select(F.lit("file").alias("scope"), F.col("file_id").alias("ident"), F.lit(128).cast("long").alias("chunk_max_tokens"), F.lit(None).cast("boolean").alias("relations_enabled"), F.lit(None).cast("string").alias("labels"))
    out = catalog.schema_cascade(files, fixed.unionByName(of_files), {"chunk_max_tokens": 512, "relations_enabled": True, "labels": ""})
    return out.select("file_id", F.col("chunk_max_tokens").cast("long").alias("chunk_max_tokens"), "relations_enabled", "labels")


@query(f"WITH {JOBS} SELECT job_id AS run_id, k AS type, created_at AS started_at FROM jobs QUALIFY row_number() OVER (PARTITION BY k ORDER BY created_at DESC, job_id DESC) <= 5")
def runs_retention(t: Tables):
    """The newest five runs of each type."""
    runs = t.jobs().select(F.col("job_id").alias("run_id"), F.col("k").alias("type"), F.col("created_at").alias("started_at"))
    return catalog.retain_runs(runs)


@query(f"WITH {JOBS} SELECT job_id FROM jobs WHERE status <> 'EXCLUDED' AND created_at <= {NOW}")
def schedules_due(t: Tables):
    rows = t.jobs().select("job_id", (F.col("status") != "EXCLUDED").alias("enabled"), F.col("created_at").alias("next_run"))
    return catalog.due(rows, NOW).select("job_id")


@query(f"WITH {JOBS}, p AS (SELECT job_id AS id, created_at FROM jobs WHERE created_at < {NOW} OR (created_at = {NOW} AND job_id > 100) ORDER BY created_at DESC, job_id LIMIT 21) SELECT id, created_at, (SELECT count(*) FROM p) > 20 AS has_more FROM p ORDER BY created_at DESC, id LIMIT 20")
def listing_page(t: Tables):
    """A page of 20 after a key, newest first."""
    return catalog.page(t.jobs().select(F.col("job_id").alias("id"), "created_at"), 20, after=(NOW, 100))


@query(f"WITH {JOBS}, c AS (SELECT count(*) AS jobs, count(DISTINCT file_id) AS files, count(*) FILTER (status = 'FAILED') AS failed FROM jobs) SELECT sha256(failed || '|' || files || '|' || jobs) AS fingerprint FROM c")
def overview_fingerprint(t: Tables):
    """The key under which an overview is cached."""
    counts = t.jobs().agg(F.count("*").alias("jobs"), F.count_distinct("file_id").alias("files"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return catalog.fingerprint(counts)


@query("SELECT source AS slug, lang AS category, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) * 1024 AS usage_bytes FROM documents GROUP BY CUBE (source, lang)")
def overview(t: Tables):
    """Documents by directory and category with all subtotals (an extension: the cube)."""
    return t.read("documents").cube(F.col("source").alias("slug"), F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), (F.count("*") * 1024).alias("usage_bytes"))


RUN_SECONDS = 30 * 86400


def run_key():
    return F.concat_ws(":", F.col("file_id").cast("string"), F.col("k").cast("string"))


def runs(t: Tables):
    """Jobs in process as runs; a file and its k are what they run for."""
    j = t.jobs()
    return j.select(F.col("job_id").alias("run_id"), run_key().alias("key"), F.when(F.col("status") == "PROCESSING", "running").otherwise("completed").alias("status"), F.col("created_at").alias("updated_at"))


@query(f"WITH {JOBS} SELECT job_id AS run_id, CASE WHEN status <> 'PROCESSING' THEN 'completed' WHEN {NOW} - created_at > {RUN_SECONDS} THEN 'failed' ELSE 'running' END AS status, CASE WHEN status = 'PROCESSING' AND {NOW} - created_at > {RUN_SECONDS} THEN 'timed out' END AS error FROM jobs")
def expire_runs(t: Tables):
    """Runs that have given no sign of life for too long."""
    return catalog.expire_runs(runs(t), NOW, RUN_SECONDS).select("run_id", "status", "error")


@query(f"WITH {JOBS} SELECT concat_ws(':', file_id, k) AS key, job_id AS request_id FROM jobs WHERE status = 'PENDING' AND concat_ws(':', file_id, k) NOT IN (SELECT concat_ws(':', file_id, k) FROM jobs WHERE status = 'PROCESSING' AND {NOW} - created_at <= {RUN_SECONDS}) QUALIFY row_number() OVER (PARTITION BY concat_ws(':', file_id, k) ORDER BY created_at, job_id) = 1")
def single_flight(t: Tables):
    """One pending run for each file and k that have none alive."""
    asked = t.jobs().filter("status = 'PENDING'").select(run_key().alias("key"), F.col("job_id").alias("request_id"), "created_at")
    return catalog.single_flight(asked, runs(t), NOW, RUN_SECONDS)


@query("SELECT label AS category, count(*) AS points, count(*) * 1024 AS usage_bytes FROM embeddings GROUP BY label")
def usage_bytes(t: Tables):
    return catalog.usage(t.points(), "category")


@query("SELECT item_id, length(coalesce(text, ''))::BIGINT AS total_tokens FROM benchmark")
def query_usage(t: Tables):
    """What a query counts for: its characters."""
    return t.read("benchmark").select("item_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("total_tokens"))
