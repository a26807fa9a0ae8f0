"""Reconciliation of a remote listing (documents) with the catalog (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import sync
from corpusforge.plans.projections import Tables
from corpusforge.queries.registry import query
from corpusforge.queries.shared import JOBS

EXTENSIONS = [".pdf", ".txt", ".md"]
INCLUDE = [("pattern", "doc_1, DOC_2"), ("pattern", "doc_3"), ("regex", r"doc_\d+\.")]
EXCLUDE = [("pattern", "99"), ("regex", r"doc_1")]


def remote(t: Tables):
    """Documents as remote files; every eighth has an unknown extension."""
    ending = F.when(F.col("doc_id") % 8 == 0, ".exe").when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(".txt")
    return t.read("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ending).alias("name"), F.col("n_chars").alias("size"), (F.col("n_chars") % 10).cast("string").alias("modified"))


def jobs(t: Tables):
    return _roles(t.jobs())


def current(t: Tables):
    """The latest job of each file."""
    latest = t.jobs().groupBy("file_id").agg(F.max_by(F.struct("job_id", "status", "k"), F.struct("created_at", "job_id")).alias("j"))
    return _roles(latest.select("file_id", "j.*"))


def _roles(rows):
    return rows.select("job_id", F.col("file_id").cast("string").alias("file_id"), F.col("file_id").alias("remote_id"), "status", (F.col("k") % 10).cast("string").alias("remote_modified"))


REMOTE = "remote AS (SELECT doc_id AS id, 'doc_' || doc_id || CASE WHEN doc_id % 8 = 0 THEN '.exe' WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.txt' END AS name, n_chars AS size, (n_chars % 10)::VARCHAR AS modified FROM documents)"
LATEST = "latest AS (SELECT * FROM indexed QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, job_id DESC) = 1)"
INDEXED = f"{JOBS}, indexed AS (SELECT job_id, file_id::VARCHAR AS file_id, file_id AS remote_id, status, (k % 10)::VARCHAR AS remote_modified, created_at FROM jobs)"
DECIDED = f"""{INDEXED}, {LATEST}, {REMOTE}, decided AS (
  SELECT r.*, CASE WHEN id % 8 = 0 THEN 'extension' WHEN size > 10000 THEN 'size' WHEN id % 50 = 7 THEN 'excluded'
    WHEN NOT ((contains(lower(name), 'doc_1') OR contains(lower(name), 'doc_2') OR contains(lower(name), 'doc_3')) AND regexp_matches(name, '^(?:doc_\\d+\\.)')) THEN 'include_rules'
    WHEN contains(lower(name), '99') AND regexp_matches(name, '^(?:doc_1)') THEN 'exclude_rules'
    WHEN EXISTS (SELECT 1 FROM latest i WHERE i.remote_id = r.id AND status IN ('PENDING', 'PROCESSING')) THEN 'in_flight'
    WHEN EXISTS (SELECT 1 FROM latest i WHERE i.remote_id = r.id AND status = 'COMPLETED' AND remote_modified = r.modified) THEN 'unchanged'
    ELSE 'included' END AS reason FROM remote r)"""


def decided(t: Tables):
    out = remote(t).filter("id % 50 = 7").select(F.col("id").alias("remote_id"))
    return sync.admission(remote(t), current(t), EXTENSIONS, INCLUDE, EXCLUDE, out, max_size=10_000)


@query(f"WITH {DECIDED} SELECT id, reason, reason = 'included' AS included FROM decided")
def sync_admission(t: Tables):
    """Why each remote file is or isn't taken in; the first reason counts."""
    return decided(t).select("id", "reason", "included")


@query(f"WITH {DECIDED} SELECT count(*) AS found, count(*) FILTER (reason = 'included') AS processed, count(*) FILTER (reason <> 'included') AS skipped, coalesce(sum(size) FILTER (reason = 'included'), 0)::BIGINT AS bytes FROM decided")
def sync_summary(t: Tables):
    return sync.summary(decided(t))


@query(f"WITH {INDEXED}, {REMOTE} SELECT r.id, i.file_id, count(*) AS n FROM remote r JOIN indexed i ON r.id = i.remote_id WHERE status = 'FAILED' OR (status = 'COMPLETED' AND remote_modified <> modified) GROUP BY ALL")
def sync_superseded(t: Tables):
    return sync.superseded_by_sync(remote(t), jobs(t)).groupBy("id", "file_id").agg(F.count("*").alias("n"))


@query(f"WITH {INDEXED}, {REMOTE} SELECT job_id, remote_id FROM indexed WHERE remote_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def deleted_remote(t: Tables):
    """Jobs whose remote file is gone: the listing has no file in English."""
    listing = t.read("documents").filter("lang <> 'en'").select(F.col("doc_id").alias("id"))
    return sync.deleted_remotely(jobs(t), listing).select("job_id", "remote_id")


@query("""WITH j AS (SELECT o_orderkey AS job_id, list_sort([o_custkey % 400, (o_custkey + 1) % 400]) AS folders FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT folders, min(job_id) AS class_id, count(*) AS n FROM j GROUP BY folders), f AS (SELECT class_id, n, unnest(folders) AS folder FROM c),
p AS (SELECT DISTINCT x.class_id, y.class_id AS other, y.n FROM f x JOIN f y USING (folder)), l AS (SELECT class_id, (sum(n) - 1)::BIGINT AS links FROM p GROUP BY class_id)
SELECT job_id, class_id, links FROM j JOIN c USING (folders) JOIN l USING (class_id)""")
def sync_overlap(t: Tables):
    """Completed sync jobs with the number of others that share a folder; orders play the jobs."""
    folders = F.array(F.col("o_custkey") % 400, (F.col("o_custkey") + 1) % 400)
    rows = t.read("orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("status"), folders.alias("folder_ids"))
    return sync.overlapping_jobs(rows)


@query(f"WITH {JOBS} SELECT c_custkey AS sync_job_id, CASE WHEN c_custkey IN (SELECT file_id FROM jobs WHERE status IN ('PENDING', 'PROCESSING')) THEN 'PROCESSING' ELSE 'COMPLETED' END AS status FROM customer")
def sync_rollup(t: Tables):
    """Sync jobs are in process while one of their files is."""
    children = t.jobs().select(F.col("file_id").alias("sync_job_id"), "status")
    return sync.rolled_up(t.read("customer").select(F.col("c_custkey").alias("sync_job_id"), F.lit("COMPLETED").alias("status")), children)


@query(f"WITH {JOBS} SELECT job_id FROM jobs WHERE k % 4 = 0 OR k % 3 = k % 5")
def attribute_match(t: Tables):
    """Jobs with the attributes asked for; unsafe and reserved keys, and null, ask for nothing."""
    name = lambda n: F.concat(F.lit("t"), (F.col("k") % n).cast("string"))
    wanted = F.create_map(F.lit("kind"), name(3), F.lit("a.b"), F.lit("x"), F.lit("$c"), F.lit("y"), F.lit("sharepoint_file_id"), F.lit("z"))
    some = F.when(F.col("k") % 4 != 0, wanted)
    return t.jobs().filter("k IS NOT NULL").filter(sync.attributes_match(some, F.create_map(F.lit("kind"), name(5)))).select("job_id")
