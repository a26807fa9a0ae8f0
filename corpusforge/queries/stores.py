"""Queries over what the engine keeps: stores in buckets, provenance, folders, leases, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import catalog
from corpusforge.plans import overview, provenance
from corpusforge.plans.projections import Tables
from corpusforge.plans.store import Store, remove_files
from corpusforge.queries.registry import query
from corpusforge.queries.shared import JOBS, LINES
from corpusforge.session import fresh_path
from corpusforge.sources import paged
from corpusforge.streaming import leases


@query("""SELECT user_id AS file_id, event_id AS job_id, value FROM events WHERE user_id % 7 <> 0 AND user_id % 11 <> 0
UNION ALL SELECT DISTINCT user_id, -user_id, 0.0::DOUBLE FROM events WHERE user_id % 7 = 0 AND user_id % 11 <> 0""")
def store_upsert(t: Tables):
    """Files replaced and removed in a store, each change in the buckets it touches."""
    rows = t.jobs().select("file_id", "job_id", "value")
    store = Store(t.spark, fresh_path(t.spark, "store"))
    store.change().upsert("points", rows, "file_id", buckets=16).commit()
    new = rows.filter("file_id % 7 = 0").select("file_id", (-F.col("file_id")).alias("job_id"), F.lit(0.0).alias("value")).distinct()
    store.change().upsert("points", new, "file_id").commit()
    store.change().delete("points", rows.filter("file_id % 11 = 0").select("file_id")).commit()
    return store.read("points")


@query("SELECT user_id AS file_id, event_id AS job_id, value FROM events WHERE user_id % 20 = 0")
def store_lookup(t: Tables):
    """The rows of some files, from their buckets alone."""
    rows = t.jobs().select("file_id", "job_id", "value")
    store = Store(t.spark, fresh_path(t.spark, "store"))
    store.change().upsert("points", rows, "file_id").commit()
    return store.lookup("points", rows.filter("file_id % 20 = 0").select("file_id"))


@query("""SELECT 'points' AS "table", count(*) AS rows FROM events WHERE user_id % 9 = 0 UNION ALL
SELECT 'jobs', count(DISTINCT user_id) FROM events WHERE user_id % 9 = 0 UNION ALL
SELECT 'mentions', count(*) FROM (SELECT DISTINCT user_id, props::JSON->>'k' FROM events WHERE user_id % 9 = 0)""")
def file_removal(t: Tables):
    """What each table loses where files go from all of them in one version."""
    jobs = t.jobs()
    store = Store(t.spark, fresh_path(t.spark, "store"))
    change = store.change().upsert("points", jobs.select("file_id", "job_id", "value"), "file_id", buckets=16)
    change.upsert("mentions", jobs.select("file_id", "k").distinct(), "file_id", buckets=16)
    change.upsert("jobs", jobs.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", buckets=16).commit()
    gone = remove_files(store, jobs.filter("file_id % 9 = 0").select("file_id"), dict.fromkeys(("points", "mentions", "jobs"), "file_id"))
    return t.spark.createDataFrame(list(gone.items()), "table string, rows long")


@query(f"WITH {LINES} SELECT body_hash, count(DISTINCT file_id) AS doc_count FROM hashed WHERE file_id % 5 <> 0 GROUP BY body_hash")
def provenance_counts(t: Tables):
    """Document frequencies of bodies, kept up over three registrations, a repeated one and a removal."""
    pairs = t.chunks().select("file_id", "body_hash")
    store = Store(t.spark, fresh_path(t.spark, "bodies"))
    for i in (0, 1, 2, 0):
        provenance.register(store, pairs.filter(F.col("file_id") % 3 == i), buckets=16)
    provenance.purge(store, pairs.filter("file_id % 5 = 0").select("file_id").distinct())
    return provenance.counts(store)


@query("""WITH RECURSIVE e(parent, child) AS (SELECT 'r' || r_regionkey, 'n' || n_nationkey FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
w(id, depth) AS (SELECT 'r1', 0::BIGINT UNION ALL SELECT child, depth + 1 FROM w JOIN e ON parent = id) SELECT id, depth FROM w""")
def folder_levels(t: Tables):
    """All nations and customers below a region, level by level; each customer also holds its region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, customer = t.read("nation"), t.read("customer")
    one = nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    two = customer.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))
    back = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name("c", "c_custkey").alias("parent"), name("r", "n_regionkey").alias("child"))
    edges = one.unionByName(two).unionByName(back)
    return paged.walk(edges, one.filter("parent = 'r1'").select("parent").distinct())


@query()
def lease_replay(t: Tables):
    """Leases on users: asked for, renewed, given back and expired, as the stream gives them."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"signup": "request", "click": "request", "view": "beat", "purchase": "done", "error": "done"}.items() for x in kv]), F.col("event_type"))
    events = t.read("events").select(F.col("user_id").alias("key"), F.get_json_object("props", "$.k").alias("request_id"), kind.alias("kind"), "ts")
    return leases.replay(events, seconds=6 * 3600, requeue=False)


CACHED_SQL = f"""WITH {LINES.strip()}, {JOBS.strip()}, files AS (SELECT doc_id AS file_id, source AS slug, lang AS category FROM documents WHERE source IS NOT NULL),
st AS (SELECT slug, count(DISTINCT file_id) AS total, count(DISTINCT file_id) FILTER (status = 'COMPLETED') AS completed, count(DISTINCT file_id) FILTER (status IN ('PENDING', 'PROCESSING')) AS in_progress,
  count(DISTINCT file_id) FILTER (status = 'FAILED') AS failed, count(DISTINCT file_id) FILTER (status = 'EXCLUDED') AS excluded, 0::BIGINT AS cancelled FROM jobs JOIN files USING (file_id) GROUP BY slug),
tot AS (SELECT slug, count(DISTINCT file_id) AS n FROM files GROUP BY slug),
bod AS (SELECT slug, body_hash, count(DISTINCT file_id) AS dc FROM hashed JOIN files USING (file_id) GROUP BY ALL),
cur AS (SELECT slug, max(n) AS total_documents, count(*) AS distinct_contents, count(*) FILTER (dc >= 5 AND dc / n >= 0.5) AS boilerplate_contents, max(dc) AS max_doc_count FROM bod JOIN tot USING (slug) GROUP BY slug)
SELECT slug, 'statuses' AS section, name, n FROM (UNPIVOT st ON total, completed, in_progress, failed, excluded, cancelled INTO NAME name VALUE n)
UNION ALL SELECT slug, 'categories', category, count(*) FROM files GROUP BY ALL
UNION ALL SELECT slug, 'curation', name, n FROM (UNPIVOT cur ON total_documents, distinct_contents, boilerplate_contents, max_doc_count INTO NAME name VALUE n)"""


@query(CACHED_SQL)
def overview_cached(t: Tables):
    """Every directory's overview from a cache that was filled once and is then read."""
    files = t.read("documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("slug"), F.col("lang").alias("category"))
    store = Store(t.spark, fresh_path(t.spark, "overviews"))
    for _ in range(2):
        found = overview.cached(store, files, t.jobs(), t.chunks())
    return found


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[a-zA-ZàèéìòùÀÈÉÌÒÙ]+')) AS w FROM documents)
SELECT min(w) AS name, count(*) AS n, count(DISTINCT w) AS forms FROM w GROUP BY strip_accents(lower(w))""")
def names_collated(t: Tables):
    """Words that are equal to an Italian reader, accents and case aside."""
    words = t.read("documents").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zA-ZàèéìòùÀÈÉÌÒÙ]+)"), 1)).alias("w"))
    return catalog.same_names(words, "w")
