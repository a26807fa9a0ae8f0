"""What a corpus holds: one dictionary of small frames, for a store or for a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators import catalog, curation, filters, graph
from corpusforge.plans.store import Store

CACHE, MARKS = "overviews", "overview_marks"


def overview(files: DataFrame, jobs: DataFrame, chunks: DataFrame, slugs: list[str] | None = None, points: DataFrame | None = None, mentions: DataFrame | None = None, entities: DataFrame | None = None) -> dict[str, DataFrame]:
    """files: file_id, slug, category; jobs and chunks carry a file_id.

    With slugs everything is counted inside them, and topics, which span the whole
    store, are left out.
    """
    inside = files.filter(filters.scope(slugs))
    ids = inside.select("file_id")
    own_jobs = jobs if not slugs else jobs.join(ids, "file_id", "left_semi")
    own_chunks = chunks if not slugs else chunks.join(ids, "file_id", "left_semi")
    out = {
        "statuses": catalog.file_counts(own_jobs),
        "directories": inside.groupBy("slug").agg(F.count_distinct("file_id").alias("files")).orderBy(F.desc("files"), "slug"),
        "categories": inside.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category"),
        "curation": curation.curation_stats(own_chunks, ids.agg(F.count_distinct("file_id").alias("total"))),
    }
    out["fingerprint"] = catalog.fingerprint(out["statuses"].join(out["curation"]))  # one row each
    if not slugs and points is not None:
        found = curation.semantic_clusters(points)
        out["topics"] = curation.cluster_profile(found.join(points.select("id", "category"), "id").withColumn("file_id", F.col("id")))
    if not slugs and mentions is not None and entities is not None:
        out["graph"] = graph.graph_stats({"entities": entities, "mentions": mentions})
    return out


def marks(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """(slug, mark): a fingerprint of each directory's files and jobs, which reads no chunk.

    It holds the rows' ids, statuses, categories and times in any order, so that a job that
    is added, ends or goes changes it.
    """
    one = files.select("slug", F.xxhash64(F.lit("file"), "file_id", "category").alias("h"))
    two = jobs.join(files.select("file_id", "slug"), "file_id").select("slug", F.xxhash64(F.lit("job"), "file_id", "job_id", "status", "created_at").alias("h"))
    return one.unionByName(two).groupBy("slug").agg(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor("h").cast("string"), F.bit_xor(F.xxhash64("h")).cast("string")).alias("mark"))


def sections(files: DataFrame, jobs: DataFrame, chunks: DataFrame, ratio: float = 0.5, min_docs: int = 5) -> DataFrame:
    """(slug, section, name, n): every directory's statuses, categories and curation figures."""
    slug = files.select("file_id", "slug")
    counts = catalog.file_counts(jobs.join(slug, "file_id"), ["slug"])
    names = [c for c in counts.columns if c != "slug"]
    unpivot = lambda df, section, cols: df.select("slug", F.lit(section).alias("section"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in cols])).alias("x")).select("slug", "section", "x.name", "x.n")
    categories = files.groupBy("slug", "category").agg(F.count("*").alias("n")).select("slug", F.lit("categories").alias("section"), F.col("category").alias("name"), "n")
    total = files.groupBy("slug").agg(F.count_distinct("file_id").alias("total_documents"))
    bodies = chunks.join(slug, "file_id").groupBy("slug", "body_hash").agg(F.count_distinct("file_id").alias("doc_count")).join(total, "slug")
    boiler = (F.col("doc_count") >= min_docs) & (F.col("doc_count") / F.col("total_documents") >= ratio)
    curated = bodies.groupBy("slug").agg(F.max("total_documents").alias("total_documents"), F.count("*").alias("distinct_contents"), F.count_if(boiler).alias("boilerplate_contents"), F.max("doc_count").alias("max_doc_count"))
    return unpivot(counts, "statuses", names).unionByName(categories).unionByName(unpivot(curated, "curation", ["total_documents", "distinct_contents", "boilerplate_contents", "max_doc_count"]))


def cached(store: Store, files: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``sections`` of all directories, computed for those alone whose mark has changed.

    Results and marks are tables of the store, in buckets of directories, and change in one
    version. Where every mark stands, chunks aren't read at all; directories that are gone
    go from the cache. Files without a directory have none.
    """
    files = files.filter("slug IS NOT NULL")
    change = store.change()
    now = marks(files, jobs)
    if MARKS in change.tables:
        known = change.rows(MARKS)
        fresh = now.join(known, ["slug", "mark"], "left_anti")
        gone = known.join(now, "slug", "left_anti").select("slug")
    else:
        fresh, gone = now, now.limit(0).select("slug")
    path = change._write(fresh, False)
    fresh = store.spark.read.schema(now.schema).parquet(f"{store.path}/data/{path}")
    changed, left = not fresh.isEmpty(), not gone.isEmpty()
    if changed:
        some = files.join(fresh.select("slug"), "slug", "left_semi")
        ids = some.select("file_id")
        inside = lambda df: df.join(ids, "file_id", "left_semi")
        change.upsert(CACHE, sections(some, inside(jobs), inside(chunks)), "slug")
        change.upsert(MARKS, fresh, "slug")
    if left:
        change.delete(CACHE, gone)
        change.delete(MARKS, gone)
    if changed or left:
        change.commit()
    return store.read(CACHE)
