"""From files to points, sections, mentions and bodies; and the store's upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.operators import curation, entities, graph
from corpusforge.plans import store

POINTS = "points"


def enrich(chunks: DataFrame) -> DataFrame:
    """Chunks (file_id, chunk_index, headings, text) with ids, hashes, quality and entities.

    Ids follow from what they name, so a repeated run writes the same rows.
    """
    q = text.quality("text")
    return (
        chunks.withColumn("chunk_id", graph.chunk_id())
        .withColumn("point_id", F.sha2(F.concat_ws("|", F.col("file_id").cast("string"), F.col("chunk_index").cast("string")), 256))
        .withColumn("body_hash", text.body_hash("text", "headings"))
        .withColumn("_q", q)
        .withColumns({"quality_score": F.col("_q.quality_score"), "quality_flags": F.col("_q.quality_flags")})
        .drop("_q")
    )


def derive(enriched: DataFrame) -> dict[str, DataFrame]:
    """The tables that one set of enriched chunks gives."""
    found = entities.extract_entities(enriched)
    return {
        "points": enriched,
        "sections": graph.sections(enriched),
        "parents": graph.chunk_parents(enriched),
        "next": graph.next_edges(enriched),
        "mentions": graph.merge_mentions(found.select("chunk_id", F.concat_ws("::", "type", "normalized_name").alias("entity_id"), "score")),
        "entities": found.select(F.concat_ws("::", "type", "normalized_name").alias("entity_id"), "name", "type", "normalized_name").dropDuplicates(["entity_id"]),
        "bodies": enriched.select("file_id", "body_hash").distinct(),  # as plans.provenance registers them
    }


def replace_files(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """The old rows of files that aren't in the new ones, and the new rows: an idempotent upsert."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(new: DataFrame, path: str, key: str = "file_id", stream: str | None = None, batch: int | None = None) -> DataFrame:
    """Replace the new rows' files in the store at a path; only their buckets are written.

    A micro-batch that the store has noted as done is left out, so one that runs twice
    is written once.
    """
    place = store.Store(new.sparkSession, path)
    if stream is None or place.manifest()["batches"].get(stream, -1) < batch:
        place.change().upsert(POINTS, new, key).commit(stream, batch)
    return place.read(POINTS)


def snapshot(spark, path: str) -> DataFrame | None:
    """The newest version's rows at a path, or none."""
    return store.Store(spark, path).read(POINTS)


def optimize(entities_: DataFrame, mentions: DataFrame, relations: DataFrame, chunks: DataFrame, points: DataFrame | None = None, weights: DataFrame | None = None, dense: float = 0.96, diagnostics: bool = False) -> dict[str, DataFrame]:
    """Pruning counts, curation and redundancy statistics, and diagnostics if asked for."""
    total = chunks.agg(F.count_distinct("file_id").alias("total"))
    out = {"graph": graph.prune_stats(entities_, mentions, relations), "curation": curation.curation_stats(chunks, total)}
    if points is not None and weights is not None:
        clusters = curation.connected_components(curation.near_duplicate_edges(points, weights, dense))
        out["redundancy"] = curation.redundancy_stats(clusters, points.count())
    if diagnostics:
        out["conflicts"] = graph.conflicts(relations)
        if points is not None:
            out["outliers"] = curation.semantic_outliers(points)
    return out
