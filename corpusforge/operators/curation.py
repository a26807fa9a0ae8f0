"""Corpus curation: provenance of bodies, boilerplate, redundancy, outliers, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import embeddings
from corpusforge.operators import nearest
from corpusforge.session import fresh_path


def body_provenance(chunks: DataFrame) -> DataFrame:
    """(body_hash, doc_count): in how many files each body stands."""
    return chunks.groupBy("body_hash").agg(F.count_distinct("file_id").alias("doc_count"))


def boilerplate(bodies: DataFrame, total_docs: int | DataFrame, ratio: float = 0.5, min_docs: int = 5) -> DataFrame:
    """Bodies in at least ``min_docs`` files and at least that share of all (if any)."""
    if isinstance(total_docs, DataFrame):
        joined = bodies.join(F.broadcast(total_docs.select(F.col(total_docs.columns[0]).alias("total"))))  # one row
    else:
        joined = bodies.withColumn("total", F.lit(total_docs).cast("long"))
    share = (F.col("total") <= 0) | (F.col("doc_count") / F.col("total") >= ratio)
    return joined.filter((F.col("doc_count") >= min_docs) & share).drop("total")


def curation_stats(chunks: DataFrame, total: DataFrame, ratio: float = 0.5, min_docs: int = 5) -> DataFrame:
    bodies = body_provenance(chunks).join(F.broadcast(total.select(F.col(total.columns[0]).alias("total"))))  # one row
    boiler = (F.col("doc_count") >= min_docs) & ((F.col("total") <= 0) | (F.col("doc_count") / F.col("total") >= ratio))
    return bodies.agg(
        F.max("total").alias("total_documents"),
        F.count("*").alias("distinct_contents"),
        F.count_if(boiler).alias("boilerplate_contents"),
        F.max("doc_count").alias("max_doc_count"),
    )


def purge_file(provenance: DataFrame, file_ids: list[str]) -> DataFrame:
    """(body_hash, files) without these files; bodies left with none go."""
    left = provenance.withColumn("files", F.filter("files", lambda f: ~f.isin(file_ids)))
    return left.filter(F.size("files") > 0)


def checkpoint_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder in spark.checkpoint.dir and read back, to cut lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of undirected edges (a, b): the least id that is reachable.

    Each round takes the least label of the neighbours and then that label's own,
    so labels travel in doubling steps; rounds are written to the shared folder.
    """
    both = checkpoint_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = checkpoint_table(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")), "components")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        least = checkpoint_table(labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "m").alias("next"), F.col("component").alias("was")), "components")
        up = least.select(F.col("id").alias("next"), F.col("next").alias("component"))
        labels = checkpoint_table(least.join(up, "next").select("id", "component", (F.col("component") != F.col("was")).alias("moved")), "components")
        if labels.filter("moved").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def neighbour_edges(scored: DataFrame, k: int = 20) -> DataFrame:
    """Symmetric closure (a < b) of each id's best k of (id, other, score)."""
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    top = scored.withColumn("_n", best).filter(F.col("_n") <= k)
    return top.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def similar_pairs(points: DataFrame, threshold: float, digits: int = 6, block_rows: int | None = None) -> DataFrame:
    """(id, other, score) of all pairs of unit embeddings at least so alike, both ways.

    Blocks of embeddings are broadcast and multiplied with all others, so embeddings
    aren't shuffled for each block, and a task holds a bounded table of scores.
    """
    found = nearest.dense(points, points.select(F.col("id").alias("query_id"), "embedding"), None, threshold, digits, block_rows)
    return found.filter("id <> query_id").select(F.col("query_id").alias("id"), F.col("id").alias("other"), "score")


def _banded_classes(points: DataFrame, threshold: float, digits: int, miss: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, a, score) of each embedding, its class and its likeness to itself; (a, b, score) of alike classes, a < b.

    Equal embeddings are one class, named by its least id. Signs against random planes
    are cut into bands, as many as leave a pair at the threshold out with a chance of
    ``miss``; classes that share a band are compared exactly.
    """
    from math import acos, ceil, log, pi

    import numpy as np
    import pandas as pd

    agree = 1 - acos(min(threshold, 1 - 1e-9)) / pi
    bits = min(48, max(4, int(log(0.25) / log(agree))))
    bands = ceil(log(miss) / log(1 - agree**bits))
    kind = dict(points.dtypes)["id"]
    rows = points.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    classes = rows.groupBy("embedding").agg(F.min("id").alias("id"))

    def sign(frames):
        planes = None
        for pdf in frames:
            if not len(pdf):
                continue
            v = np.stack(pdf["embedding"])
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((v.shape[1], bits * bands))
            signs = ((v @ planes) > 0).reshape(len(v), bands, bits)
            keys = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            yield pd.DataFrame({"id": pdf["id"], "keys": list(keys)})

    placed = classes.select("id", "embedding").mapInPandas(sign, f"id {kind}, keys array<bigint>").select("id", F.posexplode("keys").alias("band", "key"))
    x, y = placed.alias("x"), placed.alias("y")
    near = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    va, vb = classes.select(F.col("id").alias("a"), F.col("embedding").alias("va")), classes.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    scored = near.join(va, "a").join(vb, "b").select("a", "b", F.round(embeddings.dot("va", "vb"), digits).alias("score")).filter(F.col("score") >= threshold)
    first = rows.join(classes.withColumnRenamed("id", "a"), "embedding")
    return first.select("id", "a", F.round(embeddings.dot("embedding", "embedding"), digits).alias("score")), scored


def banded_pairs(points: DataFrame, threshold: float, digits: int = 6, miss: float = 1e-6, seed: int = 17) -> DataFrame:
    """The pairs of ``similar_pairs`` for high thresholds, without comparing all blocks.

    Copies of an embedding are paired with their least id alone, and only that one with others.
    """
    first, scored = _banded_classes(points, threshold, digits, miss, seed)
    one = scored.union(first.filter("id <> a").select("a", F.col("id").alias("b"), "score"))
    return one.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").union(one.select("b", "a", "score"))


def banded_edges(points: DataFrame, threshold: float, k: int = 20, digits: int = 6, miss: float = 1e-6, seed: int = 17) -> DataFrame:
    """``neighbour_edges`` of all ``similar_pairs``, every copy's among them, for high thresholds.

    The best k of an embedding are among the best k + 1 of its class, itself being one,
    and those among the least k + 1 ids of each alike class: so copies make at most
    k + 1 rows each.
    """
    first, scored = _banded_classes(points, threshold, digits, miss, seed)
    itself = first.filter((F.col("id") == F.col("a")) & (F.col("score") >= threshold)).select("a", F.col("a").alias("b"), "score")
    links = scored.union(scored.select("b", "a", "score")).union(itself)
    least = F.row_number().over(Window.partitionBy("b").orderBy("other"))
    heads = first.select(F.col("a").alias("b"), F.col("id").alias("other")).withColumn("_n", least).filter(F.col("_n") <= k + 1).drop("_n")
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "other"))
    nearest = links.join(heads, "b").withColumn("_n", best).filter(F.col("_n") <= k + 1).select("a", "other", "score")
    return neighbour_edges(first.select("id", "a").join(nearest, "a").filter("id <> other").select("id", "other", "score"), k)


#: From this likeness on, bands find pairs with few planes; below it blocks are compared.
BANDED = 0.9


def dense_edges(points: DataFrame, dense: float = 0.96, k: int = 20) -> DataFrame:
    """(a, b), a < b: pairs within one's best k by embedding."""
    if dense >= BANDED:
        return banded_edges(points, dense, k)
    # one more than k, as an id may be among its own best
    found = nearest.dense(points, points.select(F.col("id").alias("query_id"), "embedding"), k + 1, dense).filter("id <> query_id")
    return neighbour_edges(found.select(F.col("query_id").alias("id"), F.col("id").alias("other"), "score"), k)


def sparse_edges(weights: DataFrame | nearest.Vectors, ids: DataFrame, k: int = 20) -> DataFrame:
    """(a, b), a < b: the best k by shared terms of each of the ids, found by bounds."""
    index = weights if isinstance(weights, nearest.Vectors) else nearest.vectors(weights)
    # one more than k, as an id may be among its own best
    found = nearest.sparse(index, index.rows.join(ids, "id", "left_semi").withColumnRenamed("id", "query_id"), k + 1).filter("query_id <> id")
    return neighbour_edges(found.select(F.col("query_id").alias("id"), F.col("id").alias("other"), "score"), k)


def near_duplicate_parts(points: DataFrame, weights: DataFrame | nearest.Vectors, dense: float = 0.96, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates, alike by embedding and by terms; and variants, alike by embedding alone."""
    by_embedding = checkpoint_table(dense_edges(points, dense, k), "dense_edges")
    # only ids that have a dense neighbour can keep an edge
    ids = by_embedding.select(F.col("a").alias("id")).union(by_embedding.select("b")).distinct()
    by_terms = checkpoint_table(sparse_edges(weights, ids, k), "sparse_edges")
    return by_embedding.intersect(by_terms), by_embedding.join(by_terms, ["a", "b"], "left_anti")


def near_duplicate_edges(points: DataFrame, weights: DataFrame | nearest.Vectors, dense: float = 0.96, k: int = 20) -> DataFrame:
    """Pairs within each other's best k by embedding that are also among the best k by shared terms."""
    return near_duplicate_parts(points, weights, dense, k)[0]


def redundancy_stats(components: DataFrame, total: int) -> DataFrame:
    """Points, clusters, redundant = what clusters hold over one each, kept, per cent."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.lit(total).cast("long").alias("points"),
        F.count("*").alias("clusters"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"),
    ).withColumn("kept", F.col("points") - F.col("redundant")).withColumn("pct", F.round(100 * F.col("redundant") / F.greatest(F.col("points"), F.lit(1)), 1))


def largest_clusters(components: DataFrame, n: int = 8) -> DataFrame:
    """(component, size) of the n largest clusters, the least component first of equals."""
    return components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(n)


def mark_redundant(points: DataFrame, components: DataFrame, as_text: bool = True) -> DataFrame:
    """``redundant``: in a cluster, and not its least id (compared as text by default)."""
    order = F.col("id").cast("string") if as_text else F.col("id")
    first = components.groupBy("component").agg(F.min_by("id", order).alias("first"))
    extra = components.join(first, "component").filter("id <> first").select("id", F.lit(True).alias("redundant"))
    return points.join(extra, "id", "left").withColumn("redundant", F.coalesce("redundant", F.lit(False)))


def centroid(points: DataFrame, digits: int = 12) -> DataFrame:
    """One row with the normalised mean of the unit embeddings."""
    dims = points.select(F.posexplode(embeddings.normalize("embedding")).alias("d", "x")).groupBy("d").agg(F.round(F.avg("x"), digits).alias("x"))
    return dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c")).select(embeddings.normalize("c").alias("c"))


def semantic_outliers(points: DataFrame, threshold: float = 0.35, digits: int = 6) -> DataFrame:
    """(id, similarity) of points far from the centroid; none among fewer than three."""
    enough = points.limit(3).count() >= 3
    return centroid_similarity(points, digits).filter((F.col("similarity") < threshold) & F.lit(enough))


def centroid_similarity(points: DataFrame, digits: int = 6) -> DataFrame:
    """(id, similarity) of each point to the centroid, which is one row."""
    return points.join(F.broadcast(centroid(points))).select("id", F.round(embeddings.dot(embeddings.normalize("embedding"), "c"), digits).alias("similarity"))


def outlier_summary(points: DataFrame, threshold: float = 0.35, digits: int = 6) -> DataFrame:
    """One row: points, outliers, their per cent, mean similarity; fewer than three points have neither."""
    out = centroid_similarity(points, digits).agg(F.count("*").alias("points"), F.count_if(F.col("similarity") < threshold).alias("n"), F.avg("similarity").alias("mean"))
    enough = F.col("points") >= 3
    return out.select(
        "points",
        F.when(enough, F.col("n")).otherwise(F.lit(0)).alias("outliers"),
        F.when(enough, F.round(100 * F.col("n") / F.col("points"), 1)).otherwise(F.lit(0.0)).alias("outlier_pct"),
        F.when(enough, F.round("mean", 3)).otherwise(F.lit(0.0)).alias("mean_similarity"),
    )


def outlier_samples(points: DataFrame, n: int = 25, digits: int = 6) -> DataFrame:
    """The n points least like the centroid, the least id first of equals; none among fewer than three."""
    enough = points.limit(3).count() >= 3
    return centroid_similarity(points, digits).filter(F.lit(enough)).orderBy("similarity", "id").limit(n)


def semantic_clusters(points: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """(id, cluster) by cosine k-means; k is the rounded root of half the points, 2 to 30."""
    from pyspark.ml.clustering import KMeans

    n = points.count()
    if n < 2:
        return points.select("id", F.lit(0).alias("cluster"))
    k = k or min(30, max(2, round((n / 2) ** 0.5)))
    rows = points.select("id", embeddings.features("embedding").alias("features"))
    model = KMeans(k=min(k, n), seed=seed, distanceMeasure="cosine", maxIter=20).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))


def cluster_profile(rows: DataFrame, top: int = 3) -> DataFrame:
    """Per cluster (id, cluster, file_id, category): size, files, dominant category, top files."""

    def ranked(column: str, n: int) -> DataFrame:
        counts = rows.filter(F.col(column).isNotNull()).groupBy("cluster", column).agg(F.count("*").alias("n"))
        best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), column))
        kept = counts.withColumn("r", best).filter(F.col("r") <= n)
        return kept.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", column))), lambda s: s[column].cast("string")).alias(f"top_{column}"))

    base = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.count_distinct("file_id").alias("files"))
    out = base.join(ranked("category", 1), "cluster", "left").join(ranked("file_id", top), "cluster", "left")
    return out.select("cluster", "size", "files", F.try_element_at("top_category", F.lit(1)).alias("label"), F.array_join("top_file_id", ",").alias("top_files"))
