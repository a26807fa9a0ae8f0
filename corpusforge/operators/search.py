"""Retrieval: channels, fusion, ranking, suppression and reading.

A channel is a frame (query_id, id, score). Channels are cut to their best rows
per query by a window, which Spark plans as partial and final group limits, so a
query's candidates meet in one task only after each task has cut its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.operators import nearest
from corpusforge.operators.filters import keep_unless_empty

RRF_K = 60
#: A query side of at most this many rows is broadcast; a larger one is joined in blocks.
BROADCAST_QUERIES = 10_000
#: Partitions at most, where a size isn't known.
MOST_PARTS = 4_000


def top_k(df: DataFrame, k: int, order: list[Column], by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The best k rows of each group, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def dense_channel(points: DataFrame, queries: DataFrame, k: int = 150, threshold: float = 0.05, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank) by dot product of unit embeddings.

    Exact nearest neighbours of a stated set of queries, from products of blocks.
    Embeddings of another length than the query's, or with null components, are never found.
    """
    return top_k(nearest.dense(points, queries, k, threshold, digits), k, [F.desc("score"), F.asc("id")])


#: Bytes of stored texts in one partition whose words are counted.
PART_BYTES = 8 << 20


def text_parts(docs: DataFrame) -> int:
    """Partitions for work on the words of these texts: as many as keep each small, and no core idle."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(docs.sparkSession.sparkContext.defaultParallelism, min(MOST_PARTS, -(-size // PART_BYTES)))


def term_weights(docs: DataFrame, key: str, column: str) -> DataFrame:
    """The weights of words (id, term, weight): counts of each word of a text.

    Texts are dealt by id once: counts, and scores of a broadcast query set, are
    then complete in a text's own partition, and its words are never shuffled. The
    partitions grow in number with the texts, and not in size.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(column).alias("text")).repartition(text_parts(docs), "id")
    return rows.select("id", F.explode(text.tokens("text")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("weight"))


def sparse_channel(weights: DataFrame, queries: DataFrame, k: int = 150, threshold: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank) by inner product over shared terms (queries: query_id, term, weight).

    The plain join, for few queries, or for weights that aren't above 0; ``nearest.sparse`` gives the same
    rows for many queries.
    """
    q = queries.select("query_id", "term", F.col("weight").alias("qw"))
    scored = weights.join(q, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))
    return top_k(scored.filter(F.col("score") >= threshold), k, [F.desc("score"), F.asc("id")])


def rrf(channels: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of (query_id, channel, id, rank); ranks count from 1."""
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("channel")), w)
    return channels.groupBy("query_id", "id").agg(F.round(F.sum(w / (k + F.col("rank"))), digits).alias("score"))


def dbsf(channels: DataFrame, digits: int = 6) -> DataFrame:
    """Distribution-based fusion: scores scaled by mean and three deviations, then summed."""
    w = Window.partitionBy("query_id", "channel")
    mean, dev = F.avg("score").over(w), F.coalesce(F.stddev_samp("score").over(w), F.lit(0.0))
    scaled = F.when(dev == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") - (mean - 3 * dev)) / (6 * dev))))
    return channels.withColumn("scaled", scaled).groupBy("query_id", "id").agg(F.round(F.sum("scaled"), digits).alias("score"))


def first_by_text(rows: DataFrame, order: list[Column], column: str = "text", n: int = 200, by: str = "query_id") -> DataFrame:
    """The best row of each text that begins alike; blank texts go."""
    return first_by_head(rows.withColumn("_head", head_hash(column, n)), order, "_head", by).drop("_head")


def head_hash(column: str = "text", n: int = 200) -> Column:
    """What texts that begin alike have in common, in 32 bytes; null for blank ones.

    Worked out for each text before any join, so that rows which name a text need not carry it.
    """
    return text.let(text.head(column, n), lambda h: F.when(h != "", F.unhex(F.sha2(h, 256))))


def first_by_head(rows: DataFrame, order: list[Column], head: str = "head", by: str = "query_id") -> DataFrame:
    """The best row of each ``head_hash``; those without go."""
    best = F.row_number().over(Window.partitionBy(by, head).orderBy(*order))
    return rows.filter(F.col(head).isNotNull()).withColumn("_n", best).filter("_n = 1").drop("_n")


def lexical_channel(points: DataFrame, terms: list[str], limit: int = 30, legacy: bool = False) -> DataFrame:
    """(id, overlap) of texts with one of the terms.

    Sorted by overlap and then cut; ``legacy`` cuts by id first.
    """
    if not terms:
        return points.select("id", F.lit(0).cast("long").alias("overlap")).limit(0)
    hit = reduce(lambda a, b: a | b, [text.contains_all("text", t) for t in terms])
    found = points.filter(hit).select("id", text.term_overlap("text", F.array(*[F.lit(t) for t in terms])).alias("overlap"))
    if legacy:
        found = found.orderBy("id").limit(limit)
        return found.orderBy(F.desc("overlap"), "id")
    return found.orderBy(F.desc("overlap"), "id").limit(limit)


def limit_per_file(rows: DataFrame, most: int, position: str = "position", by: str = "query_id") -> DataFrame:
    """Rows over ``most`` of a file go to the end; rows without a file are never limited."""
    nth = F.row_number().over(Window.partitionBy(by, "file_id").orderBy(position))
    over = F.col("file_id").isNotNull() & (nth > most)
    return rows.withColumn("overflow", over).withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("overflow", position)).cast("long")).drop("overflow")


def mmr(rows: DataFrame, diversity: float, k: int, by: str = "query_id") -> DataFrame:
    """Maximal marginal relevance of (query_id, id, score, position, embedding).

    A greedy choice is sequential, so each query's pool, which its request bounds
    (200 rows at most), is one group. Rows without an embedding follow.
    """
    lam = 1.0 - min(max(diversity, 0.0), 1.0)

    def order(pdf):
        import numpy as np

        pdf = pdf.sort_values("position").reset_index(drop=True)
        has = [i for i, v in enumerate(pdf["embedding"]) if v is not None and len(v)]
        if len(has) < 2:
            chosen = list(range(len(pdf)))
        else:
            m = np.stack([np.asarray(pdf["embedding"][i], float) for i in has])
            lengths = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(lengths == 0, 1.0, lengths)
            s = pdf["score"].to_numpy(float)
            span = (s.max() - s.min()) or 1.0
            relevance = (s[has] - s.min()) / span
            redundant, left, picked = np.zeros(len(has)), np.ones(len(has), bool), []
            while len(picked) < min(k, len(has)):
                value = np.where(left, lam * relevance - (1 - lam) * redundant, -np.inf)
                best = int(np.argmax(value))
                picked.append(best)
                left[best] = False
                sims = m @ m[best]
                redundant = sims if len(picked) == 1 else np.maximum(redundant, sims)
            chosen = [has[i] for i in picked] + [i for i in range(len(pdf)) if i not in set(has)]
        out = pdf.iloc[chosen][[by, "id", "score"]].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    kinds = dict(rows.dtypes)
    return rows.select(by, "id", "score", "position", "embedding").groupBy(by).applyInPandas(order, f"{by} {kinds[by]}, id {kinds['id']}, score double, position long")


def best_reranked(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """(query_id, id, score, rank): each id's best score of at least the threshold, the best k of a query."""
    best = rows.filter(F.col("score") >= threshold).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_k(best, k, [F.desc("score"), F.asc("id")])


def suppress_low_quality(rows: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    if least <= 0:
        return rows
    return keep_unless_empty(rows, F.col("quality_score").isNull() | (F.col("quality_score") >= least), by)


def suppress_redundant(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return keep_unless_empty(rows, ~F.coalesce(F.col("redundant"), F.lit(False)), by)


def suppress_boilerplate(rows: DataFrame, boilerplate: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Without rows whose body hash is boilerplate (a frame with one column, body_hash)."""
    marked = rows.join(boilerplate.select("body_hash").distinct().withColumn("_boiler", F.lit(True)), "body_hash", "left")
    return keep_unless_empty(marked, F.col("_boiler").isNull(), by).drop("_boiler")


def read_document(chunks: DataFrame, max_chars: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Whole chunks of each file in order, up to ``max_chars`` with two between chunks.

    The first chunk always comes, cut to size. ``has_more`` tells of chunks left.
    """
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("chunk_index") >= start)
    if end is not None:
        inside = inside & (F.col("chunk_index") < end)
    w = Window.partitionBy("file_id").orderBy("chunk_index")
    rows = chunks.filter(inside)
    totals = rows.groupBy(F.col("file_id").alias("_file")).agg(F.count("*").alias("_all"))
    # a chunk takes two at least, so each task can cut a file before it is gathered
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_chars // 2 + 2)
    upto = F.sum(F.length("text").cast("long") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 2
    kept = first.withColumn("_upto", upto).filter((F.col("_n") == 1) | (F.col("_upto") <= max_chars))
    last = F.max("_n").over(Window.partitionBy("file_id"))
    out = kept.withColumn("_last", last).join(totals, F.col("file_id").eqNullSafe(F.col("_file")))
    return out.withColumn("has_more", F.col("_last") < F.col("_all")).withColumn("text", F.substring("text", 1, max_chars)).drop("_n", "_upto", "_all", "_last", "_file")


def recommend(points: DataFrame, seeds: DataFrame, per_seed: int = 2) -> DataFrame:
    """Seeds first, then their nearest other points; neighbours score 0."""
    queries = seeds.join(points, "id").select(F.col("id").alias("query_id"), "embedding")
    near = dense_channel(points, queries, per_seed + 1, threshold=-2.0).filter("id <> query_id")
    near = top_k(near.drop("rank"), per_seed, [F.desc("score"), F.asc("id")])
    best = near.groupBy("id").agg(F.max("score").alias("similarity")).join(seeds.select("id"), "id", "left_anti")
    first = seeds.select("id", "score", F.lit("seed").alias("source"), F.lit(None).cast("double").alias("similarity"))
    return first.unionByName(best.select("id", F.lit(0.0).alias("score"), F.lit("neighbor").alias("source"), "similarity"))


def assemble(rows: DataFrame, distance: bool = False, embeddings_too: bool = False) -> DataFrame:
    """The response: reranked score before base score, metadata without system fields."""
    score = F.coalesce(F.col("rerank_score"), F.col("score")) if "rerank_score" in rows.columns else F.col("score")
    out = rows.withColumn("score", score)
    if "attributes" in rows.columns:
        out = out.withColumn("attributes", F.map_filter("attributes", lambda k, _: ~k.isin("text", "filename", "store_id", "file_id")))
    if distance:
        out = out.withColumn("distance", 1 - F.col("score"))
    return out if embeddings_too else out.drop("embedding")
