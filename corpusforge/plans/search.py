"""Ranked search over points and their texts, for any number of queries at once.

Models are callables behind small protocols: an embedder and a reranker map a
pandas Series to embeddings or scores and run in Arrow batches; the defaults are
deterministic stand-ins (word counts and their cosine) and no trained models.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.functions.time import epoch, recency
from corpusforge.operators import filters, fulltext, graph, ivf, nearest, postings, search


class Embedder(Protocol):
    def __call__(self, texts: pd.Series) -> pd.Series: ...


class Reranker(Protocol):
    def __call__(self, queries: pd.Series, texts: pd.Series) -> pd.Series: ...


def word_cosine(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """The cosine of word counts: a stand-in for a cross-encoder."""
    from collections import Counter
    from math import sqrt

    def one(q, t):
        a, b = Counter((q or "").lower().split()), Counter((t or "").lower().split())
        size = sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(n * b[w] for w, n in a.items()) / size if size else 0.0

    return pd.Series([one(q, t) for q, t in zip(queries, texts, strict=True)], dtype="float64")


@dataclass
class SearchRequest:
    """Limits, thresholds and options of a search; what is null takes its default."""

    filters: dict | None = None
    slugs: list[str] | None = None
    max_num_results: int = 15
    dense_limit: int = 150
    sparse_limit: int = 150
    fusion_limit: int = 250
    rerank_pool: int = 200
    dense_threshold: float = 0.05
    probes: int | None = None
    sparse_threshold: float = 0.0
    fusion: str = "rrf"
    rerank: bool = False
    score_threshold: float = 0.25
    recency_weight: float = 0.3
    recency_half_life: float | None = None
    as_of: float | None = None
    diversity: float | None = None
    max_per_file: int | None = None
    min_quality: float = 0.0
    suppress_redundant: bool = False
    boilerplate: DataFrame | None = None
    graph_expand: bool = False
    graph_seeds: int = 10
    graph_neighbors: int = 20
    graph_df_max: float = 0.5
    terms: list[str] = field(default_factory=list)
    date_fields: tuple[str, ...] = ("modified", "created", "created_at")


def rerank(rows: DataFrame, reranker: Reranker = word_cosine) -> DataFrame:
    """rows (query, text) with ``rerank_score``, in Arrow batches; null where the reranker fails, and ``rerank_error`` says how."""

    def scores(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"score": pd.Series(reranker(q, t), dtype="float64").array, "error": None})
        except Exception as e:  # a model may fail in any way; its queries keep their fused order
            return pd.DataFrame({"score": pd.Series([None] * len(q), dtype="float64"), "error": f"{type(e).__name__}: {e}"})

    ranked = rows.withColumn("_r", F.pandas_udf(scores, "score double, error string")("query", "text"))
    return ranked.withColumns({"rerank_score": F.col("_r.score"), "rerank_error": F.col("_r.error")}).drop("_r")


def candidates(points: DataFrame, weights: DataFrame | postings.Postings | nearest.Vectors, queries: DataFrame, query_terms: DataFrame, request: SearchRequest, index: ivf.Index | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the fused dense and sparse channels.

    The filter and the scope stand below every channel, so they are applied
    before any cut. With an index of the points, dense search reads cells of it:
    the nearest ``probes`` of the request, or those that an exact search needs.
    """
    allowed = points.filter(filters.scope(request.slugs) & filters.compile_filter(points, request.filters))
    everything = request.filters is None and not request.slugs
    if index is not None:
        dense = ivf.search(index, queries, request.dense_limit, request.probes, request.dense_threshold, within=None if everything else allowed)
    else:
        dense = search.dense_channel(allowed, queries, request.dense_limit, request.dense_threshold)
    dense = dense.withColumn("channel", F.lit("dense"))
    if isinstance(weights, postings.Postings):
        sparse = postings.search(weights, query_terms, request.sparse_limit, request.sparse_threshold, within=None if everything else allowed)
    elif isinstance(weights, nearest.Vectors):
        sparse = nearest.sparse(weights, query_terms, request.sparse_limit, request.sparse_threshold, within=None if everything else allowed)
    else:
        inside = weights if everything else weights.join(allowed.select("id"), "id", "left_semi")
        sparse = search.sparse_channel(inside, query_terms, request.sparse_limit, request.sparse_threshold)
    sparse = sparse.withColumn("channel", F.lit("sparse"))
    columns = ["query_id", "channel", "id", "score", "rank"]
    channels = dense.select(columns).unionByName(sparse.select(F.col("query_id"), "channel", "id", F.col("score").cast("double").alias("score"), "rank"))
    fused = search.rrf(channels) if request.fusion == "rrf" else search.dbsf(channels)
    return search.top_k(fused, request.fusion_limit, [F.desc("score"), F.asc("id")])


def augment(rows: DataFrame, points: DataFrame, request: SearchRequest, mentions: DataFrame | None = None, edges: DataFrame | None = None, terms: DataFrame | None = None, texts: fulltext.TextIndex | None = None) -> DataFrame:
    """Each query's candidates fused with its graph and lexical channels, where asked for.

    rows: query_id, id, rank. ``terms`` (query_id, terms) are each query's own exact terms,
    looked up in the index ``texts`` of the points; a request's ``terms`` go for all of its
    queries. Without an extra channel the rows come back unchanged.
    """
    extra = []
    allowed = points.filter(filters.scope(request.slugs) & filters.compile_filter(points, request.filters))
    if request.graph_expand and mentions is not None:
        seeds = search.top_k(rows.select("query_id", "id", "rank"), request.graph_seeds, [F.asc("rank"), F.asc("id")], rank="_nth").select("query_id", F.col("id").alias("chunk_id"))
        inside = mentions.join(allowed.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        near = graph.expand_mentions_each(inside, seeds, allowed.count(), request.graph_df_max, request.graph_neighbors).select("query_id", F.col("chunk_id").alias("id"), F.col("weight").alias("w"))
        if edges is not None:
            beside = graph.expand_next_each(edges, seeds).select("query_id", F.col("chunk_id").alias("id")).join(near, ["query_id", "id"], "left_anti")
            near = near.unionByName(beside.withColumn("w", F.lit(0.0)))
        extra.append(("graph", near))
    if request.terms:
        # the channel has thirty rows at most
        hits = search.lexical_channel(allowed, request.terms).select("id", F.col("overlap").cast("double").alias("w"))
        extra.append(("lexical", rows.select("query_id").distinct().join(F.broadcast(hits))))
    if terms is not None and texts is not None:
        own = fulltext.search(texts, points, terms.join(rows.select("query_id").distinct(), "query_id", "left_semi"), within=allowed)
        extra.append(("own terms", own.select("query_id", "id", F.col("overlap").cast("double").alias("w"))))
    if not extra:
        return rows
    channels = rows.select("query_id", F.lit("embedding").alias("channel"), "id", "rank")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "id")).cast("long")
    for name, df in extra:
        channels = channels.unionByName(df.select("query_id", F.lit(name).alias("channel"), "id", nth.alias("rank")))
    return search.top_k(search.rrf(channels), request.fusion_limit, [F.desc("score"), F.asc("id")])


def finish(rows: DataFrame, points: DataFrame, request: SearchRequest, queries: DataFrame | None = None, reranker: Reranker = word_cosine) -> DataFrame:
    """Join payloads; rerank; dedupe by text; recency, diversity and file limits; suppression; cut.

    Payloads may have ``head`` (``search.head_hash``) in place of their text, where nothing else needs it.
    """
    payload = points.withColumnsRenamed({"score": "payload_score"}) if "score" in points.columns else points
    if "text" in payload.columns and "head" not in payload.columns:
        payload = payload.withColumn("_head", search.head_hash("text"))
    out = rows.join(payload, "id")
    by, head = ["query_id"], next((c for c in ("head", "_head") if c in payload.columns), None)
    if head:
        out = search.first_by_head(out, [F.desc("score"), F.asc("id")], head).drop("_head")
    if request.rerank and queries is not None:
        pool = search.top_k(out, request.rerank_pool, [F.desc("score"), F.asc("id")])
        out = rerank(pool.join(queries.select("query_id", "query"), "query_id"), reranker)
        failed = F.max(F.col("rerank_score").isNull()).over(Window.partitionBy("query_id"))
        out = out.withColumn("_failed", failed).filter(F.col("_failed") | (F.col("rerank_score") >= request.score_threshold))
        out = out.withColumn("score", F.when(F.col("_failed"), F.col("score")).otherwise(F.col("rerank_score"))).drop("query", "_failed")
    if request.recency_half_life is not None and request.as_of is not None:
        found = [F.element_at("attributes", f) if f not in out.columns else F.col(f) for f in request.date_fields if f in out.columns or "attributes" in out.columns]
        if found:
            out = out.withColumn("_epoch", epoch(*found)).withColumn("score", recency("score", "_epoch", request.as_of, request.recency_half_life, request.recency_weight)).drop("_epoch")
    out = out.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))).cast("long"))
    if request.diversity is not None:
        pool = out.filter(F.col("position") <= 3 * request.max_num_results)
        order = search.mmr(pool, request.diversity, 3 * request.max_num_results).select("query_id", "id", F.col("position").alias("_p"))
        out = pool.join(order, ["query_id", "id"]).withColumn("position", F.col("_p")).drop("_p")
    if request.max_per_file is not None:
        out = search.limit_per_file(out, request.max_per_file)
    out = out.filter(F.col("position") <= request.max_num_results)
    if request.boilerplate is not None:
        out = search.suppress_boilerplate(out, request.boilerplate, by)
    if request.suppress_redundant:
        out = search.suppress_redundant(out, by)
    if request.min_quality > 0:
        out = search.suppress_low_quality(out, request.min_quality, by)
    return out


def agent_request(max_results: int = 8, filename: str | None = None, directory: str | None = None, directories: list[str] | None = None, score_threshold: float | None = None, graph_expand: bool = False) -> SearchRequest:
    """An agent's search: numbers are clamped, and its directories bound whatever it asks for."""
    wanted = {k: v for k, v in {"filename": filename, "slug": directory}.items() if v}
    request = SearchRequest(filters=wanted or None, slugs=directories, max_num_results=max(1, min(int(max_results), 50)), graph_expand=graph_expand)
    if score_threshold is not None:
        request.score_threshold = max(0.0, min(float(score_threshold), 1.0))
    return request


def query_embeddings(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """(query_id, query) with ``embedding``, in Arrow batches."""
    return texts.withColumn("embedding", F.pandas_udf(lambda s: embedder(s), "array<float>")("query"))


def query_terms(texts: DataFrame) -> DataFrame:
    """(query_id, term, weight) of (query_id, query)."""
    return search.term_weights(texts, "query_id", "query").withColumnRenamed("id", "query_id")


def own_terms(texts: DataFrame) -> DataFrame:
    """(query_id, terms): the exact terms of each of (query_id, query)."""
    return texts.select("query_id", text.lexical_terms("query").alias("terms")).filter(F.size("terms") > 0)


def exact_terms(query: str, spark) -> list[str]:
    """The exact terms of one query, as the lexical channel takes them."""
    return spark.range(1).select(text.lexical_terms(F.lit(query)).alias("t")).first()["t"]
