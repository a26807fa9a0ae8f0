"""Retrieval quality: recall at k, reciprocal rank, leakage, and A/B deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranks(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank) of the first right result; null where there is none.

    results: query_id, rank (from 1), id; gold: query_id, expect (an id).
    """
    hits = results.join(gold.select("query_id", F.col("expect").alias("id")), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left")


def metrics(found: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), digits: int = 6) -> DataFrame:
    """One row: queries, recall at each k, and the mean reciprocal rank."""
    return found.agg(
        F.count("*").alias("queries"),
        *[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), digits).alias(f"recall_{k}") for k in ks],
        F.round(F.avg(F.when(F.col("rank").isNotNull(), 1.0 / F.col("rank")).otherwise(0.0)), digits).alias("mrr"),
    )


def leakage(results: DataFrame, negatives: DataFrame, thresholds: tuple[float, ...] = (0.0,)) -> DataFrame:
    """For each threshold: negative queries, those that got a result of at least that score, and the best score of any.

    results: query_id, score; the score counts as 1 where there is none.
    """
    score = F.col("score") if "score" in results.columns else F.lit(1.0)
    best = results.groupBy("query_id").agg(F.max(score).alias("best"))
    each = negatives.select("query_id").distinct().join(best, "query_id", "left")
    counts = each.agg(F.count("*").alias("negatives"), F.max("best").alias("max_score"), *[F.count_if(F.col("best") >= t).alias(f"_{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("leaked")) for i, t in enumerate(thresholds)])).alias("x")
    return counts.select(rows, "negatives", "max_score").select("x.threshold", "negatives", "x.leaked", "max_score")


def compare(off: DataFrame, on: DataFrame) -> DataFrame:
    """Per query the rank without and with a change, and which is better."""
    far = lambda c: F.coalesce(c, F.lit(10**9))
    joined = off.withColumnRenamed("rank", "off").join(on.withColumnRenamed("rank", "on"), "query_id", "full")
    return joined.withColumn("delta", F.when(far("on") < far("off"), "better").when(far("on") > far("off"), "worse").otherwise("same"))
