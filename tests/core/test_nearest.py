"""Products of blocks against plain joins, with small tables, blocks and bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.functions import embeddings
from corpusforge.operators import nearest, search

ODD = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [0.0] * 6), (904, [0.5, None, 0.5, 0.5, 0.5, 0.5])]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"CELLS": 64, "ADDED": 50, "PENDING": 40, "COMMON": 3, "FIRST": 4, "BLOCK_PAIRS": 400, "BLOCK_ROWS": 15}.items():
        monkeypatch.setattr(nearest, name, value)


def points_of(spark, n=300):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, *((n + i, rows[i % 5][1]) for i in range(40)), *ODD], "id long, embedding array<double>")


def plain(points, queries, threshold):
    q = queries.select("query_id", F.col("embedding").alias("qv"))
    return points.join(q).select("query_id", "id", F.round(embeddings.dot("embedding", "qv"), 6).alias("score")).filter(F.col("score") >= threshold)


def listed(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize(("k", "threshold"), [(5, 0.05), (60, -2.0), (400, 0.3)])
def test_dense_equals_all_pairs(spark, small, k, threshold):
    points = points_of(spark)
    queries = points.filter("id % 10 = 0 or id >= 900").withColumnRenamed("id", "query_id")
    wanted = search.top_k(plain(points, queries, threshold), k, [F.desc("score"), F.asc("id")])
    assert listed(search.dense_channel(points, queries, k, threshold)) == listed(wanted) != []


def test_dense_keeps_nan_first_as_spark_orders_it(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [2.0, 0.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.id, r["rank"]) for r in search.dense_channel(points, queries, 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_a_task_never_holds_more_than_a_table_of_scores(spark, small, monkeypatch):
    shown = []
    real = np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda x: (shown.append(x.size), real(x))[1])
    x = np.random.default_rng(1).standard_normal((500, 6))
    import pyarrow as pa

    best = nearest.Best(np.full(9, -9.0), 4)
    nearest.show(best, x, np.arange(500), pa.array(np.arange(500)), x[:9], None, 6)
    assert max(shown) <= 64 and best.held + best.pending <= 9 * 4 + 2 * 64 + 40
    names = pa.array(np.arange(9))
    (found,) = best.batches(names)
    assert found.num_rows == 36


def corpus(spark, n=600, seed=2):
    r, rows = random.Random(seed), []
    for i in range(n):
        terms = {"the"} | {f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.choice([1, 5, 40]))}
        rows += [(i, t, r.choice([1, 1, 1, 2, 5]) * (50 if i % 100 == 7 else 1)) for t in terms]
    rows += [(n + i, t, w) for i in range(8) for j, t, w in rows if j == 5]
    return spark.createDataFrame(rows, "id long, term string, weight long")


@pytest.mark.parametrize("k", [3, 40])
def test_sparse_equals_all_pairs(spark, small, k):
    weights = corpus(spark)
    queries = weights.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = nearest.vectors(weights)
    assert listed(nearest.sparse(index, queries, k)) == listed(search.sparse_channel(weights, queries, k))
    assert listed(nearest.sparse(index, queries, k, 9.0)) == listed(search.sparse_channel(weights, queries, k, 9.0))
    few = weights.filter("id % 3 = 0").select("id").distinct()
    assert listed(nearest.sparse(index, queries, k, within=few)) == listed(search.sparse_channel(weights.join(few, "id", "left_semi"), queries, k))


def test_short_rows_are_not_read_once_bounds_are_known(spark, monkeypatch):
    monkeypatch.setattr(nearest, "FIRST", 4)
    rows = [(i, t, 40) for i in range(60) for t in "ab"] + [(100 + i, "a", 1) for i in range(140)]
    index = nearest.vectors(spark.createDataFrame(rows, "id long, term string, weight long"))
    read, scan = [], nearest._scan
    monkeypatch.setattr(nearest, "_scan", lambda rows, *a: (read.append(rows.count()), scan(rows, *a))[1])
    queries = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "query_id long, term string, weight long")
    assert len(listed(nearest.sparse(index, queries, 10))) == 10
    assert read[-1] == 60


def test_word_vectors_are_word_counts(spark):
    for more in ([], [(3, "again Über")]):  # with a repeated id too
        docs = spark.createDataFrame([(1, "a b A"), (2, None), (3, "über"), (4, "!"), *more], "id long, text string")
        index = nearest.word_vectors(docs, "id", "text")
        got = {(r.query_id, r.term, r.weight) for r in index.pairs(index.rows).collect()}
        assert got == {(r.id, r.term, r.weight) for r in search.term_weights(docs, "id", "text").collect()}
        assert {r.id: round(r.norm**2) for r in index.rows.collect()}[1] == 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, term string, weight long")
    index = nearest.vectors(none)
    assert nearest.sparse(index, none.withColumnRenamed("id", "query_id"), 3).count() == 0
    points = spark.createDataFrame([], "id long, embedding array<double>")
    assert search.dense_channel(points, points.withColumnRenamed("id", "query_id"), 3).count() == 0


def test_words_are_cut_from_bytes_as_sparks_expressions_cut_them(spark):
    texts = ["", "a", "é", " a  b_1\n", "Über-ÄÖ x", "naïve café", "日本語 テキスト", "x²y ½ Ⅳ", "é café", "a‍b 😀 c😀d", "𝔘𝔫𝔦 𐐷", "İstanbul ΣΑΣ", "  x　y", "a\x00b", "١٢٣ ๑", "_", "…“x”…"]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "".join(texts)])), "id long, text string").repartition(2)
    index = nearest.word_vectors(docs, "id", "text")
    got = {(r.query_id, r.term, r.weight) for r in index.pairs(index.rows).collect()}
    assert got == {(r.id, r.term, r.weight) for r in search.term_weights(docs, "id", "text").collect()}
    import pyarrow as pa

    table = np.unpackbits(nearest.word_table(spark)).astype(bool)
    runs, row, mine = nearest.cut(pa.array(["zz zz", *texts]).slice(3, 4), table)
    assert [(int(i), w.as_py()) for i, w, m in zip(row, runs, mine, strict=True) if m] == [(0, "é"), (1, "a"), (1, "b_1"), (2, "Über"), (2, "ÄÖ"), (2, "x"), (3, "naïve"), (3, "café")]


def test_queries_that_need_short_rows_do_not_have_them_read_for_others(spark, monkeypatch):
    rows = [(i, t, 40) for i in range(60) for t in "ab"] + [(100 + i, "a", 1) for i in range(140)] + [(300 + i, "c", 1) for i in range(20)]
    weights = spark.createDataFrame(rows, "id long, term string, weight long")
    index = nearest.vectors(weights)
    read, scan = {}, nearest._scan
    monkeypatch.setattr(nearest, "_scan", lambda rows, block, kind: (read.update(dict.fromkeys(block.names.to_pylist(), rows.count())), scan(rows, block, kind))[1])
    queries = weights.filter("id < 5 or id = 300").withColumnRenamed("id", "query_id")
    assert listed(nearest.sparse(index, queries, 10)) == listed(search.sparse_channel(weights, queries, 10))
    assert read[300] == 220 and max(read[i] for i in range(5)) == 60


def test_sparse_with_weights_of_both_signs_and_of_all_sizes(spark, small):
    r = random.Random(5)
    rows = [(i, f"w{j}", r.choice([-1, 1]) * r.random() * 10.0 ** r.randint(-6, 6)) for i in range(200) for j in r.sample(range(40), r.choice([1, 4, 20]))]
    weights = spark.createDataFrame(rows, "id long, term string, weight double")
    queries = weights.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    wanted = search.top_k(search.sparse_channel(weights, queries, 1000).drop("rank").filter("score > 0"), 7, [F.desc("score"), F.asc("id")])
    close = lambda df: [(q, n, i) for q, n, i, _ in listed(df)]
    assert close(nearest.sparse(nearest.vectors(weights), queries, 7)) == close(wanted) != []


def test_tables_are_in_single_precision_and_not_sorted_where_bounds_leave_little(monkeypatch):
    import pyarrow as pa

    r, kinds = np.random.default_rng(4), []
    x = r.standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[50:60] = x[40:50] * (1 + 1e-9)  # closer than single precision tells
    monkeypatch.setattr(np, "partition", lambda *a, **k: kinds.append("sorted"))
    best = nearest.Best(np.full(30, 0.6), 5)
    nearest.show(best, x, np.arange(400), pa.array(np.arange(400)), x[:30], None, 6)
    query, score, ids = best.settle()
    full = np.round(x @ x[:30].T, 6)
    wanted = {(j, i) for j in range(30) for i in sorted(range(400), key=lambda i: (-full[i, j], i))[:5] if full[i, j] >= 0.6}
    assert not kinds and {(int(a), int(b)) for a, b in zip(query, ids.to_pylist(), strict=True)} == wanted


def test_numbers_beyond_single_precision_are_found(spark):
    points = spark.createDataFrame([(1, [1e39, 1.0]), (2, [-1e39, 5.0]), (3, [1e-39, 2.0]), (4, [1e300, -1.0])], "id long, embedding array<double>")
    queries = points.withColumnRenamed("id", "query_id").filter("query_id < 4")
    wanted = search.top_k(plain(points, queries, -2.0), 3, [F.desc("score"), F.asc("id")])
    assert listed(search.dense_channel(points, queries, 3, -2.0)) == listed(wanted)
