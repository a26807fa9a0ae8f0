"""The inverted-file index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import ivf, search
from corpusforge.plans import search as plan
from corpusforge.queries import QUERIES


def clustered(spark, groups=40, each=30, width=16, seed=5):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, width))
    x = np.repeat(centres, each, axis=0) + 0.15 * r.standard_normal((groups * each, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[i * 7][1]) for i in range(30)]  # ties
    rows += [(6000, None), (6001, [0.0] * width)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4).withColumn("slug", F.concat(F.lit("s"), F.col("id") % 3))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    points = clustered(spark).cache()
    return points, ivf.build(points, str(tmp_path_factory.mktemp("cells") / "i")), points.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def test_exact_search_equals_the_product_with_all_points(world, spark, monkeypatch):
    points, index, queries = world
    read = []
    scan = ivf.Index.points
    monkeypatch.setattr(ivf.Index, "points", lambda self, s, cells=None: (read.append(cells), scan(self, s, cells))[1])
    for k, threshold in ((10, 0.05), (3, -2.0), (200, 0.05)):
        assert rows(ivf.search(index, queries, k, None, threshold)) == rows(search.dense_channel(points.filter("embedding IS NOT NULL"), queries.filter("embedding IS NOT NULL"), k, threshold))
    # one query needs few cells, even to be certain
    read.clear()
    ivf.search(index, queries.filter("query_id = 0"), 5).collect()
    assert sum(len(c) for c in read if c is not None) < len(index.centres) / 2


def test_every_point_is_indexed_once(world, spark):
    points, index, _ = world
    assert sorted(r.id for r in index.points(spark).select("id").collect()) == sorted(r.id for r in points.filter("embedding IS NOT NULL").collect())
    again = ivf.load(spark, index.path)
    assert (again.counts == index.counts).all() and (again.centres == index.centres).all()


def test_bytes_read_fall_with_the_probes(world, spark):
    _, index, queries = world
    one = np.asarray([queries.filter("query_id = 0").first()["embedding"]])
    order = ivf._cells_by_nearness(one, index.centres)[0]
    size = lambda df: df.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0]
    sizes = [size(index.points(spark, order[:p])) for p in (1, 5, 20)] + [size(index.points(spark))]
    assert sizes[0] < sizes[1] < sizes[2] < sizes[3] and sizes[0] < sizes[3] / 10
    pruned = index.points(spark, order[:1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in pruned or "PartitionFilters: [cell" in pruned


def test_recall(world):
    points, index, queries = world
    queries = queries.filter("embedding IS NOT NULL")
    exact = {(a, c) for a, _, c, _ in rows(ivf.search(index, queries, 10))}
    probes = ivf.probes_for(index, queries, 10, 0.95, 0.05)
    found = {(a, c) for a, _, c, _ in rows(ivf.search(index, queries, 10, probes))}
    assert probes < len(index.centres) / 2 and len(found & exact) >= 0.9 * len(exact)
    curve = ivf.recall_by_probes(index, queries, 10).orderBy("probes").collect()
    assert curve[-1].recall == curve[-1].share == 1.0 and all(a.recall <= b.recall and a.share < b.share for a, b in zip(curve, curve[1:], strict=False) if b.share < 1)


def test_recall_over_the_given_embeddings(spark, sf):
    exact = {(r.query_id, r.id) for r in QUERIES["ivf_exact"](spark, sf).collect()}
    assert len({(r.query_id, r.id) for r in QUERIES["ivf_topk"](spark, sf).collect()} & exact) >= 0.9 * len(exact)


def test_filters_come_before_the_cut(world, spark):
    points, index, queries = world
    queries = queries.filter("embedding IS NOT NULL")
    weights = spark.createDataFrame([], "id long, term string, weight long")
    terms = spark.createDataFrame([], "query_id long, term string, weight long")
    request = plan.SearchRequest(slugs=["s1"], dense_limit=4)
    some = points.filter("embedding IS NOT NULL")
    with_index = plan.candidates(some, weights, queries, terms, request, index)
    assert rows(with_index) == rows(plan.candidates(some, weights, queries, terms, request)) != []


def test_small_and_empty_tables(spark, tmp_path):
    schema = "id long, embedding array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    for name, data, want in (("none", [(7, None)], []), ("one", [(7, [0.6, 0.8])], [(1, 1, 7, 0.6)]), ("copies", [(i, [0.6, 0.8]) for i in range(9)], [(1, 1, 0, 0.6), (1, 2, 1, 0.6)])):
        index = ivf.build(spark.createDataFrame(data, schema), str(tmp_path / name))
        assert rows(ivf.search(index, queries, 2)) == want
