"""Edges are dealt over partitions that grow in number with them."""

from corpusforge.operators import graph


def test_links_are_dealt_over_more_partitions_where_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_BYTES", 1 << 12)
    made = []
    for n in (2_000, 8_000):
        edges = spark.range(n).selectExpr("id % 97 AS src", "id % 89 AS dst", "'r' AS type")
        nodes = spark.range(50).selectExpr("id * 2 AS id").union(spark.range(3).selectExpr("id"))
        found = graph.links_among(edges, nodes)
        want = {(i % 97, i % 89) for i in range(n) for e in [{i % 97, i % 89}] if all(x % 2 == 0 or x < 3 for x in e)}
        assert {(r.src, r.dst) for r in found.collect()} == want and found.count() == len(want)
        made.append(found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") and graph.dealt(edges, "src").rdd.getNumPartitions())
    assert made[1] > 3 * made[0] > 24  # and not the session's number for both
