"""Operators on small frames, with what they promise: order, nulls, ties, failsafes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import catalog, curation, entities, evaluation, filters, graph, search, sync, tabular
from corpusforge.plans import search as plan


def test_rrf(spark):
    rows = [(1, "v", "a", 1), (1, "v", "b", 2), (1, "v", "c", 3), (1, "l", "c", 1), (1, "l", "a", 2)]
    fused = search.rrf(spark.createDataFrame(rows, "query_id int, channel string, id string, rank long"))
    got = {r.id: r.score for r in fused.collect()}
    assert got == {"a": round(1 / 61 + 1 / 62, 9), "b": round(1 / 62, 9), "c": round(1 / 63 + 1 / 61, 9)}
    swapped = search.rrf(spark.createDataFrame(rows[::-1], "query_id int, channel string, id string, rank long"))
    assert {r.id: r.score for r in swapped.collect()} == got


PAYLOAD = [(1, "a", 5, ["x", "y"], {"n": "3", "k": "t"}, True), (2, "b", None, [], {"n": "many"}, False), (3, None, 9, None, None, None)]
SCHEMA = "id int, s string, i int, tags array<string>, attributes map<string, string>, flag boolean"


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        ({}, [1, 2, 3]),
        (None, [1, 2, 3]),
        ({"s": "a"}, [1]),
        ({"i": {"$gt": 4, "$lt": 9}}, [1]),
        ({"n": {"$gte": 1}}, [1]),
        ({"tags": "x"}, [1]),
        ({"tags": {"$in": ["y", "z"]}}, [1]),
        ({"s": {"$ne": "a"}}, [2]),
        ({"$not": {"s": "a"}}, [2, 3]),
        ({"$not": {"missing": {"$eq": 1}}}, [1, 2, 3]),
        ({"$and": [{}, {"s": {"$in": ["a", "b"]}}], "i": 5}, [1]),
        ({"$or": [{"k": "t"}, {"i": 9}]}, [1, 3]),
        ({"flag": True}, [1]),
        ({"s": {"$contains": "aa"}}, []),
        ({"n": {"$nin": ["3"]}}, [2]),
    ],
)
def test_filters(spark, tree, want):
    df = spark.createDataFrame(PAYLOAD, SCHEMA)
    assert [r.id for r in df.filter(filters.compile_filter(df, tree)).orderBy("id").collect()] == want


def test_filters_raise(spark):
    df = spark.createDataFrame(PAYLOAD, SCHEMA)
    for tree in ({"$xor": []}, {"s": {"$like": "a"}}, {"i": {"$gt": "4"}}):
        with pytest.raises(ValueError):
            filters.compile_filter(df, tree)
    with pytest.raises(ValueError):
        filters.scope([], mandatory=True)


def test_suppression_never_empties(spark):
    df = spark.createDataFrame([(1, 0.2), (1, None), (2, 0.1)], "query_id int, quality_score double")
    assert search.suppress_low_quality(df, 0.5, ["query_id"]).count() == 2
    assert search.suppress_low_quality(df.filter("query_id = 2"), 0.5).count() == 1
    assert search.suppress_low_quality(df, 0.0).count() == 3
    assert filters.keep_unless_empty(df.limit(0), F.lit(True)).count() == 0
    boiler = spark.createDataFrame([("h1",)], "body_hash string")
    rows = spark.createDataFrame([(1, "h1"), (1, "h2"), (2, "h1")], "query_id int, body_hash string")
    assert sorted((r.query_id, r.body_hash) for r in search.suppress_boilerplate(rows, boiler, ["query_id"]).collect()) == [(1, "h2"), (2, "h1")]


def test_limit_per_file(spark):
    rows = [(1, 1, "f1"), (1, 2, "f1"), (1, 3, "f2"), (1, 4, None), (1, 5, None)]
    out = search.limit_per_file(spark.createDataFrame(rows, "query_id int, position int, file_id string"), 1)
    assert [r.file_id for r in out.orderBy("position").collect()] == ["f1", "f2", None, None, "f1"]


def test_mmr(spark):
    rows = [(1, "a", 1.0, 1, [1.0, 0.0]), (1, "b", 0.9, 2, [1.0, 0.0]), (1, "c", 0.5, 3, [0.0, 1.0]), (1, "d", 0.8, 4, None)]
    df = spark.createDataFrame(rows, "query_id int, id string, score double, position long, embedding array<double>")
    order = lambda d: [r.id for r in search.mmr(df, d, 10).orderBy("position").collect()]
    assert order(0) == ["a", "b", "c", "d"] and order(0.7) == ["a", "c", "b", "d"] and order(1)[0] == "a"


def test_reader(spark):
    rows = [("f", 0, "a" * 10), ("f", 2, "b" * 5), ("f", 5, "c" * 5), ("g", 1, "d" * 50)]
    df = spark.createDataFrame(rows, "file_id string, chunk_index int, text string")
    read = lambda n, *w: [(r.file_id, r.chunk_index, len(r.text), r.has_more) for r in search.read_document(df, n, *w).orderBy("file_id", "chunk_index").collect()]
    assert read(17) == [("f", 0, 10, True), ("f", 2, 5, True), ("g", 1, 17, False)]
    assert read(16)[0] == ("f", 0, 10, True) and len(read(16)) == 2
    assert read(100, 2, 5) == [("f", 2, 5, False)] and read(100, 9) == []


@pytest.mark.parametrize("edges", [[("9", "10"), ("10", "11"), ("11", "9")], [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y")], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.id: r.component for r in curation.connected_components(df).collect()}
    back = {r.id: r.component for r in curation.connected_components(spark.createDataFrame([(b, a) for a, b in edges[::-1]], "a string, b string")).collect()}
    assert got == back
    if edges and edges[0][0] == "9":
        assert set(got.values()) == {"10"}
    elif edges:
        assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_near_duplicates_need_both_kinds_of_likeness(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.99, 0.141]), (4, [0.0, 1.0])], "id int, embedding array<double>")
    weights = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "b", 1), (4, "a", 1)], "id int, term string, weight int")
    edges = curation.near_duplicate_edges(points, weights)
    assert [tuple(r) for r in edges.collect()] == [(1, 2)]
    marked = curation.mark_redundant(points, curation.connected_components(edges))
    assert {r.id: r.redundant for r in marked.collect()} == {1: False, 2: True, 3: False, 4: False}
    blocked = curation.similar_pairs(points, 0.9, block_rows=2)
    assert sorted(map(tuple, blocked.select("id", "other").collect())) == sorted(map(tuple, curation.similar_pairs(points, 0.9).select("id", "other").collect()))


def test_bands_find_what_blocks_find(spark):
    import numpy as np

    r = np.random.default_rng(2)
    v = r.standard_normal((300, 16))
    near = v[:60] + 0.1 * r.standard_normal((60, 16))
    every = np.concatenate([v, near, v[:5], v[:5]])
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(every)], "id int, embedding array<double>")
    exact = {tuple(x) for x in curation.similar_pairs(df, 0.96).select("id", "other").collect()}
    found = {tuple(x) for x in curation.banded_pairs(df, 0.96).select("id", "other").collect()}
    assert found <= exact and len(exact) > 60
    copies = set(range(360, 370))
    assert {p for p in exact if not copies & set(p)} == {p for p in found if not copies & set(p)}
    same = lambda pairs: {r.id: r.component for r in curation.connected_components(spark.createDataFrame(sorted(pairs), "a int, b int")).collect()}
    assert same(found) == same(exact)


def test_outliers_and_clusters(spark):
    points = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(9)] + [(9, [-1.0, 0.0])], "id int, embedding array<double>")
    assert [r.id for r in curation.semantic_outliers(points).collect()] == [9]
    assert curation.semantic_outliers(points.limit(2)).count() == 0
    found = curation.semantic_clusters(points)
    assert found.count() == 10 and found.select("cluster").distinct().count() == 2


def test_provenance(spark):
    rows = spark.createDataFrame([("h", ["a", "b"]), ("g", ["a"])], "body_hash string, files array<string>")
    assert [tuple(r) for r in curation.purge_file(rows, ["a"]).collect()] == [("h", ["b"])]
    bodies = spark.createDataFrame([("x", 5), ("y", 4)], "body_hash string, doc_count long")
    assert [r.body_hash for r in curation.boilerplate(bodies, 10).collect()] == ["x"]
    assert [r.body_hash for r in curation.boilerplate(bodies, 0).collect()] == ["x"] and curation.boilerplate(bodies, 100).count() == 0


CHUNKS = [("f", 0, ["A", "B", "C"]), ("f", 1, ["A", "B"]), ("f", 3, []), ("f", 4, ["A"]), ("g", 0, None)]


def test_sections(spark):
    df = spark.createDataFrame(CHUNKS, "file_id string, chunk_index int, headings array<string>")
    got = {r.path: (r.level, r.parent_id) for r in graph.sections(df).collect()}
    assert got == {"A": (1, None), "A > B": (2, "f::s::A"), "A > B > C": (3, "f::s::A > B")}
    assert {r.chunk_id: r.parent_id for r in graph.chunk_parents(df).collect()} == {"f::c0": "f::s::A > B > C", "f::c1": "f::s::A > B", "f::c3": "f", "f::c4": "f::s::A", "g::c0": "g"}
    edges = graph.next_edges(df.withColumn("chunk_id", graph.chunk_id()))
    assert sorted(map(tuple, edges.collect())) == [("f::c0", "f::c1"), ("f::c1", "f::c3"), ("f::c3", "f::c4")]


def test_relations_and_purge(spark):
    rows = [("a", "r", "b", 0.5, "f1"), ("a", "r", "b", 0.9, "f2"), ("a", "r", "a", 1.0, "f1"), ("a", "r", "c", 0.1, "f1")]
    rels = graph.merge_relations(spark.createDataFrame(rows, "head_id string, rel_type string, tail_id string, score double, file_id string"))
    assert sorted((r.tail_id, r.score, r.files) for r in rels.collect()) == [("b", 0.9, ["f1", "f2"]), ("c", 0.1, ["f1"])]
    chunks = spark.createDataFrame([("k1", "f1"), ("k2", "f2")], "chunk_id string, file_id string")
    mentions = spark.createDataFrame([("k1", "a"), ("k2", "b")], "chunk_id string, entity_id string")
    m, c, r = graph.purge_file("f1", mentions, chunks, rels)
    assert [x.chunk_id for x in m.collect()] == ["k2"] and c.count() == 1 and [(x.tail_id, x.files) for x in r.collect()] == [("b", ["f2"])]
    assert [(x.n, x.tails) for x in graph.conflicts(rels).collect()] == [(2, ["b", "c"])]


def test_junk_names(spark):
    df = spark.createDataFrame([("1.6.1",), ("ab",), (" x ",), ("Banca",), (None,), ("12 (3)",)], "n string")
    assert [r.j for r in df.select(graph.is_junk("n").alias("j")).collect()] == [True, True, True, False, True, True]


REMOTE = [("1", "a.pdf", 10, "m1"), ("2", "b.exe", 10, "m1"), ("3", "c.pdf", 10**9, "m1"), ("4", "d.pdf", 1, "m1"), ("5", "e.pdf", 1, "m1"), ("6", "f.pdf", 1, "m2"), ("7", "g.pdf", 1, "m1"), ("8", "report_x.pdf", 1, "m1"), ("9", "NOEXT", 1, "m1")]
JOBS = [("j4", "4", "PROCESSING", "m0"), ("j5", "5", "COMPLETED", "m1"), ("j6", "6", "COMPLETED", "m1"), ("j7", "7", "FAILED", "m1")]


def test_admission(spark):
    remote = spark.createDataFrame(REMOTE, "id string, name string, size long, modified string")
    jobs = spark.createDataFrame(JOBS, "file_id string, remote_id string, status string, remote_modified string")
    out = spark.createDataFrame([("1",)], "remote_id string")
    got = {r.id: r.reason for r in sync.admission(remote, jobs, [".pdf"], exclude=[("pattern", "REPORT"), ("regex", r"report_")], excluded_ids=out).collect()}
    assert got == {"1": "excluded", "2": "extension", "3": "size", "4": "in_flight", "5": "unchanged", "6": "included", "7": "included", "8": "exclude_rules", "9": "extension"}
    some = sync.admission(remote, jobs, [".pdf"], include=[("pattern", "a, REPORT"), ("regex", "[a-r].*")])
    assert {r.id for r in some.filter("reason <> 'include_rules' AND reason = 'included'").collect()} == {"1", "8"}
    assert sorted(map(tuple, sync.superseded_by_sync(remote, jobs).collect())) == [("6", "j6"), ("7", "j7")]
    assert [r.file_id for r in sync.deleted_remotely(jobs, remote.filter("id <> '5'")).collect()] == ["j5"]


def test_cascade_false_is_a_value(spark):
    files = spark.createDataFrame([("f1", "d1"), ("f2", "d2")], "file_id string, slug string").withColumn("store_id", F.lit("vs"))
    schemas = spark.createDataFrame([("file", "f1", 64, None), ("dir", "d1", 128, False), ("store", "vs", None, True)], "scope string, ident string, tokens int, on boolean")
    got = catalog.schema_cascade(files, schemas, {"tokens": 512, "on": True})
    assert sorted((r.file_id, r.tokens, r.on) for r in got.collect()) == [("f1", 64, False), ("f2", 512, True)]
    assert catalog.validate_schema(16, [" a ", "", None]) == (16, ["a"])
    with pytest.raises(ValueError):
        catalog.validate_schema(8, None)


def test_queue(spark):
    rows = [(1, "f", "COMPLETED", 5.0), (2, "f", "FAILED", 5.0), (3, "g", "PENDING", 1.0)]
    jobs = spark.createDataFrame(rows, "job_id int, file_id string, status string, created_at double")
    assert [(r.file_id, r.job_id) for r in catalog.latest_job(jobs).orderBy("file_id").collect()] == [("f", 1), ("g", 3)]
    counts = catalog.file_counts(jobs).first()
    assert (counts.total, counts.completed, counts.failed, counts.in_progress) == (2, 1, 1, 1)
    moved = catalog.transition(jobs, "PENDING", F.lit(True))
    assert [r.status for r in moved.orderBy("job_id").collect()] == ["COMPLETED", "PENDING", "PENDING"]


def test_table(spark):
    rows = [(i, "1.234,5" if i % 5 else "x", None if i % 2 else "blu") for i in range(800)]
    df = spark.createDataFrame(rows, "n int, price string, color string")
    stats = {r.column: r.numeric for r in tabular.column_stats(df, decimal=",").collect()}
    assert stats == {"n": True, "price": True, "color": False}
    chunks = tabular.table_chunks(df, "n", ["n", "price", "color"], "t", ",").orderBy("chunk_index").collect()
    assert len(chunks) == 52 and chunks[1].heading == "t — righe 1–15" and "750 di 800" in chunks[-1].text
    assert "(num): min=1.234,50" in chunks[0].text and "blu (400)" in chunks[0].text
    assert tabular.table_chunks(df.limit(0), "n", ["n"], "t").count() == 1
    whole = tabular.row_batches(df, "n", ["n"], max_chunks=-1, label="t").orderBy("chunk_index").collect()
    assert len(whole) == 54 and whole[-1].heading == "t — righe 796–800"
    assert [r.rn for r in tabular.number_rows(df, "n", "rn").orderBy("n").collect()] == list(range(1, 801))


def test_evaluation(spark):
    results = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q2", 1, "c")], "query_id string, rank int, id string")
    gold = spark.createDataFrame([("q1", "b"), ("q2", "z")], "query_id string, expect string")
    m = evaluation.metrics(evaluation.ranks(results, gold)).first()
    assert (m.queries, m.recall_1, m.recall_3, m.mrr) == (2, 0.0, 0.5, 0.25)
    assert tuple(evaluation.leakage(results, spark.createDataFrame([("q2",), ("q9",)], "query_id string")).first())[1:3] == (2, 1)
    scored = spark.createDataFrame([("q2", 0.4), ("q2", 0.1), ("q9", 0.2), ("q1", 0.9)], "query_id string, score double")
    found = evaluation.leakage(scored, spark.createDataFrame([("q2",), ("q9",), ("q7",)], "query_id string"), (0.1, 0.3, 0.5)).collect()
    assert [tuple(r) for r in found] == [(0.1, 3, 2, 0.4), (0.3, 3, 1, 0.4), (0.5, 3, 0, 0.4)]


def test_relation_hygiene(spark):
    rows = [("Banca A", "org", "r", "Mario", "per", 0.9), ("Banca A", "org", "r", " banca a.", "org", 0.9), ("x", "other", "r", "y", "other", 1.0), ("", "org", "r", "y", "per", 1.0), ("w " * 9, "org", "r", "y", "per", 1.0)]
    df = spark.createDataFrame(rows, "head string, head_type string, rel_type string, tail string, tail_type string, score double")
    assert [r.tail for r in entities.clean_relations(df).collect()] == ["Mario"]


def test_search_end_to_end(spark):
    texts = ["fox and dog", "fox and dog", "the cat", "a fox alone", "nothing here"]
    points = spark.createDataFrame([(i, [1.0, i / 10], t, f"s{i % 2}", f"f{i % 2}", 1.0 - i / 10) for i, t in enumerate(texts)], "id long, embedding array<double>, text string, slug string, file_id string, quality_score double")
    weights = search.term_weights(points, "id", "text")
    queries = spark.createDataFrame([(0, "fox dog", [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    run = lambda **o: plan.finish(plan.candidates(points, weights, queries, plan.query_terms(queries), plan.SearchRequest(**o)), points, plan.SearchRequest(**o), queries).orderBy("position").collect()
    everything = [r.id for r in run()]
    assert everything[0] == 0 and 1 not in everything and len(everything) == 4
    assert {r.id for r in run(slugs=["s1"])} == {1, 3} and {r.id for r in run(filters={"slug": "s1"})} == {1, 3}
    assert [r.id for r in run(rerank=True)] == [0, 3]
    assert [r.file_id for r in run(max_per_file=1)][:2] == ["f0", "f1"]
    assert len(run(diversity=0.5)) == 4 and len(run(min_quality=0.75)) == 2
    mentions = spark.createDataFrame([(0, "e"), (4, "e")], "chunk_id long, entity_id string")
    first = plan.candidates(points.limit(1), weights.limit(0), queries, plan.query_terms(queries), plan.SearchRequest())
    more = plan.augment(first, points, plan.SearchRequest(graph_expand=True, terms=["cat"]), mentions)
    assert {r.id for r in more.collect()} == {0, 2, 4}
    assert plan.augment(first, points, plan.SearchRequest()) is first
    # each query has its own seeds, and all of them the lexical rows
    two = spark.createDataFrame([(7, 0, 1), (8, 3, 1)], "query_id long, id long, rank long")
    linked = spark.createDataFrame([(0, "e"), (4, "e"), (3, "f"), (1, "f")], "chunk_id long, entity_id string")
    both = plan.augment(two, points, plan.SearchRequest(graph_expand=True, terms=["cat"]), linked, spark.createDataFrame([(3, 4)], "src long, dst long")).collect()
    assert {(r.query_id, r.id) for r in both} == {(7, 0), (7, 4), (7, 2), (8, 3), (8, 1), (8, 4), (8, 2)}


def test_overlapping_jobs(spark):
    rows = [(1, "COMPLETED", ["a", "b"]), (2, "COMPLETED", ["b", "a", "a"]), (3, "COMPLETED", ["b", "c"]), (4, "COMPLETED", ["c"]), (5, "FAILED", ["c"]), (6, "COMPLETED", []), (7, "COMPLETED", ["z"])]
    got = {tuple(r) for r in sync.overlapping_jobs(spark.createDataFrame(rows, "job_id long, status string, folder_ids array<string>")).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 4, 1), (7, 7, 0)}


def test_recommend(spark):
    points = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(4)], "id long, embedding array<double>")
    seeds = spark.createDataFrame([(0, 0.9)], "id long, score double")
    got = search.recommend(points, seeds, 2).collect()
    assert sorted((r.id, r.source, r.score) for r in got) == [(0, "seed", 0.9), (1, "neighbor", 0.0), (2, "neighbor", 0.0)]


def test_near_duplicate_edges_of_copies(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((12, 16))
    rows = [(1, base[0]), (5, base[0]), (6, base[0])]
    for i in range(7, 120):  # copies and near copies; one group is larger than k
        g = min(i % 20, 11)
        rows.append((i, base[g] if i % 3 else base[g] + 0.03 * r.standard_normal(16)))
    unit = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in rows]
    points = spark.createDataFrame(unit, "id long, embedding array<double>")
    terms = [(1, "other", 1.0), (5, "same", 50.0), (6, "same", 50.0)] + [(i, f"t{t}", float(r.uniform(0.5, 2))) for i in range(7, 120) for t in r.choice(8, 2, replace=False)]
    weights = spark.createDataFrame(terms, "id long, term string, weight double")
    got = {tuple(x) for x in curation.near_duplicate_edges(points, weights, 0.96, 5).collect()}
    assert (5, 6) in got and len(got) > 20
    by_embedding = curation.neighbour_edges(curation.similar_pairs(points, 0.96), 5)
    assert {tuple(x) for x in curation.banded_edges(points, 0.96, 5).collect()} == {tuple(x) for x in by_embedding.collect()}
    shared = weights.alias("x").join(weights.alias("y"), "term").filter("x.id <> y.id").groupBy(F.col("x.id").alias("id"), F.col("y.id").alias("other")).agg(F.sum(F.col("x.weight") * F.col("y.weight")).alias("score"))
    assert got == {tuple(x) for x in by_embedding.intersect(curation.neighbour_edges(shared, 5)).collect()}


def test_runs_and_single_flight(spark):
    runs = spark.createDataFrame([(1, "a", "running", 100), (2, "b", "running", 5000), (3, "c", "completed", 1), (4, "d", "running", None)], "run_id int, key string, status string, updated_at long")
    ended = {r.run_id: (r.status, r.error) for r in catalog.expire_runs(runs, 5100, 1800).collect()}
    assert ended == {1: ("failed", "timed out"), 2: ("running", None), 3: ("completed", None), 4: ("failed", "timed out")}
    asked = spark.createDataFrame([("a", 9, 20), ("a", 8, 20), ("a", 7, 30), ("b", 6, 1), ("e", 5, 1)], "key string, request_id int, created_at long")
    assert sorted(map(tuple, catalog.single_flight(asked, runs, 5100, 1800).collect())) == [("a", 8), ("e", 5)]
    assert catalog.single_flight(asked.limit(0), runs, 5100).count() == 0


def test_attributes_match(spark):
    rows = [(1, {"k": "a"}, {"k": "a", "x": "y"}), (2, {"k": "a"}, {}), (3, None, {"k": "b"}), (4, {"a.b": "1", "$c": "2", "sharepoint_file_id": "3"}, {}), (5, {"k": "a"}, None)]
    df = spark.createDataFrame(rows, "id int, wanted map<string, string>, attributes map<string, string>")
    assert [r.id for r in df.filter(sync.attributes_match(F.col("wanted"), F.col("attributes"))).orderBy("id").collect()] == [1, 3, 4]


def test_outliers_of_few_points(spark):
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.1])], "id int, embedding array<double>")
    assert tuple(curation.outlier_summary(two).first()) == (2, 0, 0.0, 0.0)
    assert curation.outlier_samples(two).count() == 0
    more = two.union(spark.createDataFrame([(3, [1.0, 0.1]), (4, [1.0, 0.0])], two.schema))
    assert curation.outlier_summary(more).first().outliers == 1
    assert [r.id for r in curation.outlier_samples(more, 2).collect()] == [2, 1]


def test_around_hits(spark):
    frame = spark.createDataFrame
    hits, files = frame([(1,), (1,)], "id int"), frame([(1, "f"), (2, "g")], "chunk_id int, file_id string")
    mentions, relations = frame([(1, 7), (1, 8), (2, 9)], "chunk_id int, entity_id int"), frame([(7, "of", 8), (7, "of", 8), (8, "of", 9)], "head_id int, rel_type string, tail_id int")
    nodes, links = graph.around_hits(hits, files, mentions, relations)
    assert sorted(map(tuple, nodes.collect())) == [("chunk", "1", True), ("document", "f", False), ("entity", "7", False), ("entity", "8", False)]
    assert sorted(map(tuple, links.collect())) == [("1", "MENTIONS", "7"), ("1", "MENTIONS", "8"), ("7", "of", "8"), ("f", "HAS_CHUNK", "1")]


def test_best_reranked(spark):
    rows = spark.createDataFrame([(1, "a", 0.3), (1, "a", 0.9), (1, "b", 0.9), (1, "c", 0.1), (2, "d", None)], "query_id int, id string, score double")
    assert [tuple(r) for r in search.best_reranked(rows, 0.25, 5).orderBy("rank").collect()] == [(1, "a", 0.9, 1), (1, "b", 0.9, 2)]


def test_failed_reranker_leaves_the_fused_order(spark):
    def broken(queries, texts):
        raise RuntimeError("no model")

    points = spark.createDataFrame([(1, "one"), (2, "two")], "id int, text string")
    rows = spark.createDataFrame([(0, 1, 0.01, 2), (0, 2, 0.02, 1)], "query_id int, id int, score double, rank int")
    asked = spark.createDataFrame([(0, "one")], "query_id int, query string")
    request = plan.SearchRequest(rerank=True)
    order = lambda model: [r.id for r in plan.finish(rows, points, request, asked, model).orderBy("position").collect()]
    assert order(broken) == [2, 1]
    assert {r.rerank_error for r in plan.finish(rows, points, request, asked, broken).collect()} == {"RuntimeError: no model"}
    assert order(plan.word_cosine) == [1]


def test_agent_request():
    request = plan.agent_request(900, filename="a.pdf", directories=["x"], score_threshold=-1)
    assert (request.max_num_results, request.score_threshold, request.filters, request.slugs) == (50, 0.0, {"filename": "a.pdf"}, ["x"])
    assert plan.agent_request(0).max_num_results == 1
    assert plan.agent_request(directories=[]).slugs == []


def test_property_keys(spark):
    from corpusforge.functions import text

    keys = [" Data di-Nascita ", "Brand#12", "a.b c", "__x__", "#"]
    got = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").select("i", text.property_key("k").alias("k")).orderBy("i")
    assert [r.k for r in got.collect()] == ["data_di_nascita", "brand12", "ab_c", "x", ""]


def test_scored_relations(spark):
    base = {"chunk_id": 1, "head": "Banca  X", "head_type": "org", "head_score": 0.9, "tail": "Mario", "tail_type": "per", "tail_score": 0.8, "adjacency": 0.6, "rel_type": "employs", "score": 0.5}
    odd = [{}, {"score": 0.7, "head": "banca x"}, {"score": 0.44}, {"head_score": 0.49}, {"tail_score": None}, {"adjacency": 0.54}, {"rel_type": ""}, {"head": " "}, {"tail": "x" * 61}, {"tail": "a b c d e f g h i"}, {"head_type": None, "tail_type": ""}, {"tail": "BANCA x", "tail_type": "org"}, {"chunk_id": 2, "tail_type": None}, {"chunk_id": 3, "tail": "Banca X"}]
    rows = [base | o for o in odd]
    names = list(base)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "chunk_id int, head string, head_type string, head_score double, tail string, tail_type string, tail_score double, adjacency double, rel_type string, score double")
    got = sorted((r.chunk_id, r.head_type, r.tail_type, r.score) for r in entities.scored_relations(df).collect())
    assert got == [(1, "org", "per", 0.7), (2, "org", "other", 0.5), (3, "org", "per", 0.5)]
