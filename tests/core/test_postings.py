"""Sparse search by bounds against all pairs; full-text search against plain matching."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import fulltext, postings, search
from corpusforge.plans import search as plan


def corpus(spark, n=600, whole=True, seed=2):
    """A word that every document has, common and rare ones, copies, and a few documents with all in plenty."""
    r, rows = random.Random(seed), []
    number = (lambda: r.choice([1, 1, 1, 2, 5])) if whole else (lambda: round(r.random() + 0.01, 3))
    for i in range(n):
        terms = {"the"} | {f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.choice([1, 5, 40]))}
        rows += [(i, t, number() * (50 if i % 100 == 7 else 1)) for t in terms]
    rows += [(n + i, t, w) for i in range(8) for j, t, w in rows if j == 5]
    return spark.createDataFrame(rows, f"id long, term string, weight {'long' if whole else 'double'}")


def listed(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize(("whole", "k", "pairs"), [(True, 10, 200_000), (True, 40, 150), (False, 7, 200_000)])
def test_equals_all_pairs(spark, monkeypatch, whole, k, pairs):
    monkeypatch.setattr(postings, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(postings, "FIRST", 1)
    weights = corpus(spark, whole=whole)
    queries = weights.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = postings.build(weights, depth=12)
    assert listed(postings.search(index, queries, k)) == listed(search.sparse_channel(weights, queries, k))
    high = listed(postings.search(index, queries, k, threshold=9.0))
    assert high == listed(search.sparse_channel(weights, queries, k, 9.0))


def test_a_word_of_every_document_leads_nothing_once_bounds_are_known(spark):
    weights = spark.createDataFrame([(i, "the", 1) for i in range(1000)] + [(i, f"r{i % 20}", 3) for i in range(1000)], "id long, term string, weight long")
    queries = spark.createDataFrame([(1, "the", 1), (1, "r3", 1), (2, "r5", 2), (2, "the", 1)], "query_id long, term string, weight long")
    index = postings.build(weights)
    pairs = queries.join(postings.bounds(index, queries, 10), "query_id").toArrow()
    block = postings._block(pairs, index.words.join(queries.select("term").distinct(), "term", "left_semi").toArrow(), 10)
    (c,) = block.classes()
    roles = postings._Class(block, c, block.bound)
    led = {block.terms[i].as_py() for i in range(len(block.terms)) if roles.lead_first[i + 1] > roles.lead_first[i]}
    assert led == {"r3", "r5"}


def test_classes_that_reach_no_bound_are_not_read(spark, monkeypatch):
    rows = [(i, t, 40) for i in range(60) for t in "ab"] + [(100 + i, "a", 1) for i in range(500)]
    weights = spark.createDataFrame(rows, "id long, term string, weight long")
    read = []
    scan = postings.Postings.documents
    index = postings.build(weights)
    monkeypatch.setattr(postings.Postings, "documents", lambda self, c=None: (read.append(c), scan(self, c))[1])
    queries = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "query_id long, term string, weight long")
    assert len(listed(postings.search(index, queries, 10))) == 10
    assert [c for c in read if c is not None] == [[6]]


def test_odd_weights_filters_and_empty_tables(spark):
    schema = "id long, term string, weight long"
    weights = spark.createDataFrame([(1, "a", 2), (2, "a", 2), (3, "a", None), (4, None, 5), (5, "b", 0), (6, "a", 9)], schema)
    queries = spark.createDataFrame([(1, "a", 3), (1, None, 1), (2, "b", 1), (3, "never", 1), (None, "a", 1)], "query_id long, term string, weight long")
    index = postings.build(weights)
    assert listed(postings.search(postings.load(spark, index.path), queries, 2)) == [(1, 1, 6, 27), (1, 2, 1, 6)]
    assert listed(postings.search(index, queries, 1, within=spark.createDataFrame([(2,), (1,)], "id long"))) == [(1, 1, 1, 6)]
    assert listed(postings.search(postings.build(spark.createDataFrame([], schema)), queries, 2)) == []


def test_request_with_postings(spark):
    weights = corpus(spark, 200)
    points = weights.select("id").distinct().withColumns({"embedding": F.array(F.lit(1.0)), "slug": F.concat(F.lit("s"), F.col("id") % 2)})
    queries = points.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    terms = weights.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    request = plan.SearchRequest(slugs=["s1"], sparse_limit=9)
    index = postings.build(weights)
    assert listed(plan.candidates(points, index, queries, terms, request)) == listed(plan.candidates(points, weights, queries, terms, request)) != []


TEXTS = [(1, "Order AB-12 of the red fox"), (2, "the fox; AB 12 order"), (3, "fox"), (4, None), (5, ""), (6, "Über FOX red red"), (7, "the the the"), (8, "order ab-12 red fox"), (9, "12 AB")]
ASKED = [(1, ["AB-12", "red fox"]), (2, ["the"]), (3, ["x", "!!"]), (4, ["never fox"]), (5, ["über", "fox", "fox"]), (6, []), (7, None), (8, ["ab-12", "the red", "order"])]


def plain_matches(k):
    words = lambda t: {w for w in re.findall(r"\w+", (t or "").lower()) if 2 <= len(w) <= 30}
    out = []
    for q, terms in ASKED:
        own = list(dict.fromkeys(terms or []))
        hits = [(-sum(t.lower() in x.lower() for t in own), i) for i, x in TEXTS if x and any(words(t) and words(t) <= words(x) for t in own)]
        out += [(q, n, i, -o) for n, (o, i) in enumerate(sorted(hits)[:k], 1)]
    return out


@pytest.mark.parametrize("k", [2, 30])
def test_full_text_search(spark, k):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    index = fulltext.build(texts)
    found = fulltext.search(index, texts, spark.createDataFrame(ASKED, "query_id long, terms array<string>"), k)
    assert sorted((r.query_id, r["rank"], r.id, r.overlap) for r in found.collect()) == plain_matches(k)


def test_only_the_rarest_token_is_opened(spark):
    texts = spark.createDataFrame([(i, "the of and" + (" rare" if i == 77 else "")) for i in range(300)], "id long, text string")
    index = fulltext.build(texts)
    assert [r.id for r in fulltext.matches(index, spark.createDataFrame([("the rare",), ("the absent",)], "term string")).collect()] == [77]
    first = [p for p in __import__("glob").glob(f"{index.path.removeprefix('file://').removeprefix('file:')}/../terms-*/first")]
    assert min(spark.read.parquet(p).count() for p in first) <= 1


def test_each_query_has_its_own_terms(spark):
    texts = spark.createDataFrame([(i, x) for i, x in TEXTS if x], "id long, text string")
    points = texts.withColumn("slug", F.when(F.col("id") < 8, "s1").otherwise("s2"))
    rows = spark.createDataFrame([(1, 3, 1), (2, 3, 1)], "query_id long, id long, rank long")
    asked = plan.own_terms(spark.createDataFrame([(1, 'find "red fox"'), (2, "about AB-12 12/34"), (3, "nothing")], "query_id long, query string"))
    assert {r.query_id: r.terms for r in asked.collect()} == {1: ["red fox"], 2: ["12/34"]}
    asked = spark.createDataFrame([(1, ["red fox"]), (2, ["AB-12"]), (9, ["fox"])], "query_id long, terms array<string>")
    index = fulltext.build(texts)
    got = plan.augment(rows, points, plan.SearchRequest(slugs=["s1"]), terms=asked, texts=index)
    ids = lambda q: {r.id for r in got.collect() if r.query_id == q}
    assert ids(1) == {3, 1, 6} and ids(2) == {3, 1, 2} and ids(9) == set()
