"""Beginnings of texts, worked out before rows that name a text are joined with it."""

from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.operators import search
from corpusforge.plans import search as plan
from corpusforge.queries import QUERIES

ODD = ["", " ", "\n\t ", "abc", " abc \n", "a" * 200, "a" * 201, " " + "b" * 199 + "  ", "c" * 199 + " d", "c" * 199 + "  \n", "d" * 150 + " " * 60, "d" * 150 + " " * 60 + "e", "　x\x1f", None, "😀" * 201, "f\r\n"]


def joins(node):
    children = node.children()
    for i in range(children.size()):
        yield from joins(children.apply(i))
    if node.nodeName() == "Join":
        yield [children.apply(i).output().mkString(",") for i in range(2)]


def test_a_head_is_what_the_stripped_text_begins_with(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "text string").select(text.head("text", 200).alias("a"), F.substring(text.strip("text"), 1, 200).alias("b"), search.head_hash("text").alias("h"))
    for r in rows.collect():
        assert r.a == r.b and (r.h is None) == (not r.b)


def test_found_rows_are_not_joined_with_texts(spark, sf):
    found = list(joins(QUERIES["text_dedupe_200"](spark, sf)._jdf.queryExecution().optimizedPlan()))
    assert found and not [x for both in found for x in both if "text#" in x]


def test_final_ranking_carries_no_texts(spark, sf, monkeypatch):
    seen, real = [], plan.finish
    monkeypatch.setattr(plan, "finish", lambda rows, points, *a: (seen.append(points.columns), real(rows, points, *a))[1])
    assert QUERIES["final_ranking"](spark, sf).count() > 0
    assert seen and all("text" not in c for c in seen)


def test_finish_dedupes_by_head_as_by_text(spark):
    rows = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7), (1, 13, 0.6)], "query_id long, id long, score double")
    points = spark.createDataFrame([(10, " same "), (11, "same"), (12, " "), (13, "other")], "id long, text string")
    whole = plan.finish(rows, points, plan.SearchRequest())
    short = plan.finish(rows, points.select("id", search.head_hash("text").alias("head")), plan.SearchRequest())
    assert [r.id for r in whole.orderBy("position").collect()] == [r.id for r in short.orderBy("position").collect()] == [10, 13]
    assert "text" in whole.columns and "_head" not in whole.columns
