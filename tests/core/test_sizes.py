"""Queries whose cost or result went wrong with larger tables."""

import random

import numpy as np

from corpusforge.operators import catalog, ivf, nearest
from corpusforge.queries import QUERIES
from corpusforge.queries.retrieval import EVERY


def tables(spark, tmp_path, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_items_that_end_within_words_are_held(spark, tmp_path):
    docs = [(1, "prefixed alpha beta gammas here"), (2, "nothing of it"), (3, "xalphay"), (4, None)]
    items = [("a", "fixed alpha beta gamma"), ("b", "alpha"), ("c", "absent words here")]
    sf = tables(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id string, text string"))
    (row, *_) = QUERIES["eval_leakage"](spark, sf).collect()
    assert row.negatives == 1  # only c


def test_no_row_where_every_item_is_held(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=([(1, "one two three")], "doc_id long, text string"), benchmark=([("a", "one two")], "item_id string, text string"))
    assert QUERIES["eval_leakage"](spark, sf).collect() == []


def test_words_need_no_table_of_counts(spark, sf):
    plan = QUERIES["sparse_terms"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def attached(new, jobs):
    out = {}
    for job, name, content, slug in new:
        mine = [(f, c, s) for f, n, c, d, s in jobs if n == name and d == slug and name is not None]
        same = [f for f, c, s in mine if c == content and content is not None and s != "FAILED" and s is not None and f is not None]
        out[job] = (min(same, default=None), sorted({f for f, c, _ in mine if None not in (f, c, content) and c != content}))
    return out


def test_attach_lists_files_once_for_each_content(spark):
    r = random.Random(5)
    pick = lambda *x: r.choice([*x, None])
    new = [(i, pick("f1", "f2", "f3"), pick("a", "b", "c"), pick("s1", "s2")) for i in range(60)]
    jobs = [(pick("x1", "x2", "x3", "x4"), pick("f1", "f2"), pick("a", "b", "c"), pick("s1", "s2"), r.choice(["FAILED", "COMPLETED"])) for _ in range(200)]
    a = spark.createDataFrame(new, "job_id long, filename string, content_hash string, slug string")
    b = spark.createDataFrame(jobs, "file_id string, filename string, content_hash string, slug string, status string")
    got = {x.job_id: (x.duplicate_of, x.supersedes_file_ids) for x in catalog.attach(a, b).collect()}
    assert got == attached(new, jobs)
    # lists are gathered before jobs are met, so none is shuffled for each job
    plan = catalog.attach(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("collect_list")


def test_a_cell_is_scored_in_small_tables(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(2)
    points = spark.createDataFrame([(i, r.standard_normal(8).tolist()) for i in range(400)], "id long, embedding array<double>")
    index = ivf.build(points, str(tmp_path / "cells"), 3)
    queries = points.filter(f"id % {EVERY} = 0").withColumnRenamed("id", "query_id")
    wanted = sorted(map(tuple, ivf.search(index, queries, 5, threshold=-9.0).collect()))
    monkeypatch.setattr(nearest, "CELLS", 40)
    monkeypatch.setattr(nearest, "PENDING", 10)
    assert sorted(map(tuple, ivf.search(index, queries, 5, threshold=-9.0).collect())) == wanted


def test_pages_come_a_thousand_at_a_time(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sf = tables(spark, tmp_path, pages=([(1, "u", "<h1>a</h1><p>b</p>")], "page_id long, url string, html string"))
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        assert QUERIES["html_sections"](spark, sf).count() > 0
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
