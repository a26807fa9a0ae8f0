"""What new files replace is never shuffled or sorted, whatever the number of new files."""

import random

from corpusforge.operators import catalog
from corpusforge.queries import QUERIES
from tests.core.test_heads import joins
from tests.core.test_sizes import attached


def test_lists_stand_in_no_join(spark, sf):
    found = [side for both in joins(QUERIES["attach_dedupe"](spark, sf)._jdf.queryExecution().optimizedPlan()) for side in both]
    assert found and not any("supersedes" in side for side in found)


def test_groups_are_cut_and_lose_no_file(spark, monkeypatch):
    monkeypatch.setattr(catalog, "ATTACHED", 2)
    r = random.Random(1)
    pick = lambda *x: r.choice(x)
    new = list({(i, pick("a", "b", None), pick("x", "y", None), pick("s", None)): 1 for i in range(60)})
    jobs = [(f"f{r.randint(0, 9)}", pick("a", "b", None), pick("x", "y", "z", None), pick("s", None), pick("FAILED", "DONE")) for _ in range(80)]
    a = spark.createDataFrame([*new, *new[:5]], "job_id long, filename string, content_hash string, slug string")
    b = spark.createDataFrame(jobs, "file_id string, filename string, content_hash string, slug string, status string")
    assert max(len(x["new"]) for x in catalog.attach_groups(a, b).select("new").collect()) == 2
    rows = catalog.attach(a, b).collect()
    assert len(rows) == len(new) and {x.job_id: (x.duplicate_of, x.supersedes_file_ids) for x in rows} == attached(new, jobs)
