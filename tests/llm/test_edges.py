"""Every registered training-data query on empty tables, null rows and extra columns."""

import pytest

from corpusforge.llm.queries import QUERIES
from tests.llm import fixtures

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids binary, toxicity double, hits string, _row int"
TABLES = {
    "pages": ([], "page_id long, url string, html string"),
    "labels": ([], "doc_id long, quality int, toxic int"),
    "benchmark": ([], "item_id long, text string"),
    "embeddings": ([], "vec_id long, embedding array<float>, label int"),
}
NULLS = [(None, None, None, None, None, None, None, None, None), (1, None, "en", "s", None, None, None, None, None), (2, "", "en", "s", 0, None, 0.0, "x", 1), (2, "", "en", "s", 0, None, 0.0, "x", 1), (3, "a few words of text here", "en", "s", 24, None, 0.0, "x", 1)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, docs in (("empty", []), ("nulls", NULLS)):
        tables = TABLES | {"documents": (docs, DOCS)}
        if docs:
            tables = tables | {"pages": ([(None, None, None), (1, None, None), (1, "u", "x")], TABLES["pages"][1]), "labels": ([(None, None, None), (3, 1, None), (3, 1, 1), (3, 1, 0)], TABLES["labels"][1]), "benchmark": ([(None, None), (1, ""), (1, "words of text")], TABLES["benchmark"][1]), "embeddings": ([(None, [0.5] * 16, None), (1, None, 1), (2, [0.25] * 16, None), (2, [0.25] * 16, None)], TABLES["embeddings"][1])}
        out[name] = fixtures.save(spark, tmp_path_factory.mktemp(name), **tables)
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_query(spark, folders, name, kind):
    rows = QUERIES[name](spark, folders[kind]).collect()
    key = {"op5": "page_id", "op11": "vec_id"}.get(name.split("_")[0], "doc_id")
    # pages; vectors; the one document with a word of an item; all documents
    full = {"op5": [None, 1, 1], "op11": [None, 2, 2], "op13": [3]}.get(name.split("_")[0], [r[0] for r in NULLS])
    want = [] if kind == "empty" else full
    assert sorted(map(str, (r[key] for r in rows))) == sorted(map(str, want))


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_pipeline(spark, folders, kind):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, folders[kind]).collect()
    assert (len(rows) == 0) if kind == "empty" else {1, 2} <= {r.doc_id for r in rows}
