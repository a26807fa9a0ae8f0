"""A registration writes the pairs that are new, and no bucket where none is."""

from corpusforge.plans import provenance
from corpusforge.plans.store import Store


def test_pairs_that_are_there_are_not_written_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    pairs = spark.createDataFrame([(f"f{i}", f"h{i % 3}") for i in range(9)], "file_id string, body_hash string")
    provenance.register(store, pairs, buckets=4)
    folders = store.manifest()["tables"][provenance.PAIRS].folders
    provenance.register(store, pairs, buckets=4)
    assert store.manifest()["tables"][provenance.PAIRS].folders == folders
    provenance.register(store, spark.createDataFrame([("f0", "h9"), ("f0", "h0")], "file_id string, body_hash string"))
    assert {(r.body_hash, r.doc_count) for r in provenance.counts(store).collect()} == {("h0", 3), ("h1", 3), ("h2", 3), ("h9", 1)}
