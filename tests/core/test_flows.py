"""Sources, ingestion, streaming, plans, and what the entry registers."""

import json

import pytest
from pyspark.sql import functions as F

from corpusforge.plans import ingest
from corpusforge.sources import files
from corpusforge.streaming import ingest as stream

EMAIL = b"""From: A <a@x.it>\r\nTo: b@y.it\r\nSubject: Prova & co\r\nDate: Mon, 1 Jan 2024 10:00:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nplain <text>\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>rich</p>\r\n--B--\r\n"""
PLAIN = b"Subject: S\r\nContent-Type: text/plain\r\n\r\na < b\r\n"


def test_email(spark):
    df = spark.createDataFrame([(bytearray(EMAIL),), (bytearray(PLAIN),), (None,)], "content binary")
    rich, plain, none = [r.h for r in df.select(files.email_html("content").alias("h")).collect()]
    assert "<p>rich</p>" in rich and "Prova &amp; co" in rich and "plain" not in rich
    assert "<pre>a &lt; b" in plain and none is None
    with pytest.raises(NotImplementedError):
        files.outlook_html("content")


def test_html(spark):
    page = "<html><head><title>t</title><script>var x='<p>'</script></head><body><nav>menu</nav><h1>One</h1><p>a &amp; b</p><h2>Two</h2><p>c<br>d<p>e</body>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    got = [(r.headings, r.text) for r in files.html_sections(df).orderBy("chunk_index").collect()]
    assert got == [(["One"], "a & b"), (["One", "Two"], "c d"), (["One", "Two"], "e")]


def test_routes(spark):
    df = spark.createDataFrame([("x/A.PDF",), ("m.eml",), ("n.txt",), ("noext",), (".hidden",), ("a.b/c",)], "n string")
    assert [r.r for r in df.select(files.route("n").alias("r")).collect()] == ["native", "email", "text", "unsupported", "unsupported", "unsupported"]


def test_vtt_and_chunks(spark):
    df = spark.createDataFrame([(1, "WEBVTT\n\n00:01.000 --> 00:02.000\nHello\n\n00:03.000 --> 00:04.000\nworld\n")], "doc_id long, text string")
    assert df.select(files.vtt_text("text").alias("x")).first().x == "Hello world"
    docs = spark.createDataFrame([(1, "intro\n# A\none two three\n## B\nfour\n# C\n"), (2, None)], "doc_id long, text string")
    got = [(r.chunk_index, r.headings, r.text) for r in files.heading_chunks(docs, max_tokens=2).orderBy("chunk_index").collect()]
    assert got == [(0, [], "intro"), (1, ["A"], "A\none two"), (2, ["A"], "A\nthree"), (3, ["A", "B"], "A\nB\nfour")]


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("nome;importo\nperché;1.234,5\n", encoding="latin-1")
    df, decimal = files.read_table(spark, str(path))
    assert decimal == "," and [tuple(r) for r in df.collect()] == [("perché", "1.234,5")]
    assert files.sniff(b"a,b\n1,2\n") == ("UTF-8", ",", ".") and files.sniff(b"") == ("UTF-8", ",", ".")


def test_examples(spark, tmp_path):
    rows = [{"text": "Mario lavora in Banca", "entities": [["Mario", "per"], ["Roma", "loc"]]}, {"tokenized_text": ["a", "b"], "ner": [["0", "1", "x"]]}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    one, two = files.read_examples(spark, str(tmp_path)).collect()
    assert [tuple(s) for s in one.spans] == [(0, 0, "per")] and one.missed == 1 and [tuple(s) for s in two.spans] == [(0, 1, "x")]


def test_file_source(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    got = files.read_files(spark, str(tmp_path), max_bytes=50).collect()
    assert [(r.filename, r.bytes) for r in got] == [("a.txt", 3)] and got[0].file_id.startswith("file-")


def test_files_that_are_not_taken_say_why(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("a.txt", b"abc"), ("sub/b.txt", b"x" * 100), ("d.xyz", b"q"), ("e.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(content)
    got = {r.filename: r.reason for r in files.admit_files(spark, str(tmp_path), max_bytes=50).collect()}
    assert got == {"a.txt": None, "b.txt": "too large", "d.xyz": "unsupported", "e.pdf": None}


def test_whole_texts(spark, tmp_path):
    for name, content in (("a.txt", "però\r\nsì".encode()), ("b.log", "però".encode("cp1252")), ("c.rst", "\ufeffx".encode("utf-16")), ("d.txt", b"\xef\xbb\xbfy\rz"), ("e.pdf", b"no")):
        (tmp_path / name).write_bytes(content)
    got = {r.filename: r.text.lstrip("\ufeff") for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "però\nsì", "b.log": "però", "c.rst": "x", "d.txt": "y\nz"}


def test_ingest_tables(spark):
    chunks = spark.createDataFrame([("f", 0, ["T"], "T\nscrivi a a@b.it"), ("g", 0, ["U"], "U\nScrivi a  a@b.it")], "file_id string, chunk_index int, headings array<string>, text string")
    out = ingest.derive(ingest.enrich(chunks))
    assert sorted(r.file_id for r in out["bodies"].collect()) == ["f", "g"] and out["bodies"].select("body_hash").distinct().count() == 1
    assert out["entities"].count() == 1 and out["mentions"].count() == 2 and out["sections"].count() == 2


def test_upsert_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("f", 1), ("g", 2)], "file_id string, v int")
    new = spark.createDataFrame([("g", 3)], "file_id string, v int")
    assert ingest.snapshot(spark, str(tmp_path)) is None
    ingest.upsert(old, str(tmp_path))
    for _ in range(2):
        got = ingest.upsert(new, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == [("f", 1), ("g", 3)]
    assert ingest.snapshot(spark, str(tmp_path)).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(i, f"line one {i}\nline two") for i in range(6)], schema)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream.stream_documents(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck"), per_batch=1).awaitTermination(120)
    batch = ingest.enrich(files.line_chunks(docs).withColumn("headings", F.array().cast("array<string>")))
    got = ingest.snapshot(spark, str(tmp_path / "out"))
    columns = ["point_id", "body_hash", "text", "quality_score"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_plans(spark, sf):
    """Filters reach the scan, columns are pruned, and top-k is cut within groups first."""
    import __spark_entry__ as entry

    explain = lambda df: df._jdf.queryExecution().toString()
    q = entry.queries()
    assert "PushedFilters: [In(source" in explain(q["scope_filter"](spark, sf))
    scanned = [line for line in explain(q["table_card_numeric"](spark, sf)).splitlines() if "ReadSchema" in line]
    assert scanned and all("l_comment" not in s and "l_shipdate" not in s for s in scanned)
    assert "WindowGroupLimit" in explain(q["dense_topk"](spark, sf))


def test_every_twin_has_a_query(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90
    assert entry.entry(spark).count() > 0


def test_models_report_errors(spark):
    from corpusforge.plans import models

    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "gamma a@b.it")], "chunk_id long, text string")
    found = models.model_entities(df, lambda: models.DictionaryModel({"alpha": "x", "gamma": "y"}), ["x", "y"])
    assert sorted((r.chunk_id, r.type, r.normalized_name) for r in found.collect()) == [(1, "x", "alpha"), (3, "email", "a@b.it"), (3, "y", "gamma")]

    def broken(texts, labels):
        raise RuntimeError("no model")

    assert {r.error for r in models.classify(df, lambda: broken, ["a"]).collect()} == {"RuntimeError: no model"}
    assert {r.error for r in models.classify(df, lambda: lambda t, labels: [], ["a"]).collect()} <= {f"ValueError: 0 answers for {n} texts" for n in (1, 2, 3)}
    best = models.classify(df, lambda: models.KeywordClassifier({"a": ["alpha"], "b": ["alpha", "beta"]}), ["a", "b"]).filter("chunk_id = 1").first()
    assert [c.label for c in best.classes] == ["a", "b"]
    words = spark.createDataFrame([("Hello, world (again)!",)], "t string")
    assert words.select(models.detokenise(models.tokenise("t")).alias("x")).first().x == "Hello, world ( again)!"


def test_stale_jobs_in_a_stream(spark, tmp_path):
    schema = "ts timestamp, file_id string, status string"
    rows = [("2024-01-01 00:00:10", "f", "PROCESSING"), ("2024-01-01 00:10:00", "g", "PROCESSING"), ("2024-01-01 00:20:00", "g", "COMPLETED"), ("2024-01-01 05:00:00", "h", "PENDING")]
    spark.createDataFrame(rows, "ts string, file_id string, status string").selectExpr("CAST(ts AS timestamp) AS ts", "file_id", "status").coalesce(1).write.parquet(str(tmp_path / "e"))
    query = stream.watch_stale(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("stale").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r.file_id for r in spark.table("stale").collect()] == ["f"]


def test_overview(spark):
    from corpusforge.plans.overview import overview

    docs = spark.createDataFrame([("f", "s", "en"), ("g", "t", "it")], "file_id string, slug string, category string")
    jobs = spark.createDataFrame([("f", "COMPLETED"), ("g", "FAILED")], "file_id string, status string")
    chunks = spark.createDataFrame([("f", "h"), ("g", "h")], "file_id string, body_hash string")
    whole, part = overview(docs, jobs, chunks), overview(docs, jobs, chunks, ["s"])
    assert whole["statuses"].first().total == 2 and part["statuses"].first().total == 1
    assert part["curation"].first().total_documents == 1 and whole["fingerprint"].first() != part["fingerprint"].first()


def test_schedules(spark):
    from corpusforge.operators import catalog

    rows = [(1, "0 3 * * *", True, 100), (2, "0 3 30 2 *", True, 100), (3, "0 3 * * *", True, 2 * 10**9), (4, "0 3 * * *", False, 100)]
    df = spark.createDataFrame(rows, "id int, cron string, enabled boolean, next_run long")
    got = {r.id: (r.enabled, r.next_run) for r in catalog.reschedule(df, 1711753200.0).collect()}
    assert got[1][0] and got[1][1] > 1711753200 and got[2] == (False, None) and got[3] == (True, 2 * 10**9) and got[4] == (False, 100)
    files = spark.createDataFrame([(1, "b", "FAILED", 1), (2, "A", "COMPLETED", 3), (3, "c", "FAILED", 2)], "job_id int, filename string, status string, created_at int")
    order = lambda m: [r.job_id for r in catalog.client_order(files, m).collect()]
    assert (order("name"), order("recent"), order("status")) == ([2, 1, 3], [2, 3, 1], [1, 3, 2])
