"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import embeddings, text, time
from corpusforge.operators import entities


def one(spark, column, schema=None, row=None):
    df = spark.createDataFrame([row], schema) if schema else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "headings", "want"),
    [
        ("Title\nBody here", ["Title"], "Body here"),
        ("  A\n\nB\nrest ", ["A", "B"], "rest"),
        ("B\nrest", ["A", "B"], "B\nrest"),
        ("A\nx", ["A", "C"], "x"),
        (" Title ", ["Title"], "Title"),
        (None, ["A"], ""),
        ("text", None, "text"),
        ("text", ["", None], "text"),
    ],
)
def test_strip_headings(spark, value, headings, want):
    assert one(spark, text.strip_headings("t", "h"), "t string, h array<string>", (value, headings)) == want


def test_body_hash_ignores_space_and_case(spark):
    df = spark.createDataFrame([("A  b C\n",), ("a b c",), ("a b d",)], "t string").select(text.body_hash("t").alias("h"))
    a, b, c = [r.h for r in df.collect()]
    assert a == b != c


def test_entity_forms(spark):
    assert one(spark, text.normalize_entity(F.lit("  ·Banca   D'Italia.;"))) == "banca d'italia"
    assert one(spark, text.strip_money(F.lit("€ 1.250,00"))) == one(spark, text.strip_money(F.lit("1.250,00 EUR"))) == "1.250,00"
    for variant in ("D.Lgs. n. 385/1993", "DLgs 385/1993"):
        assert one(spark, text.normalize_reference(F.lit(variant))) == "DLGS385/1993"
    assert one(spark, text.normalize_reference(F.lit("Regolamento (UE) 2016/679"))) == "REGOLAMENTO2016/679"


@pytest.mark.parametrize(
    ("query", "want"),
    [('find "due diligence" now', ["due diligence"]), ("legge 231/2001", ["231/2001"]), ("conto IT60X aperto", ["IT60X"]), ("codice ABI", ["ABI"]), ("plain prose only", []), ("in IT", []), (None, [])],
)
def test_lexical_terms(spark, query, want):
    assert one(spark, text.lexical_terms("q"), "q string", (query,)) == want


@pytest.mark.parametrize(
    ("value", "score", "flags"),
    [
        ("", 0.0, ["empty"]),
        ("  \n", 0.0, ["empty"]),
        (None, 0.0, ["empty"]),
        ("bcdfghjklmnpqrstvwxz bcdfg hjklm", 0.05, ["gibberish", "non_word", "short"]),
        ("three short words", 0.85, ["short"]),
        ("parola " * 25, 0.8, ["repetitive"]),
        ("### $$$ %%% &&&", 0.65, ["short", "symbol_heavy"]),
        ("importo: 12; data: 2024; numero: 7", 1.0, []),
        ("perché così è più bello di ieri", 1.0, []),
    ],
)
def test_quality(spark, value, score, flags):
    got = one(spark, text.quality("t"), "t string", (value,))
    assert (got.quality_score, got.quality_flags) == (score, flags)


def test_numbers_and_cells(spark):
    assert [one(spark, text.italian_number(F.lit(x))) for x in (1234567.0, 1234.5, -0.25, float("nan"))] == ["1.234.567", "1.234,50", "-0,25", "—"]
    df = spark.createDataFrame([("1.234,56",), ("12 %",), (" 7 ",), ("x",), ("",), ("1e3",), (None,)], "v string")
    assert [r.x for r in df.select(text.parse_number("v", ",").alias("x")).collect()] == [1234.56, 12.0, 7.0, None, None, 1000.0, None]
    assert one(spark, text.clip(F.lit("a  b" * 40), 10)) == "a ba ba b…"
    assert one(spark, text.verbalize(["a", "b", "c"]), "a string, b string, c int", ("x  y", " ", 3)) == "a: x y; c: 3"
    assert one(spark, text.vtt_timestamp(F.lit(3723.5))) == "01:02:03.500"
    assert one(spark, text.slugify(F.lit("Hello, World of Files"), 12)) == "hello-world"
    assert one(spark, text.property_key(F.lit(" Data di Nascita "))) == "data_di_nascita"
    assert one(spark, text.loose_name(F.lit("My_File-1.PDF"))) == "myfile1"
    assert one(spark, text.html_escape(F.lit("<a&'\">"))) == "&lt;a&amp;&#x27;&quot;&gt;"


def test_windows(spark):
    words = [f"w{i}" for i in range(700)]
    got = one(spark, text.windows("t"), "t string", (" ".join(words),))
    assert [g.split()[0] for g in got] == ["w0", "w270", "w540"] and got[-1].split()[-1] == "w699"
    assert one(spark, text.windows("t"), "t string", ("a  b",)) == ["a  b"]


def test_embeddings(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(embeddings.cosine("a", "b").alias("c"), embeddings.normalize("a").alias("n")).collect()
    assert got[0].c == pytest.approx(0.96) and got[0].n == pytest.approx([0.6, 0.8])
    assert got[1].c == 0 and list(got[1].n) == [0, 0]


def test_epoch_and_recency(spark):
    df = spark.createDataFrame([("garbage", "2024-01-01T00:00:00Z"), (None, "1704067200"), ("x", None)], "a string, b string")
    assert [r.e for r in df.select(time.epoch("a", "b").alias("e")).collect()] == [1704067200.0, 1704067200.0, None]
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, -30 * 86400.0), (1.0, None), (1.0, 99.0)], "s double, t double")
    got = [r.x for r in rows.select(time.recency("s", "t", 0.0, 30, 0.3).alias("x")).collect()]
    assert got == pytest.approx([1.0, 0.85, 1.0, 1.0])


def test_next_run_keeps_local_time_over_daylight_saving():
    day = 86400
    before = 1711753200  # 2024-03-30 00:00 in Rome
    first, second = time.next_run("0 3 * * *", before), time.next_run("0 3 * * *", before + day)
    assert second - first == day - 3600
    assert time.next_run("30 2 31 3 *", before) > before + 300 * day  # 02:30 doesn't exist on 2024-03-31
    assert time.next_run("*/15 * * * *", 1_700_000_000, "UTC") == 1_700_000_100
    with pytest.raises(ValueError):
        time.next_run("61 * * * *", 0)


CASES = {
    "email": ("scrivi a Mario.Rossi@Example.com.", ["mario.rossi@example.com"]),
    "url": ("vedi https://a.it/x?y=1, e www.b.it.", ["https://a.it/x?y=1", "www.b.it"]),
    "iban": ("IBAN IT60X0542811101000000123456 ok", ["IT60X0542811101000000123456"]),
    "importo monetario": ("€ 1.250,00 oppure 30 euro", ["1.250,00", "30"]),
    "percentuale": ("il 12,5 % e 3%", ["12,5%", "3%"]),
    "data": ("1/2/2024, 2024-05-06 ma non 1.6.3", ["1/2/2024", "2024-05-06"]),
    "codice fiscale": ("RSSMRA85T10A562S", ["RSSMRA85T10A562S"]),
    "partita iva": ("P.IVA: 12345678901 e 10987654321", ["12345678901"]),
    "normativa": ("D.Lgs. n. 231/2001; Legge\n201/2011; art. 6 del GDPR; EBA/GL/2021/02; Circolare 285", None),
}


@pytest.mark.parametrize("kind", CASES)
def test_patterns(spark, kind):
    value, want = CASES[kind]
    got = [e.normalized_name for e in one(spark, entities.pattern_entities("t", [kind]), "t string", (value,))]
    if want is None:
        assert {"DLGS231/2001", "LEGGE201/2011", "CIRCOLARE285"} <= set(got) and len(got) >= 5
    else:
        assert got == want


def test_token_span(spark):
    schema = "t array<string>, p array<string>"
    assert tuple(one(spark, entities.token_span("t", "p"), schema, (list("abcab"), ["a", "b"]))) == (0, 1)
    assert one(spark, entities.token_span("t", "p"), schema, (list("abc"), ["d"])) is None
    assert one(spark, entities.token_span("t", "p"), schema, (list("ab"), list("abc"))) is None


def test_queries_import_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True)
