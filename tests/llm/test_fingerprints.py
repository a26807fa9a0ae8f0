"""Fingerprints: the rows' order, edited texts, and how near the estimates come."""

import hashlib

import numpy as np

from corpusforge.llm import fingerprints as fp
from tests.llm import fixtures


def shingles(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in text.replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op4(spark, tmp_path):
    data = sorted({x for x in fixtures.rows() if x[0] is not None and x[0] != 65 or x[1] is None}, key=lambda x: x[0])
    path = fixtures.save(spark, tmp_path, documents=(data, "doc_id long, text string"))
    got = sorted(fp.op4_fingerprints(spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [i for i, _ in data]
    errors = []
    for k, r in enumerate(got):
        t, following = data[k][1] or "", data[(k + 1) % len(data)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == fp.likeness(bytes.fromhex(r.fingerprint), bytes.fromhex(got[(k + 1) % len(got)].fingerprint))
        errors += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, following)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and max(map(abs, errors)) < 0.2
    prints = {}
    for r, (_, t) in zip(got, data, strict=True):
        assert prints.setdefault(t or "", r.fingerprint) == r.fingerprint


def test_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.3, 0.6, 0.9):
        for n in (20, 400):
            errors = []
            for _ in range(40):
                words = [f"w{x}" for x in rng.integers(0, 10**9, 2 * n)]
                keep = int(n * share)
                a, b = " ".join(words[:n]), " ".join(words[:keep] + words[n : 2 * n - keep])
                x, y = fp.sketch([a.encode(), b.encode()])
                errors.append(fp.likeness(x, y) - jaccard(a, b))
            assert abs(np.mean(errors)) < 0.04, (share, n)


def test_columns_and_edges(spark):
    df = fixtures.frame(spark)
    got = fp.fingerprint(df)
    assert got.columns == [*df.columns, "fingerprint"] and got.count() == df.count()
    pair = spark.createDataFrame([(x.hex(), y.hex(), fp.likeness(x, y)) for x in fp.sketch([b"a b c d e f", b"", b"a b c d e g", b"q"]) for y in fp.sketch([b"a b c d e f", b" "])], "a string, b string, want double")
    assert all(abs(r.want - r.got) < 1e-12 for r in pair.select("want", fp.likeness_column("a", "b").alias("got")).collect())
    long = b"some words and others " * 200_000
    assert fp.sketch([long]) == fp.sketch([b"some words and others some words and others"])
    for data in ([], [(5, "only one document here")]):
        out = fp.with_next(spark.createDataFrame(data, "doc_id long, text string"), fp._op4_rows, fp.OP4_SCHEMA).collect()
        assert len(out) == len(data) and all(r.near_next == 1 for r in out)


def test_repeated_ids(spark):
    data = [(1, "b"), (1, "a"), (None, "z"), (2, None), (2, None)] * 4
    out = fp.with_next(spark.createDataFrame(data, "doc_id long, text string"), fp._op4_rows, fp.OP4_SCHEMA).collect()
    assert len(out) == len(data)
