"""Vector codes against plain loops, and bounds against distances."""

import math
import random

import duckdb
import numpy as np
import pytest

from corpusforge.llm import vectorcodes
from tests.llm import fixtures


def plain(rows):
    """The contract, one number at a time."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(kept[0][1]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(part(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(6):
        new = []
        for p in range(8):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(v, p)[1], []).append(part(v, p))
            new.append([[sum(c) // len(c) for c in zip(*of[j], strict=True)] if j in of else e for j, e in enumerate(books[p])])
        books = new
    out = [(i, [near(v, p) for p in range(8)], label) for i, v, label in kept]
    total = {}
    for _, n, label in out:
        total[label] = total.get(label, 0) + sum(d for d, _ in n)
    import hashlib

    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n), total[label], h) for i, n, label in out]


def vectors(n, seed, width=32):
    r = random.Random(seed)
    rows = [(i, [r.choice([r.gauss(0, 0.2), 0.125, -0.5]) for _ in range(width)], r.choice([1, 1, 1, 2, None])) for i in r.sample(range(1000), n)]
    rows += [(2000 + i, rows[i % n][1], 1) for i in range(20)]  # repeated vectors
    bad = [None, [], [None] * width, [0.5] * (width - 1) + [float("nan")], [float("inf")] + [0.5] * (width - 1)]
    return rows + [(3000 + i, b, 1) for i, b in enumerate(bad)] + [(None, rows[0][1], None), rows[1], rows[1]]


@pytest.mark.parametrize("n", [3, 120])
def test_equals_plain_loops(spark, n):
    rows = vectors(n, n)
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string, id int, v int")
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(map(tuple, vectorcodes.vector_codes(df.repartition(5)).collect()), key=key) == sorted(plain(rows), key=key)


def test_bounds_lose_no_entry():
    r = np.random.default_rng(3)
    for width, scale in ((8, 50), (6, 3), (5, 4096), (1, 9), (16, 2)):
        x, c = r.integers(-scale, scale, (400, width)), r.integers(-scale, scale, (16, width))
        c[7] = c[3]
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        found, least = vectorcodes.nearest(x, c)
        assert (found == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = db.execute("SELECT vec_id, code, error, label_error, codebooks_sha256 FROM (" + vectorcodes.vector_codes_sql() + ")").fetchall()
    assert sorted(map(tuple, vectorcodes.op11_vector_codes(spark, sf).collect())) == sorted(want)


def test_empty_and_misfit_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectorcodes.op11_vector_codes(spark, fixtures.save(spark, tmp_path, embeddings=([(1, None, 1)], schema))).count() == 0
    with pytest.raises(Exception, match="components"):
        vectorcodes.vector_codes(spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], schema)).count()
    with pytest.raises(Exception, match="too large"):
        vectorcodes.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], schema)).count()
