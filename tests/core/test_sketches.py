"""Sketches that are merged over parts against exact figures of the whole."""

import random
from collections import Counter

from corpusforge.operators import sketches


def test_merged_parts_keep_the_bounds_of_one_pass(spark):
    r = random.Random(6)
    data = [(f"d{i % 9}", f" v{int(r.paretovariate(0.5)) % 20_000} ", str(round(r.gauss(50, 20), 3))) for i in range(30_000)]
    df = spark.createDataFrame(data, "day string, word string, number string").repartition(5)
    tracked = 1000
    merged = sketches.merge(sketches.sketch(df, ["word", "number"], ["day"], tracked), tracked=tracked)
    once = sketches.sketch(df, ["word", "number"], tracked=tracked)
    words = Counter(w.strip() for _, w, _ in data)
    numbers = sorted(float(x) for _, _, x in data)
    for found in (merged, once):
        f = {x.column: x for x in sketches.figures(found, quantiles=(0.25, 0.5)).collect()}
        assert f["word"].rows == f["word"].cells == 30_000 and f["word"].numbers == 0 and f["word"].quantiles is None
        assert abs(f["word"].distinct - len(words)) <= sketches.DISTINCT_ERROR * len(words)
        for q, x in zip((0.25, 0.5), f["number"].quantiles, strict=True):
            rank = sum(n <= x for n in numbers) / len(numbers)
            assert abs(rank - q) <= sketches.RANK_ERROR
        bound = sketches.frequency_error(30_000, tracked)
        tops = {x.value: x.n for x in sketches.frequent(found, top=50, tracked=tracked).filter("column = 'word'").collect()}
        assert all(abs(n - words[v]) <= bound for v, n in tops.items())
        assert all(v in tops for v, n in words.most_common(10) if n > 2 * bound)


def test_few_values_are_exact_and_blanks_are_none(spark):
    data = [(d, v, None) for d in "ab" for v in ["x", " x", "y", "", None, "  ", "1.5"]]
    df = spark.createDataFrame(data, "day string, v string, nothing string")
    merged = sketches.merge(sketches.sketch(df, ["v", "nothing"], ["day"]))
    assert [(x.value, x.n, x.r) for x in sketches.frequent(merged).orderBy("r").collect()] == [("x", 4, 1), ("1.5", 2, 2), ("y", 2, 3)]
    f = {x.column: x for x in sketches.figures(merged).collect()}
    assert (f["v"].rows, f["v"].cells, f["v"].numbers, f["v"].distinct, f["v"].quantiles) == (14, 8, 2, 3, [1.5, 1.5, 1.5])
    assert (f["nothing"].rows, f["nothing"].cells, f["nothing"].distinct, f["nothing"].quantiles) == (14, 0, 0, None)
    assert sketches.frequent(sketches.merge(sketches.sketch(df.limit(0), ["v"], ["day"]))).count() == 0
